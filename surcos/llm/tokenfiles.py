"""Token ids in binary shards, compressed with Re-Pair grammars.

Texts are dealt out by ranges of ``doc_id`` and encoded in that order. A task writes its
range as a run of shards of about ``SHARD_IDS`` ids, whatever the size of the range, so
memory stays bounded. In a shard frequent pairs of ids are replaced by nonterminals, round
after round until no pair is frequent enough; a run of one id is replaced from the left. The
shard stores the rules, what each expands to in length, where documents end, and how many
ids lie before every ``BLOCK`` symbols, so any stretch of ids is read from the symbols that
hold it, without expanding or summing the rest.

A shard is a row of a Parquet table: Spark's commit makes each appear exactly once, also
when executors are lost. ``part`` and ``seq`` give the order of the shards.

Format of ``shard`` (little-endian): five unsigned 32-bit integers, namely base (the least
nonterminal), rules r, symbols s, documents d, bytes w of a symbol (2 or 4); then d ends of
documents and one number of ids for each begun block of symbols, unsigned 64-bit; r pairs of
symbols and r expansion lengths, unsigned 32-bit; s symbols of w bytes. Nothing is deflated.

Strings of special tokens in a text become these tokens, as by the library's own call.

Defined cases: a null or empty text has the end id only; null doc_ids come first; rows with
equal doc_id are ordered by their text; an empty table gives no shards. Columns other than
id and text are not stored.
"""

from __future__ import annotations

import binascii
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from surcos.llm.words import flat_words, slices
from surcos.operators.ranking import running_totals

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 2
SHARD_IDS = 1 << 20
MARK = "\x01"  # stands between words that are encoded as one text
JOINED = 128  # words, or pieces of words, of such a text
REMEMBERED = 400_000  # pieces of words whose ids a Python worker keeps
SLICE = 24 << 20  # bytes of text that are encoded together
PAIRS = 2048  # replaced in a round, at most
LEAST = 64  # occurrences below which a pair gets no rule; a rule takes the room of some six symbols
BUCKET_BITS = 20  # pairs are counted in so many hashed buckets
BLOCK = 1024  # symbols between two entries of a shard's index
MAX_FILE = 64 << 20


def share_tokenizer(spark: SparkSession, path: str = TOKENIZER):
    with open(path, "rb") as f:
        content = f.read(MAX_FILE + 1)
    if len(content) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    return spark.sparkContext.broadcast(content)


@lru_cache(maxsize=2)
def tokenizer(content: bytes) -> Tokenizer:
    return Tokenizer.from_buffer(content)


class Speller:
    """The ids of words by one tokenizer; up to ``REMEMBERED`` pieces are encoded once a Python worker.

    Where the tokenizer has the expected normalizers and pattern, words of plain ASCII and
    Latin letters, which are normal already, are lower-cased and cut here, many at a time, and
    go to its merges alone: the same ids without its passes. All others go through the whole.
    """

    def __init__(self, content: bytes):
        self.tok = tokenizer(content)
        config = json.loads(content)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.merges = None
        if _plain_steps(config) == PLAIN_STEPS:
            config |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
            self.merges = Tokenizer.from_str(json.dumps(config))
            suffix, vocabulary = config["model"]["end_of_word_suffix"], self.merges.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[str, int] = {}
        self.ids, self.length = np.zeros(0, "<u4"), np.zeros(0, "i8")

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has."""
        # The pieces' bytes follow each other, each with a blank: every JOINED of them are one text.
        spaced = pc.binary_join_element_wise(pieces, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        off = np.frombuffer(spaced.buffers()[1], "i8")[spaced.offset : spaced.offset + len(spaced) + 1]
        off = np.append(off[:-1:JOINED], off[-1])
        texts = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), spaced.buffers()[2]).to_pylist()
        found: list[np.ndarray] = [np.zeros(0, "<u4")]
        for i in range(0, len(texts), 256):
            # Bytes of other letters than ASCII in the characters that stand for them.
            batch = [t if t.isascii() else t.encode().decode("latin-1").translate(_STAND_INS) for t in texts[i : i + 256]]
            ids: list[int] = []
            for e in self.merges.encode_batch_fast(batch, add_special_tokens=False):
                ids += e.ids
            found.append(np.array(ids, "<u4"))
        ids = np.concatenate(found)
        # The last id of every piece tells that it is one.
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece begin and how many they are; pieces met before are looked up."""
        named = pieces.to_pylist()
        row = np.fromiter(map(self.known.get, named, repeat(-1)), "i8", len(named))
        missing = np.flatnonzero(row < 0)
        ids, length = self._merged(pieces.take(pa.array(missing)))
        held = len(self.length)
        row[missing] = held + np.arange(len(missing))
        every, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.length, length])
        keep = min(len(missing), REMEMBERED - held)
        if keep:
            self.known.update(zip([named[k] for k in missing[:keep].tolist()], range(held, held + keep)))
            self.length = sizes[: held + keep].copy()
            self.ids = every[: self.length.sum()].copy()
        return every, (np.cumsum(sizes) - sizes)[row], sizes[row]

    def _by_pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), _PIECE, "\\1 ")
        parts = pc.count_substring(spaced, " ").to_numpy()
        flat = pc.split_pattern(spaced, " ").flatten()
        coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
        ids, first, size = self._known(coded.dictionary)
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])
        return ids[at], np.diff(ends[np.concatenate([[0], np.cumsum(parts)])])

    def _by_tokenizer(self, given: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Many words are encoded as one text, with a mark of a single id between them; words with the mark go alone."""
        words, mark = given.to_pylist(), self.tok.encode(MARK, add_special_tokens=False).ids
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(words)
        joined = [k for k, w in enumerate(words) if MARK not in w and len(mark) == 1]
        joint = f" {MARK} "
        for i in range(0, len(joined), 256 * JOINED):
            own = joined[i : i + 256 * JOINED]
            texts = [joint.join(words[k] for k in own[j : j + JOINED]) + joint for j in range(0, len(own), JOINED)]
            found: list[int] = []
            for e in self.tok.encode_batch_fast(texts, add_special_tokens=False):
                found += e.ids
            ids = np.array(found, "<u4")
            stop = np.flatnonzero(ids == mark[0])
            for k, a, b in zip(own, [0, *(stop + 1).tolist()], stop.tolist()):
                out[k] = ids[a:b]
        for k in set(range(len(words))) - set(joined):
            out[k] = np.array(self.tok.encode(words[k], add_special_tokens=False).ids, "<u4")
        return np.concatenate([np.zeros(0, "<u4"), *out]), np.array([len(x) for x in out], "i8")

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words one after the other, where each word's begin, and how many they are."""
        words = words.cast(pa.large_string())
        plain = np.zeros(len(words), bool)
        if self.merges is not None:
            odd = pc.match_substring_regex(words, "|".join([_OTHER, *map(re.escape, self.special)]))
            plain = ~odd.to_numpy(zero_copy_only=False)
        ids, length = np.zeros(0, "<u4"), np.zeros(len(words), "i8")
        first = np.zeros(len(words), "i8")
        for chosen, way in ((plain, self._by_pieces), (~plain, self._by_tokenizer)):
            at = np.flatnonzero(chosen)
            if len(at):
                own, n = way(words.take(pa.array(at)))
                length[at], first[at] = n, len(ids) + np.cumsum(n) - n
                ids = np.concatenate([ids, own])
        return ids, first, length


# The steps before the merges for which plain ASCII words may be cut here.
PLAIN_STEPS = (
    ["NFC", "Replace", "Lowercase"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "ByteLevel", "BPE", "</w>",
)
# Letters that are normal as they are and have one lower-case form, the
# pattern's pieces of words made of them and ASCII, and the characters that stand for bytes.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_OTHER = f"[^\\x21-\\x7e{_LETTERS}]"
_PIECE = f"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+)"
_STAND_INS = {b: 256 + 33 + k for k, b in enumerate([*range(127, 161), 173])}


def _plain_steps(config: dict) -> tuple:
    """What a tokenizer file does before and in its merges, as far as it is of the known shape."""
    try:
        normal, (cut, level) = config["normalizer"]["normalizers"], config["pre_tokenizer"]["pretokenizers"]
        removed = cut["behavior"] == "Removed" and cut["invert"] and not level["add_prefix_space"] and not level["use_regex"]
        return (
            [n["type"] for n in normal], cut["pattern"]["Regex"] if removed else None, level["type"],
            config["model"]["type"], config["model"]["end_of_word_suffix"],
        )
    except (KeyError, TypeError, ValueError):
        return ()


@lru_cache(maxsize=2)
def speller(content: bytes) -> Speller:
    return Speller(content)


def encode(texts: pa.Array, spell: Speller) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and for n texts the n + 1 places where each begins.

    No token of this vocabulary spans white space, so each distinct word is encoded once.
    """
    flat, begin = flat_words(texts)
    coded = flat.dictionary_encode()
    ids, first, length = spell.spell(coded.dictionary)
    code = coded.indices.to_numpy()
    size = length[code] if len(code) else np.zeros(0, "i8")
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first[code] - ends[:-1], size) + np.arange(ends[-1]) if len(code) else np.zeros(0, "i8")
    return ids[at], ends[begin]


def _second_of_equals(equal: np.ndarray) -> np.ndarray:
    """Of the places where a pair of equal symbols begins, those that a pair from the left takes up."""
    at = np.flatnonzero(equal)
    if not len(at):
        return at
    starts = np.concatenate([[True], np.diff(at) > 1])
    run = at[starts][np.cumsum(starts) - 1]
    return at[(at - run) % 2 == 1]


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray]:
    """(base, rules, symbols). A round takes the most frequent pairs of which no two can overlap.

    Pairs are counted in hashed buckets; each of the fullest buckets stands for one pair that
    fell into it, whose occurrences are then counted exactly. Another pair of the same bucket
    has its turn in a later round. Rounds end when none of these pairs occurs ``least`` times.
    A pair of equal symbols is taken from the left of every run; it shares its symbol with no
    other pair of the round, but a run of different length may reach into the next symbol.
    """
    seq = ids.astype("u4")
    base = int(seq.max(initial=0)) + 1
    top, rules = base, []
    while len(seq) >= 2 * least:
        left, right = seq[:-1], seq[1:]
        bucket = (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)
        full = np.bincount(bucket, minlength=1 << BUCKET_BITS)
        fullest = np.flatnonzero(full >= least)
        if len(fullest) > 4 * PAIRS:
            fullest = fullest[np.argpartition(full[fullest], -4 * PAIRS)[-4 * PAIRS :]]
        number = np.full(1 << BUCKET_BITS, -1, "i2")
        number[fullest] = np.arange(len(fullest))
        near = number[bucket]
        near[_second_of_equals(left == right)] = -1
        at = np.flatnonzero(near >= 0)
        near, pair = near[at], left[at].astype("u8") << np.uint64(32) | right[at]
        stands = np.zeros(len(fullest), "u8")
        stands[near[::-1]] = pair[::-1]
        same = stands[near] == pair
        n = np.bincount(near[same], minlength=len(fullest))
        firsts, seconds, taken = set(), set(), []
        symbol = np.zeros(len(fullest), "u4")
        for k in np.argsort(-n, kind="stable").tolist():
            a, b = int(stands[k]) >> 32, int(stands[k]) & 0xFFFFFFFF
            if n[k] < least or len(taken) == PAIRS:
                break
            if a not in seconds and b not in firsts and (a != b or (a not in firsts and a not in seconds)):
                firsts.add(a)
                seconds.add(b)
                symbol[k] = top + len(taken)
                taken.append((a, b))
        if not taken:
            break
        rules += taken
        top += len(taken)
        new = np.where(same, symbol[near], 0)
        hit = at[new > 0]
        seq[hit] = new[new > 0]
        gone = np.ones(len(seq), bool)
        gone[hit + 1] = False
        seq = seq[gone]
    return base, np.array(rules, "u4").reshape(-1, 2), seq


def lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each rule expands to; a rule only names earlier ones."""
    out = np.ones(len(rules), "u4")
    of = lambda s: 1 if s < base else out[s - base]
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = of(a) + of(b)
    return out


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    base, rules, seq = compress(ids)
    size = lengths(base, rules)
    wide = np.concatenate([np.ones(base, "i8"), size])[seq.astype("i8")]
    before = (np.cumsum(wide) - wide)[::BLOCK]
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = [base, len(rules), len(seq), len(counts), width]
    body = [np.cumsum(counts).astype("<u8"), before.astype("<u8"), rules.astype("<u4"), size.astype("<u4"), seq.astype(f"<u{width}")]
    return np.array(head, "<u4").tobytes() + b"".join(x.tobytes() for x in body)


class Shard:
    """Random access to a packed shard; its parts are views of the bytes."""

    def __init__(self, data: bytes):
        self.base, r, s, d, width = (int(x) for x in np.frombuffer(data, "<u4", 5))
        place = 20

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(data, kind, n, place)
            place += out.nbytes
            return out

        self.ends, self.before = part("<u8", d), part("<u8", -(-s // BLOCK))
        self.rules, self.sizes = part("<u4", 2 * r).reshape(-1, 2), part("<u4", r)
        self.seq = part(f"<u{width}", s)
        self.length = np.concatenate([np.ones(self.base, "i8"), self.sizes])
        self.spelled = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends.astype("i8"), prepend=0)

    def _spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' expansions one after the other, and where each begins; rules name earlier symbols."""
        ids, made = np.arange(self.base, dtype="u4"), []
        of = lambda s: ids[s : s + 1] if s < self.base else made[s - self.base]
        for a, b in self.rules.tolist():
            made.append(np.concatenate([of(a), of(b)]))
        return np.concatenate([ids, *made]), np.cumsum(self.length) - self.length

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for."""
        if not len(symbols):
            return np.zeros(0, "u4")
        if self.spelled is None:
            self.spelled = self._spelled()
        table, first = self.spelled
        size = self.length[symbols]
        end = np.cumsum(size)
        return table[np.repeat(first[symbols] - end + size, size) + np.arange(end[-1])]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` .. ``stop - 1``, from the blocks of symbols that hold them."""
        stop = min(stop, int(self.ends[-1]) if len(self.ends) else 0)
        if stop <= start:
            return np.zeros(0, "<u4")
        a = int(np.searchsorted(self.before, start, "right")) - 1
        b = int(np.searchsorted(self.before, stop - 1, "right"))
        symbols = self.seq[a * BLOCK : b * BLOCK].astype("i8")
        ends = int(self.before[a]) + np.cumsum(self.length[symbols])
        i, j = np.searchsorted(ends, [start, stop - 1], "right").tolist()
        before = int(ends[i - 1]) if i else int(self.before[a])
        return self.expand(symbols[i : j + 1])[start - before : stop - before].astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tok=None, shard_ids: int = SHARD_IDS
) -> None:
    """Write the shards of all documents, in ascending doc_id order, under ``path``."""
    tok = tok or share_tokenizer(docs.sparkSession)
    order = ["doc_id", "_tie"]
    given = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("_text"),
        F.xxhash64(F.col(f"`{text}`")).alias("_tie"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held, counts, names, n = [], [], [], 0

        def shard():
            nonlocal seq
            row = [part], [seq], [names], [n], [pack(np.concatenate(held), np.array(counts))]
            seq += 1
            types = pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, types)], ["part", "seq", "doc_ids", "n_ids", "shard"]
            )

        for batch in batches:
            for piece in slices(batch, "_text", SLICE):
                ids, begin = encode(piece.column("_text"), speller(tok.value))
                for k, name in enumerate(piece.column("doc_id").to_pylist()):
                    own = np.append(ids[begin[k] : begin[k + 1]], np.uint32(END))
                    held.append(own)
                    counts.append(len(own))
                    names.append(name)
                    n += len(own)
                    if n >= shard_ids:
                        yield shard()
                        held, counts, names, n = [], [], [], 0
        if names:
            yield shard()

    dealt = given.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(
        run, "part bigint, seq bigint, doc_ids array<bigint>, n_ids bigint, shard binary"
    ).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, ``ids``.

    Where shards start is summed over the index columns alone.
    """
    table = spark.read.parquet(path)
    totals = running_totals(table.select("part", "seq", "n_ids"), [F.col("part"), F.col("seq")], ["n_ids"])
    starts = totals.select("part", "seq", (F.col("cum_n_ids") - F.col("n_ids")).alias("_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                shard = Shard(one.column("shard")[0].as_py())
                counts, ends = shard.counts, shard.ends.astype("i8")
                whole = shard.ids(0, int(ends[-1]))
                own = [whole[b - n : b].tobytes() for b, n in zip(ends, counts)]
                columns = [
                    one.column("doc_ids").flatten(),
                    pa.array(one.column("_start")[0].as_py() + ends - counts),
                    pa.array(counts),
                    pa.array([binascii.crc32(x) for x in own], pa.int64()),
                ]
                named = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array(own, pa.binary()))
                    named.append("ids")
                yield pa.RecordBatch.from_arrays(columns, named)

    out = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if ids else "")
    return table.join(starts, ["part", "seq"]).select("doc_ids", "shard", "_start").mapInArrow(run, out)
