"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of four words, edges the runs of five that join two of them, weighted by how
often they occur. Only edges, and at the end of a piece the shorter runs that have none, are
counted in the corpus. The count of a shorter phrase is the flow out of it: the weight of all
edges that begin with it, plus the runs that end there with it. So each length is summed
from the one above it, not from the texts.

A node whose whole flow takes one edge lies on an unary path and is merged into it: that is
how a phrase inside a longer one of the same count goes. As every phrase between the two
has that count as well, looking one word further is enough.

A phrase of the least count has pairs of the least count only, so edges with a rarer pair
are cut before they are shuffled. Pairs are counted in ``2 ** SLOT_BITS`` hashed slots; a
slot's total is never below that of its pairs, so the cut loses no phrase, whatever the
size of the corpus. Slots that reach the least count go to the tasks as a bitmap of fixed
size (``2 ** SLOT_BITS`` bits). A larger corpus fills more slots and cuts less; results
do not depend on it.

Texts are cut in chunks of ``CHUNK`` words that look ahead four words, so a text of any
length takes bounded memory. Counts are merged in a task before the shuffle, keyed by whole
phrases, so a frequent word or phrase is one row a task.

Defined cases: a null or empty text has no words; a null language counts as ``und``, with
rows of that name; a language without candidates has no rows; repeated rows count each
time; an empty table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from surcos.llm.words import slices
from surcos.sources.scratch import materialise

LONGEST = 5  # words of an edge
LEAST = 100
TOP = 2000
CHUNK = 1 << 18  # words counted together; a word's number in a chunk fits 21 bits
PART = 1 << 20  # bytes of texts that are cut into words together: a task holds many times as much
SLOT_BITS = 24
_BITS = 21
_CLASS = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2


class Words:
    """All words of a batch of texts in order, with the piece and the language of each."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        lower = pc.ascii_lower(pc.fill_null(texts, ""))
        width = np.int64 if pa.types.is_large_string(lower.type) else np.int32
        off = np.zeros(1, np.int64)
        if len(lower):
            off = np.frombuffer(lower.buffers()[1], width)[lower.offset : lower.offset + len(lower) + 1].astype(np.int64)
        data = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(lower) else np.zeros(0, np.uint8)
        off = off - off[0]
        kind = _CLASS[data]
        letter = kind == 0
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        first = off[:-1][np.diff(off) > 0]
        begins[first] = letter[first]
        self.start = np.flatnonzero(begins)
        doc = np.searchsorted(off, self.start, "right") - 1
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, self.start) + doc
        self.letters = data[letter]
        # Letters before each word: the words follow each other without gaps.
        inside = np.cumsum(letter)
        self.ends = np.append(inside[self.start] - 1, inside[-1] if len(inside) else 0).astype(np.int64)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[doc].astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def chunks(self, size: int = CHUNK) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, int]]:
        """(codes, dictionary, piece, lang, own): words from ``own`` on only complete the runs before them."""
        for a in range(0, len(self), size):
            own = min(size, len(self) - a)
            b = min(len(self), a + own + LONGEST - 1)
            at = self.ends[a : b + 1]
            data = pa.py_buffer(self.letters[at[0] : at[-1]])
            words = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(at - at[0]), data)
            coded = words.dictionary_encode()
            yield coded.indices.to_numpy().astype(np.int64), coded.dictionary, self.piece[a:b], self.lang[a:b], own


def _pair_slots(words: Words, codes, dictionary, lang, bits: int) -> np.ndarray:
    """The slot of each word and its successor in the chunk."""
    hashed = pd.util.hash_array(dictionary.to_numpy(zero_copy_only=False))[codes]
    tongue = pd.util.hash_array(words.langs.to_numpy(zero_copy_only=False))[lang[:-1]]
    mixed = (hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) + tongue
    mixed ^= mixed >> np.uint64(31)
    return (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _given(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        for part in slices(batch, "text", PART):
            yield Words(part.column("text"), part.column("lang"))


def frequent_slots(given: DataFrame, least: int, bits: int) -> np.ndarray:
    """A bitmap of the slots whose pairs occur ``least`` times or more together: 2 ** bits bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _read(batches):
            for codes, dictionary, piece, lang, own in words.chunks():
                joined = (piece[1:] == piece[:-1])[:own]
                slot, n = np.unique(_pair_slots(words, codes, dictionary, lang, bits)[:own][joined], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(n, pa.int64())], ["slot", "n"])

    counted = given.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # Slots count from 0, the function's values from 1; a bucket is 4 KB, so their number is fixed.
    value = F.col("slot") + 1
    maps = counted.groupBy(F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("map"))
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for row in maps.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        part = np.frombuffer(row["map"], np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def edges(given: DataFrame, least: int = LEAST, bits: int = SLOT_BITS) -> DataFrame:
    """(lang, run, f): runs of up to five words, each the longest from its first word, and how often.

    A run ends with its piece, after five words, or before a pair that is too rare. Runs Spark jobs.
    """
    shared = given.sparkSession.sparkContext.broadcast(frequent_slots(given, least, bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint8)
        for words in _read(batches):
            for codes, dictionary, piece, lang, own in words.chunks():
                slot = _pair_slots(words, codes, dictionary, lang, bits)
                follows = np.zeros(len(codes), bool)
                follows[:-1] = (piece[1:] == piece[:-1]) & (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0)
                after = [codes[:own] + 1]  # 0: no word
                going = np.ones(own, bool)
                for k in range(1, LONGEST):
                    step = np.zeros(own, bool)
                    step[: max(0, min(own, len(codes) - k))] = follows[k - 1 : k - 1 + own][: max(0, len(codes) - k)]
                    going &= step
                    next_ = np.zeros(own, np.int64)
                    next_[going] = codes[np.flatnonzero(going) + k] + 1
                    after.append(next_)
                a, b, c, d, e = after
                high = a << 2 * _BITS | b << _BITS | c
                low = lang[:own] << 2 * _BITS | d << _BITS | e
                order = np.lexsort((low, high))
                high, low = high[order], low[order]
                new = np.ones(own, bool)
                new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, own))
                high, low, mask = high[at], low[at], (1 << _BITS) - 1
                spelled = [
                    dictionary.take(pa.array(np.where(x > 0, x - 1, 0), mask=x == 0))
                    for x in (high >> 2 * _BITS, high >> _BITS & mask, high & mask, low >> _BITS & mask, low & mask)
                ]
                phrase = pc.binary_join_element_wise(*spelled, pa.scalar(" ", pa.large_string()), null_handling="skip")
                tongue = words.langs.take(pa.array(low >> 2 * _BITS))
                del spelled, after, a, b, c, d, e, order, high, low
                columns = [tongue.cast(pa.string()), phrase.cast(pa.string()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "run", "f"])

    found = given.mapInArrow(run, "lang string, run string, f bigint")
    return found.groupBy("lang", "run").agg(F.sum("f").alias("f"))


def _n_words(phrase: str):
    return F.size(F.split(F.col(phrase), " ", -1))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, bits: int = SLOT_BITS):
    """(phrases, totals): (lang, phrase, k, f) of all phrases of 1 to 5 words with f >= least, and (lang, n).

    Runs Spark jobs.
    """
    flow = materialise(edges(_given(docs, text, lang), least, bits).withColumn("k", _n_words("run")), "edges")
    # Every word begins exactly one run.
    totals = materialise(flow.groupBy("lang").agg(F.sum("f").alias("n")), "words")
    found = None
    for k in range(LONGEST, 0, -1):
        if k < LONGEST:
            # Flow through the first k words: longer runs that begin with them, and the runs that end there.
            begin = F.when(F.col("k") > k, F.substring_index("run", " ", k)).otherwise(F.col("run"))
            summed = flow.groupBy("lang", begin.alias("run")).agg(F.sum("f").alias("f"), F.least(F.max("k"), F.lit(k)).alias("k"))
            flow = materialise(summed.select("lang", "run", "f", "k"), "flow")
        own = flow.where((F.col("k") == k) & (F.col("f") >= least)).select("lang", F.col("run").alias("phrase"), "k", "f")
        found = own if found is None else found.unionByName(own)
    return materialise(found, "phrases"), totals


def compact(phrases: DataFrame) -> DataFrame:
    """Phrases of two words and more, without those whose whole flow lies on one longer phrase."""
    longer = phrases.where(F.col("k") > 2)
    inside = longer.select(
        "lang", "f", F.expr("explode(array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k)))").alias("phrase")
    )
    same = inside.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias("_f"))
    on = (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")) & (F.col("f") == F.col("_f"))
    return phrases.where(F.col("k") > 1).join(same, on, "left_anti")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", *, least: int = LEAST, top: int = TOP, bits: int = SLOT_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language. Runs Spark jobs.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its cut that scores
    lowest, ``score`` floor(1000 a n / (l r)) in exact decimals.
    """
    return ranked(*phrase_counts(docs, text, lang, least, bits), top)


def ranked(phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The scores of counted phrases, from the tables of :func:`phrase_counts`."""
    kept = compact(phrases).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    head, tail = F.expr("substring_index(phrase, ' ', cut)"), F.expr("substring_index(phrase, ' ', cut - k)")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "cut", head.alias("head"), tail.alias("tail"))
    side = lambda name, part: phrases.select(F.col("lang").alias(f"_{name}"), F.col("phrase").alias(part), F.col("f").alias(name))
    both = (
        cuts.join(side("l", "_head"), (F.col("lang") == F.col("_l")) & (F.col("head") == F.col("_head")))
        .join(side("r", "_tail"), (F.col("lang") == F.col("_r")) & (F.col("tail") == F.col("_tail")))
        .join(totals.select(F.col("lang").alias("_n"), "n"), F.col("lang") == F.col("_n"))
    )
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})")
    scored = both.select("lang", "phrase", "n", F.struct(score.alias("score"), "cut", "a", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "phrase", "n").agg(F.min("cut").alias("cut")).select("lang", "phrase", "n", "cut.score", "cut.a", "cut.l", "cut.r")
    place = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, top: int = TOP) -> str:
    return rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
    placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
    totals AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
    grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed, range(1, 6) AS ks(k) WHERE i + k - 1 <= len(w)),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
    dropped AS (
        SELECT DISTINCT s.lang, s.phrase FROM f AS s JOIN f AS g ON g.lang = s.lang AND g.k > s.k AND 100 * g.f >= 100 * s.f
            AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') WHERE s.k > 1),
    cuts AS (
        SELECT f.*, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w
        FROM f ANTI JOIN dropped USING (lang, phrase) WHERE k > 1),
    scored AS (
        SELECT c.lang, c.phrase, c.cut, c.f AS a, l.f AS l, r.f AS r, n,
               ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM cuts AS c JOIN totals USING (lang)
        JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.cut], ' ')
        JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
    FROM best QUALIFY rank <= {top}
    """
