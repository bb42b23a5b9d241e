"""Byte-level BPE with a local rank file: text to token ids and back.

The rank file is read on the driver and broadcast (below 1 MB for 50,000 ranks, checked
against ``MAX_RANK_BYTES``); tasks need no file. Ids travel as little-endian unsigned
32-bit integers in a binary column.

Long texts are encoded in pieces. A piece may only begin at a blank that stands between
two plain letters: no match of the pattern holds a letter followed by a blank, so the
matches, and with them the ids, are those of the whole text. Long runs of white space, on
which the library's backtracking overflows, are taken out before it sees them: by the
pattern such a run is one match up to its last character, at the end of the text as a whole.

Defined cases: a null text is an empty one; an empty text has no ids and decodes to no
bytes; a text without any safe boundary is encoded whole, but for its runs of white space of
``RUN`` characters and more; repeated rows are encoded alike.
Columns to keep come back inside the struct ``doc``, so their names cannot clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surcos.llm.words import slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECE = 1 << 16  # characters after which the next safe boundary ends a piece
MAX_RANK_BYTES = 64 << 20
RUN = 1 << 12  # characters of white space that are encoded without the pattern
# What the pattern's library takes for white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"(?<![{WHITE}])[{WHITE}]{{{RUN},}}")
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


@lru_cache(maxsize=2)
def encoding(content: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file's content; built once per Python worker."""
    ranks = {}
    for line in content.splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(content: bytes) -> pa.Array:
    """The bytes of every id, by id."""
    ranks = encoding(content)._mergeable_ranks
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def share_ranks(spark: SparkSession, path: str = RANKS):
    with open(path, "rb") as f:
        content = f.read(MAX_RANK_BYTES + 1)
    if len(content) > MAX_RANK_BYTES:
        raise ValueError(f"rank file {path} is larger than {MAX_RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(content)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut a text at safe boundaries into pieces of at least ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _ids(text: str, enc: tiktoken.Encoding) -> list[np.ndarray]:
    return [np.array(enc.encode_ordinary(p), "<u4") for p in (pieces(text) if len(text) > PIECE else [text])]


def ids_of(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    if len(text) < RUN:
        return np.array(enc.encode_ordinary(text), "<u4")
    out, start = [], 0
    for run in _LONG_RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        out += _ids(text[start : run.start()], enc)
        out.append(np.array(enc._encode_single_piece(text[run.start() : stop]), "<u4"))
        start = stop
    return np.concatenate([*out, *_ids(text[start:], enc)])


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks=None) -> DataFrame:
    """``doc``, ``n_tokens`` and ``ids`` for every row."""
    ranks = ranks or share_ranks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                ids = [ids_of(t or "", enc) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([i.tobytes() for i in ids], pa.binary()),
                    ],
                    ["doc", "n_tokens", "ids"],
                )

    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text}`").alias("_text")
    )
    doc = given.schema["doc"].dataType.simpleString()
    return given.mapInArrow(run, f"doc {doc}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks=None) -> DataFrame:
    """Add ``decoded``, the raw bytes of ``ids``; any sequence of ids has some."""
    ranks = ranks or share_ranks(encoded.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks.value)
        for batch in batches:
            for part in slices(batch, "ids"):
                raw = [np.frombuffer(i or b"", "<u4") for i in part.column("ids").to_pylist()]
                spelled = table.take(pa.array(np.concatenate([*raw, np.empty(0, "<u4")])))
                ends = np.frombuffer(spelled.buffers()[1], "<i8")[: len(spelled) + 1] if len(spelled) else np.zeros(1, "i8")
                data = spelled.buffers()[2].to_pybytes() if len(spelled) else b""
                at = ends[np.cumsum([0, *map(len, raw)])]
                out = pa.array([data[a:b] for a, b in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{fields}, decoded binary")
