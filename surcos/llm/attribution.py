"""Token counts of a document's sections, by the character spans of its tokens.

Every document is encoded once and whole. The bytes of the ids add up to the text, so
running sums of their lengths give each token's span, in bytes and then in characters.
Tokens are joined to the sections they meet; both run in order, and the join is a
binary search. A token that crosses a boundary goes by rule to one section:

* ``most``: the section with most of its characters, the earlier one of equals,
* ``first``: the section of its first character,
* ``last``: the section of its last character.

So the counts of the sections add up to the tokens of the document. A token that holds
only part of a character has the span of that character.

Sections are lines, each with its line feed, or given per row as an array of (start, end)
character spans, in order and without overlap; what lies outside of all of them is
counted as section -1 with null ends.

Defined cases: a null or empty text has one empty section 0 with no tokens; given spans
beyond the text are cut to it; a null array is an empty one; a null span, or one without a
start or an end, is an empty one, which has no tokens and null ends; repeated rows are counted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surcos.llm.bpe import encoding, ids_of, share_ranks, token_bytes
from surcos.llm.words import slices

RULES = ("most", "first", "last")


def line_starts(text: bytes) -> np.ndarray:
    """Byte places where lines begin; a line feed at the very end begins none."""
    feeds = np.flatnonzero(np.frombuffer(text, "u1") == 10) + 1
    return np.concatenate([[0], feeds[feeds < len(text)]])


def allocate(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """For tokens [start, end) the section each goes to; section k is [edges[k], edges[k + 1])."""
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, np.maximum(ends - 1, starts), "right") - 1
    if rule == "first":
        return first
    if rule == "last":
        return last
    chosen = first.copy()
    for t in np.flatnonzero(first != last):
        inside = np.arange(first[t], last[t] + 1)
        held = np.minimum(edges[inside + 1], ends[t]) - np.maximum(edges[inside], starts[t])
        chosen[t] = inside[np.argmax(held)]
    return chosen


def count(text: str, ids: np.ndarray, lengths: np.ndarray, spans, rule: str):
    """Rows (section, start, end, tokens) of one document."""
    raw = text.encode()
    whole = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "u1") & 0xC0 != 0x80)])
    if not raw:
        return [(0, 0, 0, 0)]
    stop = np.cumsum(lengths[ids])
    begin = stop - lengths[ids]
    # A continuation byte belongs to the character that began before it.
    starts, ends = whole[begin + 1] - 1, whole[stop]
    n = int(whole[-1])
    if spans is None:
        inner = whole[line_starts(raw)]
        edges = np.concatenate([inner, [n]])
        names = np.arange(len(inner))
    else:
        cuts, names = [0], []
        for k, (a, b) in enumerate(spans):
            a, b = max(cuts[-1], min(a, n)), min(b, n)
            if a > cuts[-1]:
                cuts.append(a)
                names.append(-1)
            if b > a:
                cuts.append(b)
                names.append(k)
        if cuts[-1] < n:
            cuts.append(n)
            names.append(-1)
        edges, names = np.array(cuts), np.array(names)
    tokens = np.bincount(allocate(starts, ends, edges, rule), minlength=len(names))
    if spans is None:
        return list(zip(names.tolist(), edges[:-1].tolist(), edges[1:].tolist(), tokens.tolist()))
    rows = [
        (k, int(edges[i]), int(edges[i + 1]), int(tokens[i])) for i, k in enumerate(names.tolist()) if k >= 0
    ]
    named = {k for k, *_ in rows}
    rows += [(k, None, None, 0) for k in range(len(spans)) if k not in named]
    outside = int(tokens[names == -1].sum())
    return sorted(rows) + ([(-1, None, None, outside)] if outside else [])


def _span(s: dict | None) -> tuple[int, int]:
    return (0, 0) if s is None or None in (s["start"], s["end"]) else (s["start"], s["end"])


def section_tokens(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: str | None = None,
    rule: str = "most", ranks=None,
) -> DataFrame:
    """``doc``, ``section``, ``start``, ``end`` and ``n_tokens``: one row per section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = ranks or share_ranks(docs.sparkSession)
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
        F.col(f"`{text}`").alias("_text"),
        (F.coalesce(F.col(f"`{spans}`"), F.array().cast("array<struct<start:int,end:int>>")) if spans else none).alias("_spans"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        lengths = pc.binary_length(token_bytes(ranks.value)).to_numpy()
        for batch in batches:
            for part in slices(batch, "_text"):
                rows, of = [], []
                listed = part.column("_spans").to_pylist()
                for i, t in enumerate(part.column("_text").to_pylist()):
                    own = listed[i] if listed[i] is None else list(map(_span, listed[i]))
                    found = count(t or "", ids_of(t or "", enc), lengths, own, rule)
                    rows += found
                    of += [i] * len(found)
                made = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(of, pa.int32())), *made],
                    ["doc", "section", "start", "end", "n_tokens"],
                )

    doc = given.schema["doc"].dataType.simpleString()
    return given.mapInArrow(run, f"doc {doc}, section bigint, start bigint, end bigint, n_tokens bigint")
