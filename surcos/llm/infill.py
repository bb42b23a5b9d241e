"""Fill-in-the-middle: a text cut in three at token boundaries and put in another order.

A token is a run of plain letters or any other single character. One full match of a
repeated capture keeps the end of every repetition, so ``match.ends(1)`` gives the number
of tokens and both cut offsets. The quantifiers are possessive, so nothing is kept for going
back. Texts beyond ``STRETCH`` characters are matched in stretches that end after a
character that is no letter, which is always the end of a token; ends are packed integers.

The draws come from the sha256 of a seed and the key, so a row is treated alike on every run
and layout. Only the text goes to Python and only three numbers come back; outputs are put
together in the JVM.

Defined cases: a null text is an empty one; an empty text and one that holds a marker stay
plain; a null key counts as an empty one; repeated rows get equal outputs; an empty table
gives none. Columns of the table come back in the struct ``doc``, so names cannot clash.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
_STOP = regex.compile(r"[^A-Za-z]")
STRETCH = 1 << 20  # characters after which the next end of a token may end a stretch
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT = 10  # texts left as they are
SPM_PERCENT = 20  # of the rest, texts with the suffix in front


def unit_ends(text: str, stretch: int = STRETCH) -> array:
    """The end offsets of all tokens of a text."""
    if len(text) <= stretch:
        return array("q", UNITS.fullmatch(text).ends(1))
    ends, start = array("q"), 0
    while start < len(text):
        stop = _STOP.search(text, start + stretch - 1) if len(text) - start > stretch else None
        end = stop.end() if stop else len(text)
        ends.extend(UNITS.fullmatch(text, start, end).ends(1))
        start = end
    return ends


def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Tokens of each text, and the offsets after ``first % (n + 1)`` and ``second % (n + 1)`` of them, in order."""
    n, low, high = [], [], []
    for text, a, b in zip(texts, first.to_pylist(), second.to_pylist()):
        ends = unit_ends(text.as_py() or "")
        k = len(ends)
        i, j = sorted((a % (k + 1), b % (k + 1)))
        n.append(k)
        low.append(ends[i - 1] if i else 0)
        high.append(ends[j - 1] if j else 0)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, low, high)], ["n", "low", "high"])


def draws(key: str, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 for each key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infill(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    seed: int = 1,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """``doc``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` for every row.

    Forms: ``plain`` (the text), ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix,
    middle), each part after its marker. Lengths are in code points, null if plain.
    """
    given = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
                        F.array(*draws(key, seed)).alias("_h"))
    h = lambda i: F.get("_h", F.lit(i))
    cuts = F.arrow_udf(_cuts, "n bigint, low bigint, high bigint")
    cut = given.withColumn("_cut", cuts("_text", h(0), h(1)))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("_text", F.lit(marker))
    plain = (F.col("_text") == "") | marked | (h(2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h(3) % 100 < spm_percent, "spm").otherwise("psm")
    low, high = F.col("_cut.low").cast("int"), F.col("_cut.high").cast("int")
    part = lambda start, length: F.substring(F.col("_text"), start, length)
    prefix = F.concat(F.lit(PREFIX), part(F.lit(1), low))
    suffix = F.concat(F.lit(SUFFIX), part(high + 1, F.char_length("_text") - high))
    middle = F.concat(F.lit(MIDDLE), part(low + 1, high - low))
    cut = cut.withColumn("form", form)
    moved = F.col("form") != "plain"
    return cut.select(
        "doc", F.col("_cut.n").alias("n"), "form",
        F.when(moved, F.col("_cut.low")).alias("prefix_chars"),
        F.when(moved, F.col("_cut.high") - F.col("_cut.low")).alias("middle_chars"),
        F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle))
        .when(F.col("form") == "spm", F.concat(suffix, prefix, middle))
        .otherwise(F.col("_text")).alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from output and form alone.

    A text with a marker stays plain, and no marker can begin inside another, so the first
    place of each is where it was put.
    """
    out = F.col(output)
    after = lambda marker: F.locate(marker, out)
    between = lambda a, b: F.substring(out, after(a) + 3, after(b) - after(a) - 3)
    rest = F.substring(out, after(MIDDLE) + 3, F.char_length(out))
    psm = F.concat(between(PREFIX, SUFFIX), rest, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), rest, between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def sql() -> str:
    return r"""
    WITH cut AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS h,
               regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
        FROM documents),
    drawn AS (
        SELECT doc_id, t, u, len(u) AS n,
               ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                         OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM cut),
    parts AS (
        SELECT *, array_to_string(u[:least(c1, c2)], '') AS p,
               array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
               array_to_string(u[greatest(c1, c2) + 1:], '') AS s
        FROM drawn)
    SELECT doc_id, n, form,
           CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts
    """
