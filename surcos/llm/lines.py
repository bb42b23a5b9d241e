"""Repeated lines across documents: keep bitmaps for the first document that holds each.

Occurrences are rows of (hash of the line, document, position), without text. They are
range-partitioned by hash and sorted inside each range by document and position, and a
running window streams over a range to find the first document of every line. A line that
fills more than an average range is split over ranges by a salt from its documents; its
firsts, one a salt, are merged afterwards. So one line may hold a third of all rows.

The result is one bitmap a document, run-length compressed: the runs of dropped lines as
(start, length), in order. Documents without a dropped line have no row. Text is read again
only where bitmaps are applied.

Keys are 128-bit: two 64-bit hashes of the stripped line with A-Z in lower case. Defined
cases: a null text is one empty line; lines whose key is shorter than the least length are
never dropped; rows that share an id count as one document, and rows without an id as one
with the largest id; equal rows share their bitmap; an empty table gives none. Columns of
the table come back in the struct ``doc``, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from surcos.operators.skew import hot_keys
from surcos.session import shuffle_width
from surcos.sources.scratch import materialise

LEAST_CHARS = 10
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(_BLANK))
    # On plain ASCII the fast general lower() is the same as the translation of A-Z.
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _row_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, id, row, pos) of every line that is long enough to be dropped."""
    each = docs.select(
        F.col(f"`{key}`").alias("id"), _row_key(text).alias("row"), F.posexplode(lines(F.col(f"`{text}`"))).alias("pos", "line")
    ).select("id", "row", "pos", line_key(F.col("line")).alias("line"))
    long = each.where(F.char_length("line") >= least)
    return long.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "id", "row", "pos")


def _first(column: str) -> Column:
    """Ids in ascending order, rows without one last."""
    return F.struct(F.col(column).isNull().alias("none"), F.col(column).alias("id"))


def dropped(rows: DataFrame) -> DataFrame:
    """(id, row, pos) of the lines that a document with a smaller id holds too. Runs Spark jobs."""
    spark = rows.sparkSession
    written = materialise(rows, "line-occurrences")
    width, hot = shuffle_width(spark), hot_keys(written, "h1")
    placed, by = written.withColumn("who", _first("id")), ["h1"]
    if hot:
        salt = F.pmod(F.xxhash64("id", "row"), F.lit(width)).cast("int")
        placed, by = placed.withColumn("salt", F.when(F.col("h1").isin(hot), salt).otherwise(0)), ["h1", "salt"]
    # The window needs no other shuffle and no other sort than this one.
    ranged = placed.repartitionByRange(width, *by).sortWithinPartitions(*by, "h2", "who", "row", "pos")
    streamed = W.partitionBy(*by, "h2").orderBy("who", "row", "pos").rowsBetween(W.unboundedPreceding, 0)
    seen = ranged.withColumn("first", F.first("who").over(streamed))
    if hot:
        seen = materialise(seen.select("h1", "h2", "id", "row", "pos", "who", "first"), "line-firsts")
        # Fewer hot hashes than the shuffle is wide, and after the partial minimum as many firsts a task at most.
        firsts = seen.where(F.col("h1").isin(hot)).groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min("first").alias("least"))
        firsts = materialise(firsts, "hot-firsts")
        seen = seen.join(firsts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left").withColumn("first", F.coalesce("least", "first"))
    return seen.where("first < who").select("id", "row", "pos")


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(id, row, n_dropped, dropped_runs) of every document that loses lines.

    ``row`` is a hash of the text, which tells rows with the same id apart.
    """
    per = dropped(occurrences(docs, key, text, least)).groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    before, after = (lambda i: F.get("at", i - 1)), (lambda i: F.get("at", i + 1))
    starts = F.filter("at", lambda p, i: F.coalesce(before(i), F.lit(-2)) != p - 1)
    stops = F.filter("at", lambda p, i: F.coalesce(after(i), F.lit(-2)) != p + 1)
    runs = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))
    return per.select("id", "row", F.size("at").cast("long").alias("n_dropped"), runs.alias("dropped_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``n_lines``, ``n_dropped`` and ``kept``, the text without its dropped lines, for every row."""
    given = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
                        F.col(f"`{key}`").alias("_id"), _row_key(text).alias("_row"))
    # Written first: a side fresh from a shuffle is one that adaptive execution can split.
    side = materialise(bitmaps, "keep-bitmaps").withColumnsRenamed({"id": "_own", "row": "_own_row"})
    both = given.join(side, F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_row") == F.col("_own_row")), "left")
    split = F.split("_text", "\n", -1)
    gone = F.flatten(F.transform("dropped_runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    # Both steps are linear in the lines, however many runs there are.
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    return both.select(
        "doc", F.size(split).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped_runs").isNull(), F.col("_text")).otherwise(kept).alias("kept"),
    )


def sql(least: int = LEAST_CHARS) -> str:
    return rf"""
    WITH each AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
        FROM each),
    firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= {least} GROUP BY k),
    judged AS (SELECT keyed.*, coalesce(first_id < doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """
