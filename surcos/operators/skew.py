"""Joins that stay balanced when a few keys hold most of the rows.

Where both inputs of a join come straight from a shuffle and the result is shuffled
anew or written, adaptive execution splits a partition that one key has swollen, and
the operators leave it to that. It cannot when an input is already partitioned by the
key from an earlier join, nor when the side to keep is the other one. The functions
here cover these two cases. Only physical placement changes, never the result.

A key that is hot on one side is dealt out by salt, and the other side's few rows are
repeated. A key that is hot on both is dealt out over a grid of cells: the rows of each side
go to one line of cells along their own axis and are repeated along the other's only. Salts
come from the content of rows, so only exact repeats of a row stay together.

Where the pairs themselves are the result, rows may go through the grid in packs. Few bytes are
shuffled then, and the pairs of two packs come out one after the other, in which order a column
repeats itself within a page of a file and takes a tenth of the bytes or less.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surcos.session import shuffle_width

SKETCH = 10  # counters of the sketch for each key that it may report
MAX_SKETCH = 1_000_000  # counters that a frequent-items sketch may have
_SALT, _SIDE = "_salt", "_salt_side"
_CELL, _ACROSS = ("_cell_row", "_cell_col"), ("_across_row", "_across_col")
_PACK = ("_pack_left", "_pack_right")
PACK = 256  # rows of a pack; a multiple of 8, the values that a file packs to whole bytes
GATHER = 1 << 12  # rows, about, that are gathered at once to be cut into packs
REPEATS = 1 << 16  # repeats of a row that are numbered at once
PAIRS = 1 << 28  # pairs of hot keys, about, that one task makes


class KeyProfile(NamedTuple):
    """What one scan tells about a key: ``hot`` maps keys to their rows, None among them."""

    hot: dict
    keys: int
    rows: int


def profile_key(df: DataFrame, key: str, least: int = 0) -> KeyProfile:
    """Hot keys, about how many different keys there are, and the number of rows.

    Hot are keys with more rows than an average shuffle partition, and than ``least``: fewer
    values than the shuffle is wide. A frequent-items sketch finds them in one narrow scan.
    None is among them when that many rows have no key. Runs a Spark job.
    """
    width = shuffle_width(df.sparkSession)
    counters = min(MAX_SKETCH, max(10_000, SKETCH * (width + 1)))
    top, keys, keyed, total = df.agg(
        F.expr(f"approx_top_k(`{key}`, {min(width + 1, counters)}, {counters})"),
        F.approx_count_distinct(key), F.count(key), F.count("*"),
    ).first()
    bound = max(total / width, least)
    hot = {t["item"]: t["count"] for t in top or [] if t["item"] is not None and t["count"] > bound}
    return KeyProfile(hot | ({None: total - keyed} if total - keyed > bound else {}), keys, total)


def hot_keys(df: DataFrame, key: str, least: int = 0) -> list:
    """The hot keys of :func:`profile_key`. Runs a Spark job."""
    return list(profile_key(df, key, least).hot)


def salt(facts: DataFrame, key: str, hot: list) -> DataFrame:
    """Give the rows of hot keys one of as many numbers as the shuffle is wide.

    The number comes from the content of the row, so it spreads a key however the table
    is laid out and is the same when a task is repeated. Rows with a null key match
    nothing, so any salt is right for them. Salt a table before joining it to others:
    filters on their columns then still reach them.
    """
    if not hot:
        return facts
    ways = shuffle_width(facts.sparkSession)
    spread = F.col(key).isin([k for k in hot if k is not None]) | F.col(key).isNull()
    number = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(ways)).cast("int")
    return facts.withColumn(_SALT, F.when(spread, number).otherwise(0))


def salted_join(
    facts: DataFrame, side: DataFrame, key: str, side_key: str, how: str, hot: list
) -> DataFrame:
    """Equi-join (inner, left, left_semi or left_anti) of facts that went through :func:`salt`.

    Rows of a hot key are dealt out over all reducers, and the matching rows of
    ``side``, which should be few per key, are repeated per salt value. Without hot
    keys this is the plain join. Column names must not clash.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the fact side must be the preserved one: inner, left, left_semi or left_anti")
    same = F.col(key) == F.col(side_key)
    if not hot:
        return facts.join(side, same, how)
    ways = shuffle_width(facts.sparkSession)
    keys = [k for k in hot if k is not None]
    copies = F.when(F.col(side_key).isin(keys), F.sequence(F.lit(0), F.lit(ways - 1)))
    right = side.withColumn(_SIDE, F.explode(F.coalesce(copies, F.array(F.lit(0)))))
    return facts.join(right, same & (F.col(_SALT) == F.col(_SIDE)), how).drop(_SALT, _SIDE)


def grid_cells(left: dict, right: dict, width: int) -> dict:
    """key -> (rows, columns) of its grid, from the row counts of the hot keys of both sides.

    A grid has about as many cells as the shuffle is wide. Its sides are powers of two in the
    ratio of the counts, which keeps the repeated rows fewest; a key that is hot on one side
    only has a single line. Rows without a key match nothing and have no grid.
    """
    cells = 1 << max(0, math.ceil(math.log2(max(1, width))))
    out = {}
    for key in (left.keys() | right.keys()) - {None}:
        a, b = left.get(key), right.get(key)
        if a and b:
            rows = 1 << round(math.log2(math.sqrt(cells * a / b))) if cells * a > b else 1
            rows = min(rows, cells)
        else:
            rows = cells if a else 1
        out[key] = rows, cells // rows
    return out


def pair_tasks(left: KeyProfile, right: KeyProfile, width: int) -> int:
    """How many tasks the pairs of hot keys are for: ``width``, or more where these had over ``PAIRS`` each."""
    pairs = sum(n * right.hot.get(k, 0) for k, n in left.hot.items() if k is not None)
    return max(width, math.ceil(pairs / PAIRS))


def _parts(key: str, cells: dict, axis: int) -> Column:
    """How many parts the key has on an axis; the literals are grouped by that number."""
    by_size: dict[int, list] = {}
    for k, sides in cells.items():
        if sides[axis] > 1:
            by_size.setdefault(sides[axis], []).append(k)
    out = F.lit(1)
    for size, keys in by_size.items():
        out = F.when(F.col(key).isin(keys), size).otherwise(out)
    return out


def deal(df: DataFrame, key: str, cells: dict, axis: int) -> DataFrame:
    """Number the rows along their own axis (0: left, 1: right) by their content.

    Do so before joining the table to others: filters on their columns then still reach it.
    """
    if not cells:
        return df
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn(_CELL[axis], F.pmod(content, _parts(key, cells, axis)).cast("int"))


def pack(df: DataFrame, key: str, cells: dict, axis: int, profile: KeyProfile) -> DataFrame:
    """Gather rows that went through :func:`deal` to packs of at most ``PACK`` rows of a key and line.

    ``profile`` is that of the key. Exact repeats of a row are numbered, so that they are
    spread like others and what is gathered at once stays bounded. Rows without a key, which
    match nothing, are left out. All columns must be such as can be grouped.
    """
    own = [c for c in df.columns if c == _CELL[axis]]
    kept = [c for c in df.columns if c not in (key, *own)]
    counted = df.where(F.col(f"`{key}`").isNotNull()).groupBy(*[F.col(f"`{c}`") for c in df.columns])
    some = counted.agg(F.count("*").alias("_n")).withColumn(
        "_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(REPEATS))))
    upto = F.least(F.col("_from") + REPEATS, F.col("_n")) - 1
    numbered = some.withColumn("_at", F.explode(F.sequence(F.col("_from"), upto)))

    lines = [n / cells[k][axis] for k, n in profile.hot.items() if k in cells]
    most = max([profile.rows / shuffle_width(df.sparkSession), *lines])
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in kept], "_at"), F.lit(math.ceil(most / GATHER) or 1))
    gathered = numbered.groupBy(F.col(f"`{key}`"), *own, part.alias("_part")).agg(
        F.collect_list(F.struct(*[F.col(f"`{c}`") for c in kept])).alias("_all"))
    starts = F.sequence(F.lit(1), F.size("_all"), F.lit(PACK))
    packs = F.transform(starts, lambda at: F.slice("_all", at, PACK))
    return gathered.select(F.col(f"`{key}`"), *own, F.explode(packs).alias(_PACK[axis]))


def unpack(joined: DataFrame, *keys: str) -> DataFrame:
    """The pairs of rows of a :func:`grid_join` of packs: the keys, the left columns, the right ones."""
    one = joined.select(*keys, F.explode(_PACK[0]).alias("_left"), _PACK[1])
    return one.select(*keys, "_left", F.explode(_PACK[1]).alias("_right")).select(*keys, "_left.*", "_right.*")


def grid_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, cells: dict, tasks: int | None = None
) -> DataFrame:
    """Inner join of two sides that went through :func:`deal`, whose keys may be hot on both.

    Every pair of rows meets in one cell. Without cells this is the plain join. The cells are
    dealt out over ``tasks`` if that is given, for a result that is far larger than the sides:
    by the bytes of these, adaptive execution would merge the cells to a few tasks, or the
    smaller side would be broadcast to the few tasks that the other was read in.
    """
    same = F.col(left_key) == F.col(right_key)
    if not cells:
        return left.join(right, same)
    repeat = lambda df, key, axis: df.withColumn(
        _ACROSS[axis], F.explode(F.sequence(F.lit(0), _parts(key, cells, axis) - 1)))
    meet = [F.col(own) == F.col(other) for own, other in zip(_CELL, _ACROSS)]
    left, right = repeat(left, left_key, 1), repeat(right, right_key, 0)
    if tasks:
        left = left.repartition(tasks, left_key, _CELL[0], _ACROSS[1])
        right = right.repartition(tasks, right_key, _ACROSS[0], _CELL[1])
    return left.join(right, same & meet[0] & meet[1]).drop(*_CELL, *_ACROSS)


def keep_right_join(
    facts: DataFrame, kept: DataFrame, key: str, kept_key: str, hot: list | None = None
) -> DataFrame:
    """Right outer join: every row of ``kept``, with nulls where no fact matches.

    A right join pins all facts of a key to one task, because a split part cannot
    tell whether another part matched. If there are hot keys, the matched rows come
    from an inner join, which can be split, and the unmatched ones from an anti join
    against the distinct fact keys, which are reduced before they are shuffled; keys that
    are hot among the kept rows are salted there. Runs one or two Spark jobs.
    """
    hot = hot_keys(facts, key) if hot is None else hot
    if not hot:
        return facts.join(kept, F.col(key) == F.col(kept_key), "right")
    matched = facts.join(kept, F.col(key) == F.col(kept_key))
    keys = facts.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct()
    # Rows without a key match nothing; joined, they would all meet in one task.
    many = [k for k in hot_keys(kept, kept_key) if k is not None]
    keyed = salted_join(salt(kept.where(F.col(kept_key).isNotNull()), kept_key, many), keys, kept_key, "_key", "left_anti", many)
    alone = keyed.unionByName(kept.where(F.col(kept_key).isNull()))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema]
    return matched.unionByName(alone.select(*blank, *kept.columns))
