"""Quantiles: exact ones by distributed selection, and summaries per key that are stored and merged."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from surcos.operators.clean import quoted
from surcos.sources.scratch import materialise, release

ACCURACY = 10_000  # of the sketches: their ranks are off by 1 / ACCURACY of the rows
GATHERED = 50_000  # rows around the wanted places that are put in order on the driver
POINTS = 256  # cells of a summary
STATE = "n bigint, error double, points array<double>"  # what a summary consists of


class _Place:
    """The search for the value at a place: rows up to ``low`` and from ``high`` on are known."""

    def __init__(self, place: int):
        self.place = place
        self.low, self.high = -math.inf, math.inf
        self.below, self.inside = 0, 0  # rows before the open range, and in it
        self.value: float | None = None

    def within(self, v: Column) -> Column:
        return (v > self.low) & (v < self.high)

    def narrow(self, a: float, b: float, counts: Sequence[int]) -> None:
        """Use what lies under, up to ``a``, under and up to ``b`` within the range."""
        at = self.place - self.below
        under_a, upto_a, under_b, upto_b = counts
        if under_a <= at < upto_a:
            self.value = a
        elif under_b <= at < upto_b:
            self.value = b
        elif at < under_a:
            self.high, self.inside = a, under_a
        elif at >= upto_b:
            self.low, self.below, self.inside = b, self.below + upto_b, self.inside - upto_b
        else:
            self.low, self.high, self.below, self.inside = a, b, self.below + upto_a, under_b - upto_a


def _select(values: DataFrame, n: int, places: Sequence[int]) -> dict[int, float]:
    """The values at the given places, from 0, of the ``n`` rows of the one column ``v`` in order.

    A round takes from a sketch two values around each place and counts the rows under and
    over them, so the range that is left shrinks to some 6 / ``ACCURACY`` of it, ties apart.
    The counts are exact, and a place outside of its two values goes on in the outer range.
    """
    v = F.col("v")
    todo = [_Place(p) for p in sorted(set(places))]
    # Infinite values end the open ranges, so they are counted first.
    ends = values.agg(F.count_if(v == -math.inf), F.count_if(v == math.inf)).first()
    for t in todo:
        if t.place < ends[0]:
            t.value = -math.inf
        elif t.place >= n - ends[1]:
            t.value = math.inf
        t.below, t.inside = ends[0], n - ends[0] - ends[1]
    found, rows, written = list(todo), values, None
    while todo := [t for t in found if t.value is None]:
        if sum(t.inside for t in todo) <= GATHERED:
            wanted = [t.within(v) for t in todo]
            held = rows.where(_any(wanted)).groupBy("v").agg(F.count("*").alias("n")).collect()
            for t in todo:
                at = t.place - t.below
                for value, count in sorted((r["v"], r["n"]) for r in held if t.low < r["v"] < t.high):
                    if at < count:
                        t.value = value
                        break
                    at -= count
            break
        near = []
        for t in todo:
            share = (t.place - t.below) / max(1, t.inside - 1)
            both = [max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)]
            near.append(F.percentile_approx(F.when(t.within(v), v), both, ACCURACY))
        cuts = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(near)]).first()
        counts = []
        for i, t in enumerate(todo):
            a, b = cuts[i]
            counts += [F.count_if(t.within(v) & test) for test in (v < a, v <= a, v < b, v <= b)]
        counted = rows.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]).first()
        for i, t in enumerate(todo):
            t.narrow(*cuts[i], counted[4 * i : 4 * i + 4])
        left = [t for t in todo if t.value is None]
        if left and sum(t.inside for t in left) > GATHERED:
            smaller = materialise(rows.where(_any([t.within(v) for t in left])), "selection")
            if written is not None:
                release(written)
            rows = written = smaller
    if written is not None:
        release(written)
    return {t.place: t.value for t in found}


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def quartiles_exact(
    df: DataFrame, column: str, probabilities: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """(p, value): exact interpolated quantiles of a numeric column of any size.

    Nothing is sorted or shuffled: sketches and counts, merged in the tasks, narrow the range
    around each place until few rows are left, which are gathered (``GATHERED``). Nulls are
    left out and NaN counts as greater than any number. Without values every quantile is
    null. Runs Spark jobs, and reads the column about three times.
    """
    values = df.select(F.col(quoted(column)).cast("double").alias("v")).where("v IS NOT NULL")
    n, nan = values.agg(F.count("*"), F.count_if(F.isnan("v"))).first()
    at = {float(p): float(p) * (n - 1) for p in probabilities}
    found = {}
    if n:
        wanted = {f(x) for x in at.values() for f in (math.floor, math.ceil)}
        numbers = [p for p in wanted if p < n - nan]
        found = _select(values.where(~F.isnan("v")), n - nan, numbers) if numbers else {}

    def value(x: float) -> float | None:
        if not n:
            return None
        low, high = (found.get(f(x), math.nan) for f in (math.floor, math.ceil))
        return low if low == high else low + (high - low) * (x - math.floor(x))

    rows = [(p, value(x)) for p, x in at.items()]
    return df.sparkSession.createDataFrame(rows, "p double, value double")


def quantile_states(df: DataFrame, keys: Sequence[str], column: str, points: int = POINTS) -> DataFrame:
    """Per combination of keys a summary of the values of ``column``: ``STATE``.

    ``points`` holds the values at 0, 1/points, ..., 1 of the ``n`` rows, each with its rank off
    by at most ``error`` rows. Rows of a hot key are merged before the shuffle. Nulls and
    NaN are left out; a key with nothing else has no summary.
    """
    shares = [i / points for i in range(points + 1)]
    v = F.col(quoted(column)).cast("double")
    rows = df.select(*keys, v.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.count("*") / ACCURACY + 1).alias("error"),
        F.percentile_approx("_v", shares, ACCURACY).alias("points"),
    )


def merge_quantile_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of the rows of all ``states`` that share the keys, as many points as they have.

    A cell of a summary stands for its rows by the value at its end. The cells of all
    summaries are put in order per key, and the values at even places are the new points.
    The errors add up, each with a cell of its summary; merged summaries may be merged again.
    """
    points = F.size("points") - 1
    cells = states.select(*keys, "n", F.posexplode("points").alias("_i", "_v"), points.alias("_points")).select(
        *keys, "_v", "_points",
        F.when(F.col("_i") > 0, F.expr("_i * n DIV _points - (_i - 1) * n DIV _points")).otherwise(F.lit(0)).alias("_w"),
    )
    weighed = cells.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"), F.max("_points").alias("_points"))
    key = W.partitionBy(*keys)
    ran = weighed.select(
        *keys, "_v", "_w",
        F.max("_points").over(key).alias("_points"),
        F.sum("_w").over(key).alias("_n"),
        F.sum("_w").over(key.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)).alias("_upto"),
        F.row_number().over(key.orderBy("_v")).alias("_first"),
    )
    # The places j / points of the rows that end in this cell; place 0 is the least value.
    low = F.when(F.col("_first") == 1, F.lit(0)).otherwise(F.expr("(_upto - _w) * _points DIV _n + 1"))
    placed = ran.select(*keys, "_v", low.cast("long").alias("_low"), F.expr("_upto * _points DIV _n").alias("_high"))
    taken = placed.where("_low <= _high").select(*keys, "_v", F.explode(F.sequence("_low", "_high")).alias("_j"))
    values = taken.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_j", "_v"))), lambda x: x["_v"]).alias("points")
    )
    errors = states.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("error") + F.col("n") / points + 1).alias("error")
    )
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    named = values.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "points")
    joined = errors.join(named, _all(same))
    return joined.select(*keys, "n", "error", "points")


def _all(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def quantiles_of(states: DataFrame, keys: Sequence[str], probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(keys, p, value, n, error): quantiles read from summaries; each rank is off by ``error`` rows at most."""
    cells = F.size("points") - 1
    at = states.select(*keys, "n", "error", "points", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p"))
    place = F.round(F.col("p") * cells).cast("int")
    # Between two points the nearer one is taken, at most half a cell away.
    off = F.abs(F.col("p") - place / cells) * F.col("n")
    return at.select(*keys, "p", F.get("points", place).alias("value"), "n", (F.col("error") + off).alias("error"))
