from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from surcos.operators import aggregate, order, quantiles, ranking


@pytest.fixture(scope="module")
def numbers(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice("aaaab"), round(rnd.gauss(0, 50), 1)) for i in range(1000)]
    data += [(1000, None, None), (1001, "c", None)]
    return spark.createDataFrame(data, "id int, g string, x double").repartition(6)


def test_counts(numbers):
    assert aggregate.distribution(numbers, "g").where("g IS NULL").first()["n"] == 1
    counts = aggregate.value_counts(numbers, "g").collect()
    assert [r["g"] for r in counts] == ["a", "b", "c"]
    assert dict(rows(aggregate.null_counts(numbers))) == {"id": 0, "g": 1, "x": 2}
    assert tuple(aggregate.shape(numbers).first()) == (1002, 3)


def test_profile_is_all_distributions(numbers):
    got = aggregate.profile(numbers, ["g"]).collect()
    assert {(r["value"], r["n"]) for r in got} == set(rows(aggregate.distribution(numbers, "g")))


def test_describe_matches_spark(numbers):
    ours = {(r["column"], r["stat"]): r["value"] for r in aggregate.describe_long(numbers, ["id", "x"]).collect()}
    theirs = {r["summary"]: r for r in numbers.select("id", "x").describe().collect()}
    for (column, stat), value in ours.items():
        assert float(theirs[stat][column]) == pytest.approx(value)


def test_exact_quantiles(numbers):
    x = np.array([r["x"] for r in numbers.collect() if r["x"] is not None])
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = dict(rows(quantiles.quartiles_exact(numbers, "x", probs)))
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(x, p))
    grouped = aggregate.describe_groups(numbers.where("g = 'a'"), "g", "x").first()
    a = np.array([r["x"] for r in numbers.where("g = 'a'").collect()])
    assert [grouped[c] for c in ("p25", "p50", "p75")] == pytest.approx(list(np.quantile(a, [0.25, 0.5, 0.75])))
    approx = {(r["column"], r["stat"]): r["value"] for r in aggregate.summary_approx(numbers, ["x"]).collect()}
    assert approx["x", "50%"] == pytest.approx(np.quantile(x, 0.5), abs=1)


@pytest.mark.parametrize("shape", ["even", "ties", "skewed", "wide"])
def test_selection_narrows_down(spark, monkeypatch, shape):
    """Many rounds, forced by coarse sketches and few gathered rows, give the exact values."""
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    monkeypatch.setattr(quantiles, "GATHERED", 8)
    rng = np.random.default_rng(5)
    x = {
        "even": rng.permutation(3000).astype(float),
        "ties": rng.integers(0, 7, 3000).astype(float),
        "skewed": np.concatenate([np.zeros(1900), rng.lognormal(0, 4, 1100)]),
        "wide": np.concatenate([[-np.inf] * 3, rng.normal(size=2995) * 1e300, [np.inf] * 2]),
    }[shape]
    probs = (0.0, 0.001, 0.25, 0.3333, 0.5, 0.75, 0.999, 1.0)
    table = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "`x.y` double").repartition(3)
    got = dict(rows(quantiles.quartiles_exact(table, "x.y", probs)))
    order = np.sort(x)
    for p in probs:
        low, high = order[math.floor(p * (len(x) - 1))], order[math.ceil(p * (len(x) - 1))]
        at = p * (len(x) - 1) - math.floor(p * (len(x) - 1))
        assert got[p] == pytest.approx(low if low == high else low + (high - low) * at, nan_ok=True)


def test_quantiles_without_values_and_with_nan(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert rows(quantiles.quartiles_exact(none, "x", (0.5,))) == [(0.5, None)]
    some = spark.createDataFrame([(1.0,), (math.nan,), (3.0,)], "x double")
    got = dict(rows(quantiles.quartiles_exact(some, "x", (0.0, 0.5, 1.0))))
    assert got[0.0] == 1.0 and got[0.5] == 3.0 and math.isnan(got[1.0])


def test_selection_of_many_values(spark):
    table = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    got = dict(rows(quantiles.quartiles_exact(table, "x", (0.5,))))[0.5]
    assert got == np.median((np.arange(200_000) * 7919 % 200_003).astype(float))


def _within(x, value, p, error):
    below, upto = (x < value).sum(), (x <= value).sum()
    return below <= p * len(x) + error and upto >= p * len(x) - error


def test_quantile_states_merge_within_their_error(spark):
    """Daily summaries merged by week and then altogether, against all rows; null keys are a group."""
    rng = np.random.default_rng(2)
    given = [(k, d, float(v)) for k, size in (("a", 9000), (None, 700), ("b", 3)) for d, v in
             zip(rng.integers(0, 28, size).tolist(), rng.lognormal(0, 2, size))]
    given += [("a", 3, None), ("c", 1, None), ("b", 2, math.nan)]
    table = spark.createDataFrame(given, "k string, day int, v double").withColumn("week", F.floor(F.col("day") / 7))
    days = quantiles.quantile_states(table, ["k", "week", "day"], "v", points=32)
    weeks = quantiles.merge_quantile_states(days, ["k", "week"])
    all_ = quantiles.merge_quantile_states(weeks, ["k"])
    got = quantiles.quantiles_of(all_, ["k"], (0.0, 0.1, 0.25, 0.5, 0.77, 1.0)).collect()
    assert {r["k"] for r in got} == {"a", "b", None} and len(got) == 18
    for r in got:
        x = np.array([v for k, _, v in given if k == r["k"] and v is not None and not math.isnan(v)])
        assert r["n"] == len(x) and _within(x, r["value"], r["p"], r["error"])
        assert r["k"] != "a" or r["error"] < len(x) / 8
    assert all(len(r["points"]) == 33 for r in all_.collect())


def test_histogram(spark, numbers):
    x = np.array([r["x"] for r in numbers.collect() if r["x"] is not None])
    counts, edges = np.histogram(x, 7)
    got = aggregate.histogram(numbers, "x", 7).orderBy("bin").collect()
    assert {r["bin"]: r["n"] for r in got} == {i: n for i, n in enumerate(counts) if n}
    assert got[0]["lo"] == pytest.approx(edges[0])
    flat = spark.createDataFrame([(2.0,)] * 3, "x double")
    assert [(r["bin"], r["n"]) for r in aggregate.histogram(flat, "x", 4).collect()] == [(0, 3)]


def test_group_means_and_min_max(numbers):
    means = aggregate.group_means(numbers, "g")
    assert means.columns == ["g", "id", "x"]
    assert aggregate.min_max(numbers, ["id"]).first() == (0, 1001)


def test_global_rank_and_totals(spark):
    rnd = random.Random(5)
    data = [(i, rnd.randrange(5), rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, n int, x double").repartition(7)
    ranked = ranking.global_rank(df, [F.desc("n"), F.asc("id")], "r").collect()
    expected = {i: r for r, (i, n, x) in enumerate(sorted(data, key=lambda t: (-t[1], t[0])))}
    assert {r["id"]: r["r"] for r in ranked} == expected
    totals = {r["id"]: r["cum_n"] for r in ranking.running_totals(df, [F.asc("x")], ["n"]).collect()}
    so_far = 0
    for i, n, x in sorted(data, key=lambda t: t[2]):
        so_far += n
        assert totals[i] == so_far


def test_global_order_uses_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("n"))
        placed = ranking._ranges(df, [F.desc("id")])
        assert placed.select("_range").distinct().count() > 1
        got = {r["id"]: r["r"] for r in ranking.global_rank(df, [F.desc("id")], "r").collect()}
        assert all(got[i] == 4999 - i for i in got) and len(got) == 5000
        last = ranking.running_totals(df, [F.asc("id")], ["n"]).where("id = 4999").first()
        assert last["cum_n"] == sum(i % 7 for i in range(5000))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_top_and_bottom(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 1), (5, 9)], "id int, x int")
    assert [r["id"] for r in order.bottom_k(df, "x", 3, "id").collect()] == [3, 4, 1]
    assert [r["id"] for r in order.top_k(df, "x", 3, "id").collect()] == [5, 1, 2]


def test_first_and_last_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", d) for d in range(9)] + [("b", 1)], "series_id string, ds int")
    assert rows(order.first_n(df, 2)) == [("a", 0), ("a", 1), ("b", 1)]
    assert rows(order.last_n(df, 2)) == [("a", 7), ("a", 8), ("b", 1)]
    plan = order.last_n(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("small", [0, 100])
def test_codes_are_in_the_order_of_the_values(spark, monkeypatch, small):
    monkeypatch.setattr(ranking, "SMALL", small)
    words = ["b", "B", "ä", "z", "", "b", None, "\U0001f600", "\uffee", "a b"]
    got = rows(ranking.ordered_codes(spark.createDataFrame([(w,) for w in words], "w string"), "w"), "code", "value")
    assert [v for _, v in got] == sorted({w for w in words if w is not None}, key=str.encode)
    assert [c for c, _ in got] == list(range(8))
    numbers = rows(ranking.ordered_codes(spark.createDataFrame([(3,), (-1,), (None,), (10,)], "n int"), "n"), "code", "value")
    assert numbers == [(0, -1), (1, 3), (2, 10)]
    assert ranking.ordered_codes(spark.createDataFrame([], "n int"), "n").collect() == []
