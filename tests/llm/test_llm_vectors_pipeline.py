"""Vector near copies and the pipeline against brute force."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from surcos.llm import minhash, vectors
from surcos.llm.components import components
from surcos.llm.shipping import ship
from surcos.sources import scratch

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


def brute(rows):
    """n_links and component of each (vec_id, vector), rows as nodes."""
    good = [
        i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        for i, v in rows
    ]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    links[a] += 1
                    links[b] += 1
                    up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if good[k]:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, links[k], least[find(k)] if good[k] else i) for k, (i, _) in enumerate(rows)]


def check(table, rows):
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(table).collect()]
    key = lambda t: [(v is not None, v or 0) for v in t]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_given_vectors(spark):
    ship(spark)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(table, [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_awkward_vectors(spark):
    """Loose groups whose members are not all linked, copies, scaled and opposite vectors, broken ones."""
    rng, rows = np.random.default_rng(4), []
    for g in range(6):
        centre = rng.standard_normal(16)
        centre /= np.linalg.norm(centre)
        for _ in range(25):
            rows.append((len(rows) * 7 % 1009, (centre + rng.standard_normal(16) * 0.085).tolist()))
    rows += [(2000 + k, rows[3][1]) for k in range(40)] + [(2050, [x * 1e200 for x in rows[3][1]]), (2051, [-x for x in rows[3][1]])]
    rows += [(2060, None), (2061, []), (2062, [0.0] * 16), (2063, [1.0] * 15 + [None]), (2064, [1.0] * 15 + [float("nan")]),
             (2065, [1.0] * 15 + [float("inf")]), (2066, [1.0, 0.0]), (2067, [2.0, 0.0]), (None, rows[3][1]), (2000, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit("x")).withColumn("id", F.lit(1))
    check(table.repartition(4), rows)


@pytest.mark.parametrize("turn", [0, 1, 2])
def test_vectors_that_share_an_id(spark, turn):
    """The vectors of one id differ; each has a near copy of another id."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.1]), (3, [1.0, 0.0, 0.1]), (4, [0.0, 0.0, 1.0])]
    table = spark.createDataFrame(rows[turn:] + rows[:turn], "vec_id long, embedding array<double>").repartition(1 + turn)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(table).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def cone(n, mean, dim=64, seed=6):
    """Unit vectors, a third around one direction at the given mean cosine; 150 of those with a partner at 0.91."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axis = np.eye(dim)[0]
    inside = rng.permutation(n)[: n // 3]
    x[inside, 0] = 0
    x[inside] /= np.linalg.norm(x[inside], axis=1, keepdims=True)
    x[inside] = math.sqrt(mean) * axis + math.sqrt(1 - mean) * x[inside]
    for a, b in zip(inside[:150], inside[150:300]):  # turned about the axis, so the partner stays in the cone
        u, w = (x[k] - x[k] @ axis * axis for k in (a, b))
        u, w = u / np.linalg.norm(u), w - w @ u * u / (u @ u)
        c = (0.91 - mean) / (1 - mean)
        x[b] = math.sqrt(mean) * axis + math.sqrt(1 - mean) * (c * u + math.sqrt(1 - c * c) * w / np.linalg.norm(w))
    return x


@pytest.mark.parametrize("tiles", [True, False])
def test_dense_cone(spark, monkeypatch, tiles):
    """A third of all rows in a cone at mean cosine 0.8: every link is found, by tiles and by further passes."""
    if tiles:
        monkeypatch.setattr(vectors, "ALL", 1024)
    else:
        monkeypatch.setattr(vectors, "ALL", 16)
        monkeypatch.setattr(vectors, "PASS_COST", 0)
    x = cone(12_000, 0.8) if tiles else cone(3000, 0.5)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    up = np.arange(len(x))
    for _ in range(len(x)):
        low = np.array([min(up[k], up[near[k]].min(initial=len(x))) for k in range(len(x))])
        if (low == up).all():
            break
        up = low
    assert near.sum() >= 300
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(table).collect()}
    assert [got[k] for k in range(len(x))] == list(zip(near.sum(axis=1).tolist(), up.tolist()))


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("(id * 7) % 301 AS a", "((id + 1) * 7) % 301 AS b")
    assert {r["component"] for r in components(links).collect()} == {0}
    assert components(links.limit(0)).count() == 0


def test_passes_grow_slowly():
    assert vectors.passes(1000) <= vectors.passes(100_000) <= vectors.passes(10_000_000) < 120


def test_pipeline_runs_stage_by_stage(spark):
    """Each stage keeps what it should of its own input, and run() is the same as its stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen]
    assert all(d.columns == columns for d in seen[:-1])
    assert set(ids[1]) < set(ids[0]) and set(ids[2]) <= set(ids[1]) and sorted(ids[3]) == sorted(ids[2])
    assert set(ids[4]) <= set(ids[3]) and sorted(ids[5]) == sorted(ids[4])
    assert len(ids[2]) == len(set(ids[2]))
    texts = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in seen[4].collect())
    whole = corpus_pipeline.run(spark, SF)
    order = lambda d: sorted(map(tuple, d.select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert order(whole) == order(seen[5])


def test_pipeline_near_copies_by_brute_force(spark):
    """Groups at similarities around 0.8: the stage keeps the least document of each, and nothing else goes."""
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    rng, rows = np.random.default_rng(8), []
    for g in range(40):
        base = [f"g{g}w{k}" for k in range(110 + g)]
        for e in range(4):
            text = list(base)
            for k in rng.choice(len(base) // 7, e, replace=False):
                text[7 * int(k)] = f"edit{g}x{e}"
            rows.append((len(rows) * 37 % 163, " ".join(text)))
    sets = {i: shingles(t) for i, t in rows}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert sum(0.8 <= s < 0.85 for s in share.values()) >= 30
    up = {i: i for i in sets}
    for _ in sets:
        for (a, b), s in share.items():
            if s >= 0.8:
                up[a] = up[b] = min(up[a], up[b])
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert sorted(r["doc_id"] for r in stage(spark, table, SF).collect()) == sorted(i for i in sets if up[i] == i)
    got = minhash.near_copies(table, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == up


@pytest.mark.parametrize("few", [1, 6, 64])
def test_small_buckets_need_no_tiles(spark, monkeypatch, few):
    """Chains of edits, whose buckets have few members each: many are compared at a time, and tiles get the others only."""
    tiled, seen = minhash._tiled, []
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "_tiled", lambda open_: seen.append(open_.count()) or tiled(open_))
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    rng, rows = np.random.default_rng(5), []
    for g in range(25):
        text = [f"g{g}w{k}" for k in range(90)]
        for e in range(10):
            text = list(text)
            text[int(rng.integers(90))] = f"edit{e}"
            text[int(rng.integers(90))] = f"more{e}"
            rows.append((len(rows) * 37 % 251, " ".join(text)))
    sets = {i: shingles(t) for i, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    up = {i: i for i in sets}
    for _ in sets:
        for a, b in alike:
            up[a] = up[b] = min(up[a], up[b])
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_copies(table, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == up and 25 < len(set(up.values())) < 200
    assert len(seen) == 2 and (max(seen) == 0) == (few == 64)


def test_only_repeated_ids_are_cut_into_words_again(spark):
    """Without broadcasts the last joins of the stage cut and shuffle no text whose id has one row."""
    prose = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(prose)] + [(3, prose[3]), (4, "other words under the same id")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
        assert "ArrowEvalPython" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in kept.collect()) == sorted(rows[:40] + rows[41:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _copies_of_texts():
    prose = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(prose)] + [(100 + i, t) for i, t in enumerate(prose[:9])]
    rows += [(3, prose[3]), (4, "other words under the same id"), (103, prose[20]), (None, prose[0])]
    keeps = [(i, t) for i, t in enumerate(prose)] + [(4, "other words under the same id"), (None, prose[0])]
    return rows, keeps


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_texts_stay_where_they_are_unless_many_ids_go(spark, monkeypatch, most):
    """The last join takes a few ids to the texts, whatever the session broadcasts by itself; many shuffle both."""
    rows, keeps = _copies_of_texts()
    monkeypatch.setattr(minhash, "MAX_BROADCAST", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert ("LeftAnti" in plan) and ("rightHint=(strategy=broadcast)" in plan) == (most > 0)
        assert sorted(map(str, kept.collect())) == sorted(str(r) for r in spark.createDataFrame(keeps, kept.schema).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_on_the_way_go_when_they_were_read(spark):
    rows, keeps = _copies_of_texts()
    home = f"{scratch._base(spark)}/surcos/{spark.sparkContext.applicationId}"
    docs = scratch.materialise(spark.createDataFrame(rows, "doc_id long, text string"), "given")
    there = set(os.listdir(home))
    left = lambda: sorted(n.rpartition("-")[0] for n in set(os.listdir(home)) - there)
    kept = minhash.keep_first(docs)
    assert left() == ["kept", "other-ids", "repeated"] and kept.count() == len(keeps)
    there = set(os.listdir(home))
    got = minhash.near_copies(docs)
    assert left() == ["set-components", "sketches"] and got.count() == len(rows) == docs.count()


def test_bands_follow_the_threshold():
    for percent in (50, 70, 80, 85, 90, 95):
        by = minhash.plan(percent)
        assert (1 - (percent / 100) ** by.rows) ** by.bands <= minhash.MISS and by.hashes * minhash.BITS % 64 == 0
    assert (minhash.plan(85).rows, minhash.plan(85).bands) == (8, 48)


def test_pipeline_of_awkward_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(f"word{k}" for k in range(80))
    for rows in ([], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, prose, None, None, 5), (2, prose, None, None, 5), (3, prose, "en", "s", 1)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() == (0 if not rows else docs.select("doc_id").where("doc_id = 2").count())


def test_entry_lists_all_queries():
    names = set(contract.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(contract.oracle_sql()) <= names
