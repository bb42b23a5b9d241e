from __future__ import annotations

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from surcos.checks import relational
from surcos.operators import joins, skew
from surcos.plans import credit, retail

def bank(spark, disp):
    """Loan without account, account without loan, with two or no dispositions, …"""
    make = spark.createDataFrame
    return credit.Bank(
        make([(1, 10, 706213), (2, 99, 10203), (3, 11, None)], "client_id long, district_id long, birth_number int"),
        make(
            [(10, "d10", "north", 100, 3, 50.0, 9.5), (11, "d11", "south", None, 1, 20.0, 8.0)],
            "A1 long, A2 string, A3 string, A4 int, A9 int, A10 double, A11 double",
        ),
        make(disp, "client_id long, account_id long, type string"),
        make(
            [(100, "POPLATEK MESICNE", 930101), (101, "POPLATEK TYDNE", 930102), (102, "?", 1), (104, None, 2)],
            "account_id long, frequency string, date int",
        ),
        make(
            [(1, 100, 10.0, 12, 1.0, "A"), (2, 102, 20.0, 24, 2.0, "B"), (3, 103, 30.0, 12, 3.0, "C"),
             (4, None, 40.0, 12, 4.0, "D"), (5, 104, 50.0, 12, 5.0, None), (6, 100, 60.0, 12, 6.0, "C")],
            "loan_id long, account_id long, amount double, duration int, payments double, status string",
        ),
        make(
            [(100, "x", 1.0, 2.0), (100, "y", 3.0, None), (101, None, 5.0, 6.0), (102, "z", None, 1.0)],
            "account_id long, operation string, amount double, balance double",
        ),
    )


DISP = [(1, 100, "o"), (2, 100, "d"), (3, 101, "o"), (9, 102, "o"), (1, 103, "o"), (None, 104, "o"), (1, None, "o")]


def by_hand(b, keep_loans):
    """Rows of the denormalised table, one loan and holder at a time, without any join."""
    tables = {name: [r.asDict() for r in getattr(b, name).collect()] for name in ("client", "district", "disp", "account", "loan", "trans")}
    where = lambda name, key, value: [r for r in tables[name] if value is not None and r[key] == value]

    def person(holder):
        for c in where("client", "client_id", holder["client_id"]):
            month = None if c["birth_number"] is None else c["birth_number"] // 100 % 100
            gender = "hombre" if month is not None and month <= 50 else "mujer"
            near = where("district", "A1", c["district_id"]) or [dict.fromkeys(("A1", "A2", "A3", "A4", "A11"))]
            for d in near:
                yield (c["client_id"], c["district_id"], gender, d["A1"], d["A2"], d["A3"], d["A4"], d["A11"],
                       holder["client_id"], holder["account_id"], holder["type"])

    def held(account):
        code = credit.FREQUENCIES.get(account["frequency"], "no especifica")
        return [(*p, account["account_id"], code) for h in where("disp", "account_id", account["account_id"]) for p in person(h)]

    def turnover(account_id):
        own = where("trans", "account_id", account_id)
        mean = lambda c: (lambda v: sum(v) / len(v) if v else None)([r[c] for r in own if r[c] is not None])
        names = [r["operation"] for r in own if r["operation"] is not None]
        return (account_id, max(names, default=None), mean("amount"), mean("balance"), len(own)) if own else (None,) * 5

    terms = lambda r: tuple(r[c] for c in ("loan_id", "account_id", "amount", "duration", "payments", "status"))
    out = []
    if keep_loans:
        for r in tables["loan"]:
            found = [h for a in where("account", "account_id", r["account_id"]) for h in held(a)]
            out += [(*h, *terms(r), *turnover(r["account_id"])) for h in found] or [(*(None,) * 13, *terms(r), *(None,) * 5)]
    else:
        for a in tables["account"]:
            own = [terms(r) for r in where("loan", "account_id", a["account_id"])] or [(None,) * 6]
            out += [(*h, *t) for h in held(a) for t in own]
    return sorted(out, key=lambda t: [(v is not None, str(v)) for v in t])


DILUTED = [(1, 1000 + i, "z") for i in range(40)]


@pytest.mark.parametrize("extra", [[], DILUTED, [(2, 100, "h")] * 40, [(1, None, "h")] * 40])
def test_minable_equals_rows_put_together_by_hand(spark, extra):
    """Also with an account, or a missing account, that holds most dispositions."""
    b = bank(spark, DISP + extra)
    assert rows(credit.minable(b)) == by_hand(b, keep_loans=True)
    ours = joins.minable_table(
        credit.client_part(b), credit.district_part(b), credit.disp_part(b),
        credit.account_part(b), credit.loan_part(b), keep_loans=False,
    )
    assert rows(ours) == by_hand(b, keep_loans=False)


LOANED = [(90 + i, 100, 7.0 + i, 12, 1.0, "A") for i in range(50)]


@pytest.mark.parametrize("held", [[], [(2, 100, f"h{i}") for i in range(60)]])
def test_minable_with_an_account_of_many_loans(spark, monkeypatch, held):
    """And of many dispositions as well: then every pair meets in one cell of a grid."""
    b = bank(spark, DISP + held)
    b.loan = b.loan.unionByName(spark.createDataFrame(LOANED, b.loan.schema))
    monkeypatch.setattr(joins, "HOT_LOANS", 5)
    monkeypatch.setattr(credit, "HOT_LOANS", 5)
    got = credit.minable(b)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("_cell_row" in plan) and ("_across_row" in plan) and ("_salt" in plan)
    assert rows(got) == by_hand(b, keep_loans=True)
    ours = joins.minable_table(
        credit.client_part(b), credit.district_part(b), credit.disp_part(b),
        credit.account_part(b), credit.loan_part(b), keep_loans=False,
    )
    assert rows(ours) == by_hand(b, keep_loans=False)


def test_grid_join_equals_join(spark):
    rnd = random.Random(9)
    keys = [7] * 60 + [8] * 30 + [None] * 20
    left = spark.createDataFrame([(rnd.choice(keys + list(range(20))), i) for i in range(500)], "k int, v int")
    right = spark.createDataFrame([(rnd.choice([7] * 30 + [9] * 20 + [None] + list(range(15))), i) for i in range(400)], "k2 int, w int")
    cells = skew.grid_cells(skew.profile_key(left, "k").hot, skew.profile_key(right, "k2").hot, 16)
    assert cells[7][0] > 1 and cells[7][1] > 1 and None not in cells
    assert cells[9] == (1, 16)
    got = skew.grid_join(skew.deal(left, "k", cells, 0), skew.deal(right, "k2", cells, 1), "k", "k2", cells)
    expected = left.join(right, F.col("k") == F.col("k2"))
    assert got.columns == expected.columns and rows(got) == rows(expected)


def test_grid_sides_follow_the_counts():
    assert skew.grid_cells({1: 100, 2: 1000, 3: 64, 4: 5}, {1: 100, 2: 10, 5: 9, None: 3}, 64) == {
        1: (8, 8), 2: (64, 1), 3: (64, 1), 4: (64, 1), 5: (1, 64)
    }
    assert skew.grid_cells({1: 3}, {1: 3_000_000}, 200)[1] == (1, 256)
    assert skew.grid_cells({}, {}, 8) == {}


@pytest.mark.parametrize("width", [4, 16])
def test_packs_meet_as_their_rows_would(spark, monkeypatch, width):
    for name, value in (("PACK", 8), ("GATHER", 16), ("REPEATS", 4)):
        monkeypatch.setattr(skew, name, value)
    rnd = random.Random(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        left = spark.createDataFrame(
            [(rnd.choice([7] * 60 + [8] * 30 + [None] * 20 + list(range(20))), rnd.choice([None, 1, i])) for i in range(600)], "k int, v int")
        right = spark.createDataFrame(
            [(rnd.choice([7] * 30 + [9] * 20 + [None] + list(range(15))), f"w{i % 50}") for i in range(300)], "k2 int, w string")
        profiles = skew.profile_key(left, "k"), skew.profile_key(right, "k2")
        cells = skew.grid_cells(profiles[0].hot, profiles[1].hot, width)
        assert 7 in cells
        packs = [skew.pack(skew.deal(df, k, cells, axis), k, cells, axis, profiles[axis]) for axis, (df, k) in enumerate(((left, "k"), (right, "k2")))]
        assert packs[0].where(F.size("_pack_left") > 8).count() == 0 and packs[0].select(F.explode("_pack_left")).count() == left.where("k IS NOT NULL").count()
        got = skew.unpack(skew.grid_join(*packs, "k", "k2", cells, width), "k", "k2").select("k", "v", "k2", "w")
        assert rows(got) == rows(left.join(right, F.col("k") == F.col("k2")))
        none = [skew.pack(df, k, {}, axis, p) for axis, (df, k, p) in enumerate(((left, "k", profiles[0]), (right, "k2", profiles[1])))]
        assert rows(skew.unpack(skew.grid_join(*none, "k", "k2", {}, width), "k", "k2").select("k", "v", "k2", "w")) == rows(got)
        empty = [p.limit(0) for p in (left, right)]
        blank = [skew.profile_key(df, k) for df, k in zip(empty, ("k", "k2"))]
        assert skew.unpack(skew.grid_join(*[skew.pack(df, k, {}, axis, blank[axis]) for axis, (df, k) in enumerate(zip(empty, ("k", "k2")))], "k", "k2", {}, width), "k", "k2").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pairs_are_made_by_more_tasks_where_there_are_many():
    left, right = (skew.KeyProfile({1: n, None: 5 * n}, 9, 6 * n) for n in (1 << 20, 1 << 16))
    assert skew.pair_tasks(left, right, 24) == 256 and skew.pair_tasks(left, right, 1000) == 1000
    assert skew.pair_tasks(left, skew.KeyProfile({}, 9, 9), 24) == 24


def test_pairs_of_two_sides_are_spread_and_written_in_few_bytes(spark, tmp_path):
    """Few bytes go into the join, so that adaptive execution would leave all pairs to a task or two."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        spark.range(25).selectExpr("CAST(id AS INT) AS n_nationkey", "CAST(id % 5 AS INT) AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
        spark.range(6000).selectExpr("id AS c_custkey", "CAST(hash(id) % 13 + 12 AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
        spark.range(1500).selectExpr("id AS s_suppkey", "CAST(hash(id + 9) % 13 + 12 AS INT) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
        relational.two_sided_join(spark, str(tmp_path)).write.parquet(f"{tmp_path}/pairs")
        pairs = spark.read.parquet(f"{tmp_path}/pairs")
        sides = [spark.read.parquet(f"{tmp_path}/{t}.parquet").join(spark.read.parquet(f"{tmp_path}/nation.parquet"), F.col(k) == F.col("n_nationkey")).groupBy("n_regionkey").count().collect()
                 for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
        counts = [{r["n_regionkey"]: r["count"] for r in side} for side in sides]
        n = sum(c * counts[1].get(k, 0) for k, c in counts[0].items())
        assert pairs.count() == n == pairs.distinct().count()
        by_file = [r["count"] for r in pairs.groupBy(F.input_file_name()).count().collect()]
        assert max(by_file) < n / 4
        assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_an_account_of_many_loans_and_dispositions_spreads_over_all_tasks(spark):
    """10^5 of each would be 10^10 rows; here 2,000 of each are 4 million."""
    n, width = 2_000, 32
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        disp = spark.range(n + 100).selectExpr("id AS c_id", f"IF(id < {n}, 5, id) AS account_id", "'o' AS type")
        loan = spark.range(n + 300).selectExpr("id AS loan_id", f"IF(id < {n}, 5, id) AS acl_id", "1.0 AS amount")
        account = spark.range(3 * n).selectExpr("id AS ac_id", "'m' AS often")
        client = spark.range(n + 100).selectExpr("id AS client_id", "1L AS district_id")
        district = spark.range(3).selectExpr("id AS districtid", "'d' AS name")
        table = joins.minable_table(client, district, disp, account, loan)
        # Client and loan are unique, so the pairs and their sums tell the rows apart.
        made = table.where("client_id IS NOT NULL").groupBy(F.spark_partition_id().alias("task")).agg(
            F.count("*").alias("n"), F.count_distinct("client_id", "loan_id").alias("d")).collect()
        assert sum(r["n"] for r in made) == sum(r["d"] for r in made) == n * n + 100
        assert table.where("client_id IS NULL").count() == 200
        assert sum(r["n"] > 0 for r in made) > width / 2
        assert max(r["n"] for r in made) < 8 * n * n / width
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_salted_semi_and_anti_joins(spark, how):
    facts = spark.createDataFrame([(1, i) for i in range(80)] + [(None, 1), (2, 2), (3, 3)] + [(4, i) for i in range(70)], "k int, v int")
    keys = spark.createDataFrame([(1,), (3,), (5,)], "k2 int").distinct()
    hot = [k for k in skew.hot_keys(facts, "k") if k is not None]
    assert sorted(hot) == [1, 4]
    got = skew.salted_join(skew.salt(facts, "k", hot), keys, "k", "k2", how, hot)
    assert rows(got) == rows(facts.join(keys, F.col("k") == F.col("k2"), how))


def many_accounts(spark, n=400, each=5):
    """One account in a hundred has a loan."""
    b = bank(spark, [])
    b.account = spark.range(n).selectExpr("id AS account_id", "'POPLATEK MESICNE' AS frequency", "930101 AS date")
    b.loan = spark.range(0, n, 100).selectExpr("id AS loan_id", "id AS account_id", "1.0D AS amount", "12 AS duration", "1.0D AS payments", "'A' AS status")
    b.trans = spark.range(n * each).selectExpr(f"id % {n} AS account_id", "concat('op', id % 3) AS operation", "id * 1.0D AS amount", "2.0D AS balance")
    b.disp = spark.range(n).selectExpr("1 + id % 2 AS client_id", "id AS account_id", "'o' AS type")
    return b


def test_summary_covers_accounts_with_loans_only_where_they_are_few(spark):
    b = many_accounts(spark)
    loan = credit.loan_part(b)
    profile = skew.profile_key(loan, "acl_id")
    few = joins.few_keys(loan, "acl_id", profile, b.account.count())
    assert joins.restrict(b.trans, "account_id", few).count() * 100 == b.trans.count()
    assert joins.few_keys(loan, "acl_id", profile, 8) is None
    plan = credit.minable(b)._jdf.queryExecution().optimizedPlan().toString()
    summary = plan[plan.index("Aggregate [account_id"):]
    assert "LeftSemi" in summary.split("Relation")[0].split("Range")[0]
    got = rows(credit.minable(b))
    assert got == by_hand(b, keep_loans=True) and len(got) == 4


def test_no_restriction_where_most_accounts_have_loans(spark):
    b = many_accounts(spark, 20)
    b.loan = b.loan.unionByName(b.loan.selectExpr("loan_id + 1 + account_id", "account_id + 1", "amount", "duration", "payments", "status").toDF(*b.loan.columns)).unionByName(
        spark.range(2, 18).selectExpr("id + 500 AS loan_id", "id AS account_id", "1.0D AS amount", "12 AS duration", "1.0D AS payments", "'B' AS status"))
    assert "_few" not in credit.minable(b)._jdf.queryExecution().optimizedPlan().toString()
    assert rows(credit.minable(b)) == by_hand(b, keep_loans=True)


def test_candidates_drop_unmatched_loans(spark):
    got = rows(credit.candidates(bank(spark, DISP), key="loan_id").select("loan_id", "candidato"))
    assert got == [(1, "Candidato"), (6, "Candidato")]
    # Account 100 has one disposition of a client whose district is unknown.
    assert credit.minable(bank(spark, DISP)).where("loan_id = 1").count() == 2


@pytest.mark.parametrize("extra", [[], DILUTED])
def test_cleaned_table_plans_inner_joins_only(spark, extra):
    plan = credit.candidates(bank(spark, DISP + extra))._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner" in plan
    for other in ("LeftOuter", "RightOuter", "LeftAnti", "Union"):
        assert other not in plan


def test_hot_keys(spark):
    data = [(7,)] * 60 + [(None,)] * 30 + [(k,) for k in range(100, 110)]
    df = spark.createDataFrame(data, "k long")
    assert skew.hot_keys(df, "k") == [7, None]
    assert skew.hot_keys(df.where("k >= 100"), "k") == []
    assert skew.hot_keys(df.where("false"), "k") == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how):
    rnd = random.Random(3)
    facts = spark.createDataFrame(
        [(rnd.choice([1, 1, 1, 2, 3, 4, None]), i // 2) for i in range(300)], "k int, v int"
    ).repartition(5)
    side = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (9, "d"), (None, "e")], "k2 int, w string")
    expected = facts.join(side, F.col("k") == F.col("k2"), how)
    hot = skew.hot_keys(facts, "k")
    assert hot == [1]
    got = skew.salted_join(skew.salt(facts, "k", hot), side, "k", "k2", how, hot)
    assert got.columns == expected.columns
    assert rows(got) == rows(expected)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_salt_spreads_a_key_that_lies_in_one_task(spark):
    facts = spark.range(4000).selectExpr("IF(id < 3500, 7, id) AS k", "id AS v").repartition("k")
    hot = skew.hot_keys(facts, "k")
    assert hot == [7]
    counts = skew.salt(facts, "k", hot).where("k = 7").groupBy(skew._SALT).count().collect()
    assert len(counts) == 4 and max(r["count"] for r in counts) < 1200


def test_hot_keys_of_a_wide_shuffle(spark):
    df = spark.range(100_000).selectExpr("IF(id < 80, 0, id) AS k")
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    try:
        assert skew.hot_keys(df, "k") == [0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_summary_join_keeps_rows_without_key(spark):
    facts = spark.createDataFrame([(None, i) for i in range(90)] + [(1, 1), (2, 2), (3, 3)], "k int, v int")
    summary = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "a int, w int").groupBy("a").agg(F.sum("w").alias("w"))
    expected = facts.join(summary, F.col("k") == F.col("a"), "left")
    assert rows(joins.with_summary(facts, summary, "k", "a")) == rows(expected)


@pytest.mark.parametrize("more", [[], [(i, "m") for i in range(50, 90)]])
def test_keep_right_join(spark, more):
    data = [(1, "a"), (1, "b"), (None, "c"), (5, "d")]
    facts = spark.createDataFrame(data + more, "k int, v string")
    assert bool(skew.hot_keys(facts, "k")) == (not more)
    kept = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, k2 int")
    expected = facts.join(kept, F.col("k") == F.col("k2"), "right")
    assert rows(skew.keep_right_join(facts, kept, "k", "k2")) == rows(expected)


def test_each_large_table_is_shuffled_once_by_account(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = credit.candidates(bank(spark, DISP + DILUTED))._jdf.queryExecution().executedPlan().toString()
        by_account = [ln for ln in plan.split("\n") if re.search(r"Exchange hashpartitioning\(ac\w*_id", ln)]
        assert len(by_account) == 4, plan  # dispositions, accounts, summary, loans
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shop(spark):
    """Products with 0, 1 and 3 moves, a repeated and an unknown product, null measures."""
    make = spark.createDataFrame
    return retail.Shop(
        make(
            [(1, 10, 1.0, 100.0), (1, 11, 2.0, None), (1, 12, None, 50.0), (2, 12, 4.0, 25.0), (2, 99, 1.0, 1.0),
             (3, None, 7.0, 3.0), (4, 13, 1.0, 2.0), (5, 98, 2.0, 4.0), (1, 12, 3.0, 10.0)],
            "cliente_id long, product_id long, product_uom_qty double, price_total double",
        ),
        make(
            [(10, 1.0, 5, "p"), (11, 1.0, None, "q"), (12, 1.0, 7, None), (13, 2.0, 3, "r"), (13, 2.5, 4, "s")],
            "ID long, Preciodeventa double, Cantidadamano int, Nombre string",
        ),
        make(
            [(11, 2.0, 1), (12, 1.0, 4), (12, None, 9), (12, 5.0, 2), (13, 1.5, 3), (13, 2.5, 8), (98, 6.0, 6), (None, 1.0, 1)],
            "product_id long, product_qty double, location_dest_id int",
        ),
    )


def test_client_summary_equals_aggregated_fan_out(spark):
    s = shop(spark)
    view = retail.joined(s)
    expected = view.groupBy("cliente_id").agg(
        F.max("Nombre").alias("Nombre"), F.avg("price_total").alias("precio_total"),
        F.avg("product_uom_qty").alias("prod_vendido"), F.avg("Cantidadamano").alias("stock"),
        F.sum("product_qty").alias("prod_mov"), F.max("location_dest_id").alias("prod_dest"),
        F.count("*").alias("cantidad_compras"),
    )
    got = retail.client_summary(s)
    assert got.columns == expected.columns
    a, b = rows(got), rows(expected)
    assert [[x and pytest.approx(x) if isinstance(x, float) else x for x in r] for r in b] == [list(r) for r in a]


def test_client_summary_needs_no_sort_aggregation(spark):
    plan = retail.client_summary(shop(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2


def test_fan_out_size(spark):
    s = shop(spark)
    expected = retail.joined(s).groupBy("product_id").agg(
        F.count("*").alias("view_rows"), F.sum("product_qty").alias("moved_qty")
    )
    assert rows(retail.joined_size(s)) == rows(expected)


def test_fan_out_rows(spark):
    s = shop(spark)
    view = retail.joined(s)
    assert view.where("product_id = 12").count() == 9
    assert view.where("product_id = 13").count() == 4
    assert view.where("product_id = 99").select("ID", "pid").first() == (None, None)
