from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from surcos.plans import credit, telecom
from surcos.sources import delimited, scratch, tables


@pytest.fixture()
def text(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id;code;x\n1;007;1.5\n2;;2\n3;abc;\n")
    return str(path)


def test_schema_modes(spark, text):
    def types(df):
        return [f.dataType.simpleString() for f in df.schema]

    strings = delimited.read_delimited(spark, text, sep=";")
    assert types(strings) == ["string"] * 3
    inferred = delimited.read_delimited(spark, text, sep=";", infer=True)
    assert types(inferred) == ["int", "string", "double"]
    declared = delimited.read_delimited(spark, text, sep=";", schema="id BIGINT, code STRING, x FLOAT", infer=True)
    assert types(declared) == ["bigint", "string", "float"]
    assert rows(declared) == [(1, "007", 1.5), (2, None, 2.0), (3, "abc", None)]
    assert rows(declared.select("x")) == [(None,), (1.5,), (2.0,)]


def test_tables_over_text_can_be_made_again(spark, text):
    name = tables.fresh_name(spark, "t")
    for _ in range(2):
        df = delimited.delimited_table(spark, name, text, sep=";", infer=True)
    assert df.count() == 3
    ddl = delimited.delimited_table(spark, name, text, sep=";", ddl="id FLOAT, code STRING, x FLOAT", infer=True)
    assert ddl.schema["id"].dataType.simpleString() == "float"
    assert spark.sql(f"SELECT CODE FROM {name} WHERE Id = 1").first()[0] == "007"


def test_dated_file(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("Fecha,Trafico\n01/02/2024,5\n3-2-2024,6.5\n2024-02-04,\n")
    got = delimited.read_dated(spark, str(path), "Fecha", "Trafico").orderBy("ds").collect()
    assert [tuple(r) for r in got] == [
        (dt.date(2024, 2, 1), 5.0), (dt.date(2024, 2, 3), 6.5), (dt.date(2024, 2, 4), None)
    ]


def test_call_table(spark, tmp_path):
    values = ["KS", "128", "415", "382-4657", "no", "yes"] + [str(i) for i in range(14)]
    path = tmp_path / "calls.csv"
    header = ",".join(f.name for f in telecom.CALLS)
    path.write_text(header + "\n" + ",".join(values) + ", False.\n" + ",".join(values[:-1]) + ",,True.\n")
    raw = delimited.read_delimited(spark, str(path), schema=telecom.CALLS)
    clean = telecom.cleaned(raw)
    assert rows(clean, "state", "churn") == [("KS", "False.")]
    assert len(telecom.described(clean).columns) == 19
    assert len(telecom.segment_columns(clean).columns) == 17
    table = delimited.delimited_table(spark, tables.fresh_name(spark, "calls"), str(path), ddl=telecom.CALLS_DDL)
    assert table.where("Churn IS NOT NULL").count() == 2


def test_replace_create_insert(spark):
    name = tables.fresh_name(spark, "r")
    tables.replace_table(spark.range(3), name)
    assert tables.replace_table(spark.createDataFrame([("x",)], "v string"), name).columns == ["v"]
    empty = tables.create_empty(spark, name, "id STRING, charge FLOAT")
    assert empty.count() == 0
    text = spark.createDataFrame([("a", "1.5"), ("b", "n/a")], "customer string, MonthlyCharges string")
    assert rows(tables.insert_select(text, name)) == [("a", 1.5), ("b", None)]
    assert tables.insert_select(text, name).count() == 4
    with pytest.raises(ValueError):
        tables.insert_select(text.select("customer"), name)
    assert [r["col_name"] for r in tables.describe(spark, name).collect()] == ["id", "charge"]


def test_views(spark):
    view = tables.fresh_name(spark, "v")
    assert tables.replace_view(spark, view, "SELECT 1 AS a").columns == ["a"]
    assert tables.replace_view(spark, view, "SELECT 2 AS b").columns == ["b"]
    tables.session_view(spark.range(5), "five")
    assert spark.sql("SELECT count(*) FROM five").first()[0] == 5
    assert tables.preview(spark.range(50), 7).count() == 7


def test_scratch_without_a_configured_folder(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_DIR", "spark.surcos.unset")
    a, b = (scratch.scratch_path(spark, "x") for _ in range(2))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    assert rows(scratch.materialise(spark.range(2), "y")) == [(0,), (1,)]


def test_bucketed_tables_join_without_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = tables.replace_table(spark.range(50), tables.fresh_name(spark, "l"), bucket=("id", 4))
        right = tables.replace_table(
            spark.range(20).withColumnRenamed("id", "k"), tables.fresh_name(spark, "r"), bucket=("k", 4)
        )
        joined = left.join(right, F.col("id") == F.col("k"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scratch_is_in_the_checkpoint_folder(spark):
    df = scratch.materialise(spark.range(10).select((F.col("id") * 2).alias("x")), "numbers")
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        assert df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(base.lstrip("/"))
    assert rows(df) == rows(spark.range(10).select((F.col("id") * 2).alias("x")))


def test_a_failed_replacement_leaves_the_version_before(spark):
    name = tables.fresh_name(spark, "safe")
    tables.replace_version(spark.range(3), name)
    reader = spark.table(name)  # planned on the first version
    broken = spark.range(2).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        tables.replace_version(broken, name)
    assert spark.table(name).count() == reader.count() == 3
    assert tables.replace_version(spark.range(5).withColumn("x", F.lit(1)), name).columns == ["id", "x"]
    assert spark.table(name).count() == 5 and reader.count() == 3
    assert reader.columns == ["id"]
    gone = tables.retire_versions(spark, name)
    assert len(gone) >= 1 and tables.retire_versions(spark, name) == []
    assert spark.table(name).count() == 5
    with pytest.raises(Exception):
        reader.count()


def test_versions_kept_and_names_alike(spark):
    name = tables.fresh_name(spark, "kept")
    for n in (1, 2, 3):
        tables.replace_version(spark.range(n), name)
        tables.replace_version(spark.range(7), f"{name}_other")
    assert len(tables.retire_versions(spark, name, keep=2)) == 1
    assert len(tables.retire_versions(spark, name)) == 1
    assert (spark.table(name).count(), spark.table(f"{name}_other").count()) == (3, 7)


def test_appended_summary_equals_the_summary_of_all(spark):
    parts = [
        [(1, "a", 1.0, None), (2, None, 2.0, 1.0), (None, "z", 1.0, 1.0)],
        [],
        [(1, "c", None, 3.0), (1, "b", 4.0, 5.0), (3, None, None, None), (None, "y", 3.0, None)],
    ]
    kind = "account_id long, operation string, amount double, balance double"
    name = tables.fresh_name(spark, "partials")
    for k, part in enumerate(parts):
        got = credit.append_transactions(spark, name, spark.createDataFrame(part, kind))
        so_far = spark.createDataFrame([r for p in parts[: k + 1] for r in p], kind)
        expected = credit.transaction_summary(so_far)
        assert got.columns == expected.columns and rows(got) == rows(expected)


def test_a_failed_append_changes_nothing(spark):
    kind = "account_id long, operation string, amount double, balance double"
    name = tables.fresh_name(spark, "partials")
    one = spark.createDataFrame([(1, "a", 1.0, 2.0)], kind)
    before = rows(credit.append_transactions(spark, name, one))
    bad = one.withColumn("amount", F.raise_error(F.lit("torn")).cast("double"))
    with pytest.raises(Exception, match="torn"):
        credit.append_transactions(spark, name, bad)
    after = credit.append_transactions(spark, name, one.where("false"))
    assert rows(after) == before
