from __future__ import annotations

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from surcos.functions import scalar
from surcos.operators import clean


def values(spark, data, expr, schema="x string"):
    df = spark.createDataFrame([(v,) for v in data], schema)
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_gender_uses_padded_month_digits(spark):
    codes = [10203, 706213, 455123, 505000, None]
    got = values(spark, codes, scalar.gender_from_digits, "x int")
    assert got == ["hombre", "mujer", "mujer", "hombre", "mujer"]
    assert values(spark, ["010203"], scalar.gender_from_digits) == ["hombre"]


def test_code_map_and_label(spark):
    codes = ["POPLATEK MESICNE", "POPLATEK TYDNE", "POPLATEK PO OBRATU", "x", None]
    assert values(spark, codes, lambda c: scalar.code_map(c, scalar.FREQUENCIES)) == [
        "emision mensual", "emision semanal", "emision despues de una transaccion",
        "no especifica", "no especifica",
    ]
    label = lambda c: scalar.binary_label(c, ["A", "C"], "yes", "no")
    assert values(spark, ["A", "B", "C", None], label) == ["yes", "no", "yes", "no"]


def test_yymmdd(spark):
    got = values(spark, [930101, 203, 706213, 991350, None], scalar.yymmdd_to_date, "x int")
    d = dt.date
    assert got == [d(1993, 1, 1), d(2000, 2, 3), d(1970, 12, 13), None, None]


def test_parse_date_is_day_first(spark):
    got = values(spark, ["01/02/2024", "3-4-2024", "2024-05-06", "31/02/2024", "x", None], scalar.parse_date)
    d = dt.date
    assert got == [d(2024, 2, 1), d(2024, 4, 3), d(2024, 5, 6), None, None, None]


def test_arithmetic_does_not_fail_on_zero(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (3.0, 1.0, 5.0)], "x double, lo double, hi double")
    got = [r[0] for r in df.select(scalar.rescale(F.col("x"), F.col("lo"), F.col("hi"))).collect()]
    assert got == [None, 0.5]
    err = df.select(scalar.percentage_error(F.col("x") - 1, F.col("lo"))).collect()
    assert [r[0] for r in err] == [None, 50.0]


def test_drop_nulls(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, 1.0, "a"), (None, 1.0, "a"), (2, None, "a"), (3, 1.0, None), (4, nan, "a"), (None, None, None)],
        "i int, d double, s string",
    )
    assert rows(clean.drop_nulls(df)) == [(1, 1.0, "a")] == rows(df.na.drop())
    assert clean.drop_nulls(df, ["i"]).count() == 4


def test_drop_nulls_turns_outer_joins_inner(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 5.0)], "k2 int, w double")
    joined = a.join(b, F.col("k") == F.col("k2"), "left").select("v", "w")
    plan = clean.drop_nulls(joined)._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner" in plan and "LeftOuter" not in plan


def test_dotted_names(spark):
    df = spark.createDataFrame([(" a", 1), ("a ", 2), ("a", 3), (None, 4)], "`churn.` string, n int")
    renamed = clean.rename(df, {"churn.": "churn"})
    assert renamed.columns == ["churn", "n"]
    assert rows(clean.pick(df, {"churn.": "c"})) == rows(renamed.select("churn"))
    assert clean.drop_nulls(df).count() == 3
    trimmed = clean.trim_columns(renamed, ["churn"])
    assert {r["churn"] for r in trimmed.collect()} == {"a", None}


def test_as_category(spark):
    df = clean.as_category(spark.createDataFrame([(7,)], "k int"), ["k"])
    assert df.schema["k"].dataType.simpleString() == "string"
