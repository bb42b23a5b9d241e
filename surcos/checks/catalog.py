"""Sources, sinks, tables and views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from surcos.checks.registry import query
from surcos.checks.standins import CALLS_SQL, calls, load
from surcos.operators import clean
from surcos.plans import telecom
from surcos.sources import delimited, tables
from surcos.sources.scratch import scratch_path

CUSTOMER = StructType(
    [
        StructField("c_custkey", LongType()),
        StructField("c_name", StringType()),
        StructField("c_nationkey", IntegerType()),
        StructField("c_acctbal", DoubleType()),
        StructField("c_mktsegment", StringType()),
    ]
)


def exported(spark, sf, table, sep=",", columns=("*",)):
    """A given table written as delimited text."""
    return delimited.write_delimited(
        load(spark, sf, table).select(*columns), scratch_path(spark, table), sep=sep
    )


@query("csv_table_inferred", """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_nationkey,
  c_acctbal, c_mktsegment FROM customer""")
def csv_table_inferred(spark, sf):
    path = exported(spark, sf, "customer", sep=";")
    name = tables.fresh_name(spark, "customer")
    df = delimited.delimited_table(spark, name, path, sep=";", infer=True)
    return df.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("csv_table_strings", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer""")
def csv_table_strings(spark, sf):
    path = exported(spark, sf, "customer", columns=("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    return delimited.delimited_table(spark, tables.fresh_name(spark, "strings"), path)


@query("csv_table_ddl", """SELECT o_orderkey, o_custkey, o_orderstatus,
  round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 1) AS o_totalprice FROM orders""")
def csv_table_ddl(spark, sf):
    columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = exported(spark, sf, "orders", sep=";", columns=columns)
    ddl = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice FLOAT"
    df = delimited.delimited_table(spark, tables.fresh_name(spark, "ddl"), path, sep=";", ddl=ddl)
    return df.withColumn("o_totalprice", F.round(F.col("o_totalprice").cast("double"), 1))


@query("csv_struct_schema", "SELECT * FROM customer")
def csv_struct_schema(spark, sf):
    return delimited.read_delimited(spark, exported(spark, sf, "customer"), schema=CUSTOMER)


@query("csv_inferred", """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_brand, p_type, p_size,
  p_retailprice FROM part""")
def csv_inferred(spark, sf):
    df = delimited.read_delimited(spark, exported(spark, sf, "part"), infer=True)
    return df.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("csv_calls", f"""WITH {CALLS_SQL}
  SELECT {", ".join(c for c in telecom.CATEGORIES if c not in ("account", "phone_number"))},
         {", ".join(telecom.MEASURES)}, churn FROM calls""")
def csv_calls(spark, sf):
    """The 21-column call table with a dotted header, read with its declared schema."""
    path = delimited.write_delimited(calls(spark, sf), scratch_path(spark, "calls"))
    raw = delimited.read_delimited(spark, path, schema=telecom.CALLS)
    return telecom.described(telecom.cleaned(raw))


@query("csv_dated", "SELECT CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y FROM orders")
def csv_dated(spark, sf):
    """Day-first dates in two notations and year-first ones, as text in a file."""
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd-MM-yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    path = scratch_path(spark, "dated")
    source = load(spark, sf, "orders").select(text.alias("Fecha"), F.col("o_totalprice").alias("Trafico"))
    return delimited.read_dated(spark, delimited.write_delimited(source, path), "Fecha", "Trafico")


@query("replace_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def replace_table(spark, sf):
    name = tables.fresh_name(spark, "replaced")
    tables.replace_table(load(spark, sf, "nation"), name)
    return tables.replace_table(load(spark, sf, "supplier"), name)


@query("ctas_roundtrip", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n
  FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def ctas_roundtrip(spark, sf):
    df = load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n")
    )
    return tables.replace_table(df, tables.fresh_name(spark, "summary"))


@query("insert_cast", """SELECT CAST(c_custkey AS VARCHAR) AS "customerID", c_mktsegment AS gender,
  round(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE), 2) AS "MontlyCharges" FROM customer""")
def insert_cast(spark, sf):
    """An all-text file inserted into a typed table."""
    columns = ("c_custkey", "c_mktsegment", "c_acctbal")
    text = delimited.read_delimited(spark, exported(spark, sf, "customer", columns=columns))
    name = tables.fresh_name(spark, "typed")
    tables.create_empty(spark, name, "customerID STRING, gender STRING, MontlyCharges FLOAT")
    df = tables.insert_select(text, name)
    return df.withColumn("MontlyCharges", F.round(F.col("MontlyCharges").cast("double"), 2))


@query("view_query", """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY o_orderpriority""")
def view_query(spark, sf):
    name = tables.fresh_name(spark, "st")
    tables.replace_view(
        spark, name,
        f"SELECT o_orderpriority, o_totalprice AS total FROM parquet.`{sf}/orders.parquet`",
    )
    return spark.sql(
        f"SELECT o_orderpriority, count(*) AS n, round(sum(total), 2) AS total FROM {name} GROUP BY ALL"
    )


@query("temp_view_sql", """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 8) AS mean_balance
  FROM customer GROUP BY c_mktsegment""")
def temp_view_sql(spark, sf):
    view = tables.session_view(load(spark, sf, "customer"), "surcos_customer")
    return spark.sql(
        f"SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 8) AS mean_balance "
        f"FROM {view} GROUP BY c_mktsegment"
    )


@query("empty_typed_table", "SELECT c_custkey, c_name FROM customer")
def empty_typed_table(spark, sf):
    """An empty table with the columns and types of a given one, then filled from it."""
    source = load(spark, sf, "customer").select("c_custkey", "c_name")
    name = tables.fresh_name(spark, "empty")
    tables.create_empty(spark, name, source.schema)
    return tables.insert_select(source, name)


@query("describe_table", """SELECT column_name AS col_name, CASE column_type WHEN 'VARCHAR' THEN 'string'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS data_type
  FROM (DESCRIBE orders)""")
def describe_table(spark, sf):
    name = tables.fresh_name(spark, "described")
    tables.replace_table(load(spark, sf, "orders"), name)
    return tables.describe(spark, name).select("col_name", "data_type")


@query("replaced_version", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def replaced_version(spark, sf):
    """A name that shows its second version after a switch; the first is retired."""
    name = tables.fresh_name(spark, "versioned")
    tables.replace_version(load(spark, sf, "nation"), name)
    shown = tables.replace_version(load(spark, sf, "supplier"), name)
    tables.retire_versions(spark, name)
    return shown


@query("preview")
def preview(spark, sf):
    return tables.preview(clean.pick(load(spark, sf, "orders"), ["o_orderkey", "o_totalprice"]), 20)
