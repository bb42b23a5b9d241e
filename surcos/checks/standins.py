"""The analyses' tables, derived from the whole of the given tables.

Each function states the mapping once as a DataFrame; ``SQL`` holds the same
mapping as common table expressions for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surcos.plans.credit import FREQUENCIES, Bank
from surcos.plans.retail import Shop

# Order priorities stand for the codes of the issue frequency, in the same order.
FREQUENCY = dict(zip(("1-URGENT", "2-HIGH", "3-MEDIUM"), FREQUENCIES.values()))
STATUSES = ("F", "O")


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def client(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as clients; the cents of the balance give six birth digits."""
    return load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("client_id"),
        F.col("s_nationkey").alias("district_id"),
        F.round(F.abs("s_acctbal") * 100).cast("int").alias("birth_number"),
    )


def district(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as districts, with figures from their customers."""
    people = (
        load(spark, sf, "customer")
        .groupBy("c_nationkey")
        .agg(
            F.count("*").cast("int").alias("A4"),
            F.count_if(F.col("c_acctbal") > 5000).cast("int").alias("A9"),
            (100.0 * F.count_if(F.col("c_mktsegment") == "BUILDING") / F.count("*")).alias("A10"),
            F.round(F.avg("c_acctbal"), 8).alias("A11"),
        )
    )
    nation = load(spark, sf, "nation")
    region = load(spark, sf, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_nationkey").alias("A1"),
        F.col("n_name").alias("A2"),
        F.col("r_name").alias("A3"),
        "A4", "A9", "A10", "A11",
    )


def disp(spark: SparkSession, sf: str) -> DataFrame:
    """Each order line entitles its supplier to the order: several per order, or none."""
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("client_id"),
        F.col("l_orderkey").alias("account_id"),
        F.col("l_linestatus").alias("type"),
    )


def account(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("account_id"),
        F.col("o_orderpriority").alias("frequency"),
        F.date_format("o_orderdate", "yyMMdd").cast("int").alias("date"),
    )


def loan(spark: SparkSession, sf: str) -> DataFrame:
    duration = F.substring("o_orderpriority", 1, 1).cast("int") * 12
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_orderkey").alias("account_id"),
        F.col("o_totalprice").alias("amount"),
        duration.alias("duration"),
        (F.col("o_totalprice") / duration).alias("payments"),
        F.col("o_orderstatus").alias("status"),
    )


def trans(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("account_id"),
        F.col("l_returnflag").alias("operation"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("balance"),
    )


def bank(spark: SparkSession, sf: str) -> Bank:
    return Bank(*[f(spark, sf) for f in (client, district, disp, account, loan, trans)])


def shop(spark: SparkSession, sf: str) -> Shop:
    """Order lines as sales to a supplier's account and as moves of the part."""
    lines = load(spark, sf, "lineitem")
    return Shop(
        lines.select(
            F.col("l_suppkey").alias("cliente_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("product_uom_qty"),
            F.col("l_extendedprice").alias("price_total"),
        ),
        load(spark, sf, "part").select(
            F.col("p_partkey").alias("ID"),
            F.col("p_retailprice").alias("Preciodeventa"),
            F.col("p_size").alias("Cantidadamano"),
            F.col("p_name").alias("Nombre"),
        ),
        lines.select(
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("product_qty"),
            F.col("l_linenumber").alias("location_dest_id"),
        ),
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the totals of their orders as the telecom call table.

    Orders of status F, O and P are the day, evening and night calls; the churn
    text carries stray blanks, and its column a dot, as in the file it stands for.
    """
    status = F.col("o_orderstatus")
    price = F.col("o_totalprice")
    totals = (
        load(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(
            *[
                e
                for part, s in (("day", "F"), ("eve", "O"), ("night", "P"))
                for e in (
                    F.count_if(status == s).cast("double").alias(f"total_{part}_calls"),
                    F.round(F.sum(F.when(status == s, price).otherwise(0.0)), 2).alias(
                        f"total_{part}_charge"
                    ),
                )
            ],
            F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"),
            F.count_if(F.col("o_orderpriority") == "2-HIGH").cast("double").alias("high"),
        )
    )
    nation = load(spark, sf, "nation")
    joined = (
        load(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    )

    def flag(cond):
        return F.when(cond, "yes").otherwise("no")

    minutes = {p: (F.col(f"total_{p}_calls") * 10).alias(f"total_{p}_minutes") for p in ("day", "eve", "night")}
    churn = F.when(F.col("c_acctbal") < 2500, "True.").otherwise("False.")
    blanks = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit(" "), churn)).when(
        F.col("c_mktsegment") == "MACHINERY", F.concat(churn, F.lit(" "))
    )
    return joined.select(
        F.col("n_name").alias("state"),
        F.col("c_custkey").cast("string").alias("account"),
        F.col("c_mktsegment").alias("area_code"),
        F.col("c_name").alias("phone_number"),
        flag(F.col("urgent") > 1).alias("international_plan"),
        flag(F.col("c_acctbal") > 5000).alias("voice_mail_plan"),
        F.col("high").alias("number_vmail_messages"),
        *[
            c
            for p in ("day", "eve", "night")
            for c in (minutes[p], F.col(f"total_{p}_calls"), F.col(f"total_{p}_charge"))
        ],
        (F.col("high") * 10).alias("total_intl_minutes"),
        F.col("high").alias("total_intl_calls"),
        (F.col("high") * 2.7).alias("total_intl_charge"),
        F.col("urgent").alias("number_customer_service_calls"),
        F.coalesce(blanks, churn).alias("churn."),
    )


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Dated invoices of several series: orders by priority."""
    return load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("serie"),
        F.col("o_orderdate").alias("Fecha"),
        F.col("o_totalprice").alias("total"),
    )


def traffic(spark: SparkSession, sf: str) -> DataFrame:
    """Dated events of several series: events by type."""
    return load(spark, sf, "events").select(
        F.col("event_type").alias("serie"), F.col("ts").alias("Fecha"), F.col("value").alias("Trafico")
    )


FREQUENCY_SQL = (
    "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FREQUENCY.items()) + " ELSE 'no especifica' END"
)
LOAN_SQL = """o_orderkey AS loan_id, o_orderkey AS acl_id, o_totalprice AS monto_prestamo,
         months AS duracion_prestamo, o_totalprice / months AS pagos_mensuales, o_orderstatus AS estado"""

# Written on the given tables: an order is an account and its loan at once, so the loans
# are the orders, and one derived table has all that is known of who holds an order.
BANK_SQL = f"""
priced AS (
  SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 12 AS months, {FREQUENCY_SQL} AS frecuencia_emision
  FROM orders),
figures AS (
  SELECT n_nationkey AS districtid, n_name AS distrito, r_name AS region,
         CAST(nullif(count(c_custkey), 0) AS INTEGER) AS habitantes,
         CASE WHEN count(c_custkey) > 0
              THEN CAST(count(*) FILTER (WHERE c_acctbal > 5000) AS INTEGER) END AS num_ciudades,
         count(*) FILTER (WHERE c_mktsegment = 'BUILDING') * 100.0::DOUBLE
           / nullif(count(c_custkey), 0) AS ratio_residentes_urbanos,
         round(avg(c_acctbal), 8) AS salario_promedio
  FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
  GROUP BY n_nationkey, n_name, r_name),
people AS (
  SELECT s_suppkey AS client_id, s_nationkey AS district_id,
         CASE WHEN CAST(round(abs(s_acctbal) * 100) AS BIGINT) // 100 % 100 <= 50
              THEN 'hombre' ELSE 'mujer' END AS genero
  FROM supplier),
holding AS (
  SELECT l_orderkey AS held, l_linestatus AS tipo_disposicion_cliente, people.*, figures.*
  FROM lineitem JOIN people ON client_id = l_suppkey LEFT JOIN figures ON districtid = district_id
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
turnover AS (
  SELECT l_orderkey AS act_id, max(l_returnflag) AS operation, sum(l_extendedprice) / count(l_extendedprice)
           AS monto_dinero_promedio, sum(l_quantity) / count(l_quantity) AS balance_promedio,
         count(*) AS cantidad_transacciones
  FROM lineitem GROUP BY l_orderkey),
minable AS (
  SELECT client_id, district_id, genero, districtid, distrito, region, habitantes, salario_promedio,
         client_id AS c_id, held AS account_id, tipo_disposicion_cliente, held AS ac_id,
         CASE WHEN held IS NOT NULL THEN frecuencia_emision END AS frecuencia_emision, {LOAN_SQL},
         turnover.*
  FROM priced LEFT JOIN holding ON held = o_orderkey LEFT JOIN turnover ON act_id = held),
model AS (
  SELECT loan_id, region, habitantes, salario_promedio, frecuencia_emision, monto_prestamo,
         duracion_prestamo, pagos_mensuales, operation, monto_dinero_promedio,
         balance_promedio, cantidad_transacciones,
         if(estado IN ('F', 'O'), 'Candidato', 'No candidato') AS candidato
  FROM minable
  WHERE len(list_filter([region, operation, estado, CAST(habitantes AS VARCHAR), CAST(salario_promedio AS VARCHAR),
                         CAST(monto_prestamo AS VARCHAR), CAST(pagos_mensuales AS VARCHAR),
                         CAST(monto_dinero_promedio AS VARCHAR), CAST(balance_promedio AS VARCHAR)],
                        lambda x: x IS NULL)) = 0)
"""

CALLS_SQL = """
totals AS (
  SELECT o_custkey,
    CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS total_day_calls,
    round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END), 2) AS total_day_charge,
    CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS total_eve_calls,
    round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0.0 END), 2) AS total_eve_charge,
    CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS total_night_calls,
    round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0.0 END), 2) AS total_night_charge,
    CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS urgent,
    CAST(count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS DOUBLE) AS high
  FROM orders GROUP BY o_custkey),
raw_calls AS (
  SELECT n_name AS state, CAST(c_custkey AS VARCHAR) AS account, c_mktsegment AS area_code,
    c_name AS phone_number,
    CASE WHEN urgent > 1 THEN 'yes' ELSE 'no' END AS international_plan,
    CASE WHEN c_acctbal > 5000 THEN 'yes' ELSE 'no' END AS voice_mail_plan,
    high AS number_vmail_messages,
    total_day_calls * 10 AS total_day_minutes, total_day_calls, total_day_charge,
    total_eve_calls * 10 AS total_eve_minutes, total_eve_calls, total_eve_charge,
    total_night_calls * 10 AS total_night_minutes, total_night_calls, total_night_charge,
    high * 10 AS total_intl_minutes, high AS total_intl_calls,
    high * CAST(2.7 AS DOUBLE) AS total_intl_charge,
    urgent AS number_customer_service_calls,
    CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' ELSE '' END
      || CASE WHEN c_acctbal < 2500 THEN 'True.' ELSE 'False.' END
      || CASE WHEN c_mktsegment = 'MACHINERY' THEN ' ' ELSE '' END AS churn_raw
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN totals ON c_custkey = o_custkey),
calls AS (
  SELECT * EXCLUDE (churn_raw), trim(churn_raw) AS churn FROM raw_calls
  WHERE number_customer_service_calls IS NOT NULL)
"""


def daily_sql(table: str, series: str, date: str, value: str) -> str:
    """``daily(series_id, ds, y)`` with zero-filled gaps, from a calendar join."""
    return f"""
sums AS (SELECT {series} AS series_id, CAST({date} AS DATE) AS ds, sum({value}) AS y
         FROM {table} GROUP BY ALL),
grid AS (SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
         FROM sums GROUP BY series_id),
daily AS (SELECT g.series_id, g.ds, coalesce(s.y, 0.0) AS y
          FROM grid g LEFT JOIN sums s ON s.series_id = g.series_id AND s.ds = g.ds)
"""


INVOICES_SQL = daily_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice")
TRAFFIC_SQL = daily_sql("events", "event_type", "ts", "value")
