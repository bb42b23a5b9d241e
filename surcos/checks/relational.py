"""Projections, joins, scalar functions and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from surcos.checks.registry import query
from surcos.checks.standins import (
    BANK_SQL, CALLS_SQL, FREQUENCY, LOAN_SQL, STATUSES, bank, calls, load, shop,
)
from surcos.functions.scalar import (
    binary_label, code_map, gender_from_digits, parse_date, rescale, yymmdd_to_date,
)
from surcos.operators import clean, joins, order, skew
from surcos.operators.aggregate import distribution
from surcos.plans import credit, retail, telecom
from surcos.session import shuffle_width

MEANS = "round(monto_dinero_promedio, 6) AS monto_dinero_promedio, round(balance_promedio, 6) AS balance_promedio"


def rounded(df, digits, *columns):
    """Means and sums depend on the order of addition in their last bits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def bank_means(df):
    return rounded(df, 6, "monto_dinero_promedio", "balance_promedio")


# --- projections and cleaning -------------------------------------------------

@query("select_all", "SELECT * FROM orders")
def select_all(spark, sf):
    return load(spark, sf, "orders")


@query(
    "select_columns",
    "SELECT l_orderkey, l_returnflag, l_extendedprice FROM lineitem",
)
def select_columns(spark, sf):
    return clean.pick(load(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag", "l_extendedprice"])


@query(
    "rename_in_projection",
    'SELECT o_orderdate AS "Fecha", o_totalprice AS total FROM orders',
)
def rename_in_projection(spark, sf):
    return clean.pick(load(spark, sf, "orders"), {"o_orderdate": "Fecha", "o_totalprice": "total"})


@query(
    "rename_dotted_column",
    f"WITH {CALLS_SQL} SELECT account, churn_raw AS churn FROM raw_calls",
)
def rename_dotted_column(spark, sf):
    raw = calls(spark, sf)
    return clean.rename(raw, {"churn.": "churn"}).select("account", "churn")


@query(
    "drop_column",
    "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
)
def drop_column(spark, sf):
    return load(spark, sf, "supplier").drop("s_acctbal")


@query(
    "add_replace_column",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
              l_discount, round(l_tax * 100, 4) AS l_tax, l_returnflag, l_linestatus, l_shipdate,
              round(l_extendedprice * (1 - l_discount), 4) AS net
       FROM lineitem""",
)
def add_replace_column(spark, sf):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return load(spark, sf, "lineitem").withColumns({"l_tax": F.round(F.col("l_tax") * 100, 4), "net": net})


@query(
    "rename_drop_select",
    """SELECT c_custkey AS client_id, c_mktsegment AS segment, c_acctbal AS balance,
              c_acctbal < 0 AS overdrawn FROM customer""",
)
def rename_drop_select(spark, sf):
    df = clean.rename(
        load(spark, sf, "customer"),
        {"c_custkey": "client_id", "c_mktsegment": "segment", "c_acctbal": "balance"},
    )
    return df.withColumn("overdrawn", F.col("balance") < 0).drop("c_name", "c_nationkey")


@query(
    "drop_nulls",
    f"""WITH {BANK_SQL} SELECT loan_id, client_id, operation, monto_prestamo FROM minable
        WHERE client_id IS NOT NULL AND operation IS NOT NULL""",
)
def drop_nulls(spark, sf):
    table = credit.minable(bank(spark, sf), FREQUENCY)
    return clean.drop_nulls(table.select("loan_id", "client_id", "operation", "monto_prestamo"))


@query(
    "candidate_label",
    """SELECT o_orderkey, o_orderstatus,
              CASE WHEN o_orderstatus IN ('F', 'O') THEN 'Candidato' ELSE 'No candidato' END AS candidato
       FROM orders""",
)
def candidate_label(spark, sf):
    label = binary_label(F.col("o_orderstatus"), list(STATUSES), credit.YES, credit.NO)
    return load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", label.alias("candidato"))


# --- joins --------------------------------------------------------------------

@query("dim_left_join", f"""WITH {BANK_SQL}
  SELECT client_id, district_id, genero, districtid, distrito, region, habitantes, salario_promedio
  FROM people LEFT JOIN figures ON districtid = district_id""")
def dim_left_join(spark, sf):
    b = bank(spark, sf)
    return joins.with_dimension(
        credit.client_part(b), credit.district_part(b), "district_id", "districtid"
    )


@query("link_inner_join", f"""WITH {BANK_SQL}
  SELECT client_id, district_id, genero, client_id AS c_id, held AS account_id, tipo_disposicion_cliente,
         o_orderkey AS ac_id, frecuencia_emision
  FROM priced JOIN holding ON held = o_orderkey""")
def link_inner_join(spark, sf):
    b = bank(spark, sf)
    return joins.through_link(
        credit.client_part(b), credit.disp_part(b), credit.account_part(b, FREQUENCY),
        entity_key="client_id", link_entity="c_id", link_target="account_id", target_key="ac_id",
    )


@query("loan_right_join", f"""WITH {BANK_SQL}
  SELECT l_suppkey AS c_id, l_orderkey AS account_id, l_linestatus AS tipo_disposicion_cliente,
         o_orderkey AS loan_id, o_orderkey AS acl_id, o_totalprice AS monto_prestamo, o_orderstatus AS estado
  FROM priced LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def loan_right_join(spark, sf):
    b = bank(spark, sf)
    loans = credit.loan_part(b).select("loan_id", "acl_id", "monto_prestamo", "estado")
    return skew.keep_right_join(credit.disp_part(b), loans, "account_id", "acl_id")


@query("loan_left_join", f"""WITH {BANK_SQL}
  SELECT l_suppkey AS c_id, l_orderkey AS account_id, l_linestatus AS tipo_disposicion_cliente, {LOAN_SQL}
  FROM lineitem LEFT JOIN priced ON l_orderkey = o_orderkey""")
def loan_left_join(spark, sf):
    b = bank(spark, sf)
    return joins.with_dimension(credit.disp_part(b), credit.loan_part(b), "account_id", "acl_id")


@query("two_sided_join", """SELECT c_custkey, s_suppkey, c.n_regionkey AS region
  FROM (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey) AS c
  JOIN (SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey) AS s
    ON c.n_regionkey = s.n_regionkey""")
def two_sided_join(spark, sf):
    """Customers and suppliers of a region: five keys, each hot on both sides, dealt out over grids in packs."""
    nation = load(spark, sf, "nation").select("n_nationkey", "n_regionkey")

    def side(table, key, home, region):
        df = load(spark, sf, table).select(key, home).join(nation, F.col(home) == F.col("n_nationkey"))
        return df.select(key, F.col("n_regionkey").alias(region))

    left, right = side("customer", "c_custkey", "c_nationkey", "region"), side("supplier", "s_suppkey", "s_nationkey", "r")
    sides = (left, "region"), (right, "r")
    profiles = [skew.profile_key(df, k) for df, k in sides]
    tasks = skew.pair_tasks(*profiles, shuffle_width(spark))
    cells = skew.grid_cells(*[p.hot for p in profiles], tasks)
    packs = [skew.pack(skew.deal(df, k, cells, axis), k, cells, axis, profiles[axis]) for axis, (df, k) in enumerate(sides)]
    pairs = skew.unpack(skew.grid_join(*packs, "region", "r", cells, tasks), "region")
    return pairs.select("c_custkey", "s_suppkey", "region")


@query("restricted_summary", """SELECT l_orderkey AS account_id, max(l_returnflag) AS operation,
    round(avg(l_extendedprice), 6) AS monto_dinero_promedio, round(avg(l_quantity), 6) AS balance_promedio,
    count(*) AS cantidad_transacciones
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 0.9 * max(o_totalprice) FROM orders))
  GROUP BY l_orderkey""")
def restricted_summary(spark, sf):
    """Transactions of the few accounts whose loan is among the largest, restricted before they are summarised."""
    b = bank(spark, sf)
    loans = credit.loan_part(b)
    large = loans.where(F.col("monto_prestamo") > loans.agg(0.9 * F.max("monto_prestamo")).scalar())
    few = joins.few_keys(large, "acl_id", skew.profile_key(large, "acl_id"), b.account.count())
    return bank_means(credit.transaction_summary(joins.restrict(b.trans, "account_id", few)))


@query("minable_short", f"""WITH {BANK_SQL}
  SELECT holding.* EXCLUDE (held), client_id AS c_id, held AS account_id, held AS ac_id, frecuencia_emision, {LOAN_SQL}
  FROM holding JOIN priced ON held = o_orderkey""")
def minable_short(spark, sf):
    return credit.minable_short(bank(spark, sf), FREQUENCY)


@query("summary_left_join", f"""WITH {BANK_SQL}
  SELECT loan_id, acl_id, monto_prestamo, act_id, operation, {MEANS}, cantidad_transacciones
  FROM (SELECT o_orderkey AS loan_id, o_orderkey AS acl_id, o_totalprice AS monto_prestamo FROM orders)
  LEFT JOIN turnover ON act_id = acl_id""")
def summary_left_join(spark, sf):
    b = bank(spark, sf)
    loans = credit.loan_part(b).select("loan_id", "acl_id", "monto_prestamo")
    return bank_means(joins.with_summary(loans, credit.summary_part(b), "acl_id", "act_id"))


@query("minable_table", f"""WITH {BANK_SQL}
  SELECT * EXCLUDE (monto_dinero_promedio, balance_promedio), {MEANS} FROM minable""")
def minable_table(spark, sf):
    return bank_means(credit.minable(bank(spark, sf), FREQUENCY))


@query("minable_clean", f"""WITH {BANK_SQL}
  SELECT * EXCLUDE (monto_dinero_promedio, balance_promedio), {MEANS} FROM model""")
def minable_clean(spark, sf):
    return bank_means(credit.candidates(bank(spark, sf), FREQUENCY, STATUSES, key="loan_id"))


@query("minable_short_clean", f"""WITH {BANK_SQL}
  SELECT CAST(district_id AS VARCHAR) AS district_id, region, habitantes, ratio_residentes_urbanos,
         salario_promedio, frecuencia_emision, o_totalprice AS monto_prestamo, months AS duracion_prestamo,
         o_totalprice / months AS pagos_mensuales, if(o_orderstatus IN ('F', 'O'), 'Candidato', 'No candidato') AS candidato
  FROM holding JOIN priced ON held = o_orderkey
  WHERE region IS NOT NULL AND habitantes IS NOT NULL AND o_totalprice IS NOT NULL""")
def minable_short_clean(spark, sf):
    return credit.candidates_short(bank(spark, sf), FREQUENCY, STATUSES)


@query("candidate_balance", f"""WITH {BANK_SQL}
  SELECT candidato, count(*) AS n FROM model GROUP BY candidato""")
def candidate_balance(spark, sf):
    return distribution(credit.candidates(bank(spark, sf), FREQUENCY, STATUSES), "candidato")


@query("fanout_sizes", """SELECT l_partkey AS product_id, count(*) * count(*) AS view_rows,
    round(count(*) * sum(l_quantity), 2) AS moved_qty
  FROM lineitem GROUP BY l_partkey""")
def fanout_sizes(spark, sf):
    return rounded(retail.joined_size(shop(spark, sf)), 2, "moved_qty")


@query("fanout_join", """WITH moved AS (
    SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS product_qty, max(l_linenumber) AS location_dest_id
    FROM lineitem GROUP BY l_partkey)
  SELECT l.l_suppkey AS cliente_id, l.l_partkey AS product_id, l.l_quantity AS product_uom_qty,
         l.l_extendedprice AS price_total, p_partkey AS "ID", p_retailprice AS "Preciodeventa",
         p_size AS "Cantidadamano", p_name AS "Nombre", m.l_partkey AS pid,
         round(product_qty, 2) AS product_qty, location_dest_id
  FROM moved m RIGHT JOIN lineitem l ON m.l_partkey = l.l_partkey
  LEFT JOIN part ON p_partkey = l.l_partkey""")
def fanout_join(spark, sf):
    """The join itself, in full: with the moves of a product added up first, it has a row per sale."""
    s = shop(spark, sf)
    moves = s.moves.groupBy("product_id").agg(
        F.sum("product_qty").alias("product_qty"), F.max("location_dest_id").alias("location_dest_id")
    )
    return rounded(retail.joined(retail.Shop(s.sales, s.products, moves)), 2, "product_qty")


@query("client_summary_fanout", """WITH moved AS (
    SELECT l_partkey AS part, count(*) AS times, sum(l_quantity) AS qty, max(l_linenumber) AS farthest
    FROM lineitem GROUP BY l_partkey)
  SELECT l_suppkey AS cliente_id, max(farthest) AS prod_dest, max(p_name) AS "Nombre",
         CAST(sum(times) AS BIGINT) AS cantidad_compras, round(sum(qty), 2) AS prod_mov,
         round(sum(p_size * times) / sum(times) FILTER (WHERE p_size IS NOT NULL), 6) AS stock,
         round(sum(l_quantity * times) / sum(times), 6) AS prod_vendido,
         round(sum(l_extendedprice * times) / sum(times), 5) AS precio_total
  FROM lineitem JOIN moved ON part = l_partkey LEFT JOIN part ON p_partkey = l_partkey
  GROUP BY l_suppkey""")
def client_summary_fanout(spark, sf):
    df = retail.client_summary(shop(spark, sf))
    df = rounded(rounded(df, 5, "precio_total"), 6, "prod_vendido", "stock")
    return rounded(df, 2, "prod_mov")


# --- scalar functions ---------------------------------------------------------

@query("gender_from_digits", f"WITH {BANK_SQL} SELECT client_id, district_id, genero FROM people")
def gender(spark, sf):
    b = bank(spark, sf)
    return b.client.select(
        "client_id", "district_id", gender_from_digits(F.col("birth_number")).alias("genero")
    )


@query("code_map", f"WITH {BANK_SQL} SELECT o_orderkey AS ac_id, frecuencia_emision FROM priced")
def codes(spark, sf):
    b = bank(spark, sf)
    return b.account.select(
        F.col("account_id").alias("ac_id"),
        code_map(F.col("frequency"), FREQUENCY).alias("frecuencia_emision"),
    )


@query("trim_counts", f"""WITH {CALLS_SQL}
  SELECT churn, count(*) AS n FROM calls GROUP BY churn""")
def trim_counts(spark, sf):
    return distribution(telecom.cleaned(calls(spark, sf)), "churn")


@query("cast_category", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def cast_category(spark, sf):
    return clean.as_category(load(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"])


@query("parse_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds FROM orders""")
def parse_dates(spark, sf):
    """Each order's date written in one of three notations, by status, and read back."""
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "d-M-yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return load(spark, sf, "orders").select("o_orderkey", parse_date(text).alias("ds"))


@query("yymmdd_date", "SELECT o_orderkey AS account_id, CAST(o_orderdate AS DATE) AS ds FROM orders")
def yymmdd(spark, sf):
    return bank(spark, sf).account.select("account_id", yymmdd_to_date(F.col("date")).alias("ds"))


@query("column_arithmetic", """SELECT p_partkey,
    round((p_retailprice - 900) / (2000 - 900), 8) AS scaled,
    round(sqrt(p_retailprice), 8) AS root,
    round(abs((p_retailprice - p_size) / nullif(p_retailprice, 0)) * 100, 6) AS pct,
    CASE WHEN p_size > 0 THEN round(p_retailprice / p_size, 6) END AS unit
  FROM part""")
def column_arithmetic(spark, sf):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return load(spark, sf, "part").select(
        "p_partkey",
        F.round(rescale(price, F.lit(900.0), F.lit(2000.0)), 8).alias("scaled"),
        F.round(F.sqrt(price), 8).alias("root"),
        F.round(F.abs(F.try_divide(price - size, price)) * 100, 6).alias("pct"),
        F.round(F.try_divide(price, size), 6).alias("unit"),
    )


# --- sorts and limits ---------------------------------------------------------

@query("bottom_k", f"""WITH {CALLS_SQL}
  SELECT number_customer_service_calls, phone_number FROM calls
  ORDER BY number_customer_service_calls NULLS FIRST, phone_number LIMIT 5""")
def bottom_k(spark, sf):
    df = telecom.cleaned(calls(spark, sf)).select("number_customer_service_calls", "phone_number")
    return order.bottom_k(df, "number_customer_service_calls", 5, "phone_number")


@query("top_k", f"""WITH {CALLS_SQL}
  SELECT number_customer_service_calls, phone_number FROM calls
  ORDER BY number_customer_service_calls DESC NULLS LAST, phone_number LIMIT 5""")
def top_k(spark, sf):
    df = telecom.cleaned(calls(spark, sf)).select("number_customer_service_calls", "phone_number")
    return order.top_k(df, "number_customer_service_calls", 5, "phone_number")


@query("top_k_text", """SELECT o_orderpriority, o_orderkey FROM orders
  ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey LIMIT 5""")
def top_k_text(spark, sf):
    return order.top_k(
        load(spark, sf, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", 5, "o_orderkey"
    )


@query("chronological_sort", """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds,
  o_orderkey FROM orders ORDER BY series_id, ds, o_orderkey""")
def chronological_sort(spark, sf):
    df = load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ds"), "o_orderkey"
    )
    return order.chronological(df, ties=["o_orderkey"])


@query("ordered_limit", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10""")
def ordered_limit(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)
