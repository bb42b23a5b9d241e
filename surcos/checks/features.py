"""Encoding, evaluation and the deterministic parts of the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from surcos.checks.registry import query
from surcos.checks.relational import rounded
from surcos.checks.standins import CALLS_SQL, calls, load
from surcos.operators import features, metrics
from surcos.operators.aggregate import distribution, value_counts
from surcos.operators.encoder import CategoryEncoder, category_labels
from surcos.operators.split import hash_sample
from surcos.plans import telecom
from surcos.sources.scratch import materialise


def rank_sql(table: str, column: str) -> str:
    return f"""SELECT {column} AS value, count(*) AS n,
        row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS idx
      FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}"""


@query("category_index", rank_sql("part", "p_name").replace("AS idx", 'AS "index"'))
def category_index(spark, sf):
    return features.category_index(load(spark, sf, "part"), "p_name")


@query("string_index", f"""SELECT o_orderkey, o_orderpriority, idx AS priority_index
  FROM orders JOIN ({rank_sql("orders", "o_orderpriority")}) ON value = o_orderpriority""")
def string_index(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return features.string_index(df, "o_orderpriority", "priority_index")


@query("string_index_fitted", f"""SELECT c_custkey, c_nationkey, idx AS nation_index
  FROM customer LEFT JOIN ({rank_sql("supplier", "s_nationkey")}) ON value = c_nationkey""")
def string_index_fitted(spark, sf):
    """Customers' nations by the suppliers' index; nations without suppliers give null."""
    fitted = features.category_index(load(spark, sf, "supplier"), "s_nationkey")
    df = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return features.string_index(df, "c_nationkey", "nation_index", fitted=fitted, unseen="keep")


@query("encoded_slots", f"""WITH p AS ({rank_sql("orders", "o_orderpriority")}), s AS ({rank_sql("orders", "o_orderstatus")})
  SELECT o_orderkey, {", ".join(f"CAST(p.idx = {i} AS DOUBLE) AS s{i}" for i in range(4))},
         {", ".join(f"CAST(s.idx = {i} AS DOUBLE) AS s{4 + i}" for i in range(2))}, o_totalprice AS s6
  FROM orders JOIN p ON p.value = o_orderpriority JOIN s ON s.value = o_orderstatus""")
def encoded_slots(spark, sf):
    """Two categories and a number as one vector, by a pipeline stage with its labels in a table."""
    df = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    stage = CategoryEncoder(inputCols=["o_orderpriority", "o_orderstatus"], numericCols=["o_totalprice"])
    encoded = features.fitted_pipeline(df, [stage]).transform(df)
    return features.vector_slots(encoded.select("o_orderkey", "features"), "features", [f"s{i}" for i in range(7)]).drop("features")


@query("category_labels", """SELECT 'p_name' AS "column", p_name AS value, count(*) AS n,
    row_number() OVER (ORDER BY count(*) DESC, p_name) - 1 AS "index" FROM part WHERE p_name IS NOT NULL GROUP BY p_name
  UNION ALL SELECT 'p_brand', p_brand, count(*), row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1
  FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand""")
def labels_of_categories(spark, sf):
    """The label table of two category columns, one of them a name with any number of values."""
    return category_labels(load(spark, sf, "part").select("p_name", "p_brand"), ["p_name", "p_brand"])


@query("label_index", f"""WITH l AS (
    SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'Candidato' ELSE 'No candidato' END AS candidato
    FROM orders)
  SELECT o_orderkey, candidato, CAST(idx AS DOUBLE) AS label
  FROM l JOIN ({rank_sql("l", "candidato")}) ON value = candidato""")
def label_index(spark, sf):
    label = F.when(F.col("o_orderstatus").isin("F", "O"), "Candidato").otherwise("No candidato")
    df = load(spark, sf, "orders").select("o_orderkey", label.alias("candidato"))
    return features.label_index(df, "candidato", "label")


ONE_HOT_SQL = f"""ranked AS ({rank_sql("customer", "c_mktsegment")}),
  hot AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
            {", ".join(f"CAST(idx = {i} AS INTEGER) AS segment_{i}" for i in range(4))}
          FROM customer JOIN ranked ON value = c_mktsegment)"""


def _one_hot(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return features.one_hot_vector(df, "c_mktsegment", "segment")


@query("one_hot", f"WITH {ONE_HOT_SQL} SELECT * FROM hot")
def one_hot(spark, sf):
    names = [f"segment_{i}" for i in range(4)]
    spread = features.vector_slots(_one_hot(spark, sf), "segment", names).drop("segment")
    return spread.withColumns({n: F.col(n).cast("int") for n in names})


@query("one_hot_named", """SELECT c_custkey, c_mktsegment, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS segment_0,
    CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS segment_1 FROM customer""")
def one_hot_named(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return features.one_hot(df, "c_mktsegment", ["MACHINERY", "BUILDING"], "segment")


@query("assembled", f"""WITH {ONE_HOT_SQL}
  SELECT c_custkey, {", ".join(f"CAST(segment_{i} AS DOUBLE) AS f{i}" for i in range(4))},
         CAST(c_nationkey AS DOUBLE) AS f4, c_acctbal AS f5 FROM hot""")
def assembled(spark, sf):
    vectors = features.assemble(_one_hot(spark, sf), ["segment", "c_nationkey", "c_acctbal"]).select("c_custkey", "features")
    return features.vector_slots(vectors, "features", [f"f{i}" for i in range(6)]).drop("features")


# --- classifier metrics -------------------------------------------------------

@query("balanced_accuracy", """SELECT o_orderpriority,
    round((count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 250000) / CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE)
     + count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice <= 250000) / CAST(count(*) FILTER (WHERE o_orderstatus <> 'F') AS DOUBLE)) / 2, 9) AS auc
  FROM orders GROUP BY o_orderpriority""")
def balanced_accuracy(spark, sf):
    df = load(spark, sf, "orders").select(
        "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_totalprice") > 250000).cast("int").alias("prediction"),
    )
    return rounded(metrics.balanced_accuracy(df, "label", "prediction", "o_orderpriority"), 9, "auc")


ROC_SQL = """steps AS (
  SELECT value AS score, count(*) FILTER (WHERE event_type = 'purchase') AS pos,
         count(*) FILTER (WHERE event_type <> 'purchase') AS neg
  FROM events GROUP BY value),
curve AS (SELECT score, CAST(sum(pos) OVER w AS DOUBLE) / sum(pos) OVER () AS tpr,
                 CAST(sum(neg) OVER w AS DOUBLE) / sum(neg) OVER () AS fpr
          FROM steps WINDOW w AS (ORDER BY score DESC))"""


def _purchases(spark, sf):
    return load(spark, sf, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("label"), "value"
    )


@query("roc_bounded", """WITH b AS (
    SELECT least(floor((value - lo) / (hi - lo) * 800), 799) AS bin, count(*) FILTER (WHERE event_type = 'purchase') AS pos,
           count(*) FILTER (WHERE event_type <> 'purchase') AS neg, min(value) AS low, max(value) AS high
    FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) WHERE value IS NOT NULL GROUP BY bin),
  c AS (SELECT *, sum(pos + neg) OVER (ORDER BY bin DESC) AS cum, sum(pos + neg) OVER () AS total FROM b),
  g AS (SELECT floor((cum - 1) * 49 / total) AS grp, sum(pos) AS pos, sum(neg) AS neg, min(low) AS low, max(high) AS high
        FROM c GROUP BY grp)
  SELECT round(CAST(sum(neg) OVER w / sum(neg) OVER () AS DOUBLE), 9) AS fpr, round(CAST(sum(pos) OVER w / sum(pos) OVER () AS DOUBLE), 9) AS tpr,
         low AS score, CASE WHEN low < high THEN round(CAST(pos * neg / (2 * sum(pos) OVER () * sum(neg) OVER ()) AS DOUBLE), 12) ELSE 0 END AS lost
  FROM g WINDOW w AS (ORDER BY grp)
  UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, NULL, 0.0::DOUBLE""")
def roc_bounded(spark, sf):
    """At most 50 points of the curve, and what each group of scores can cost the area."""
    curve = metrics.roc_bounded(_purchases(spark, sf), "label", "value", points=50, fine=16)
    return rounded(rounded(curve, 9, "fpr", "tpr"), 12, "lost")


@query("roc_curve", f"""WITH {ROC_SQL}
  SELECT round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, score FROM curve
  UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, NULL""")
def roc_curve(spark, sf):
    return rounded(metrics.roc_curve(_purchases(spark, sf), "label", "value"), 9, "fpr", "tpr")


@query("auc_score", f"""WITH {ROC_SQL},
  points AS (SELECT fpr, tpr FROM curve UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE),
  pairs AS (SELECT fpr, tpr, lag(fpr) OVER w AS f0, lag(tpr) OVER w AS t0 FROM points
            WINDOW w AS (ORDER BY fpr, tpr))
  SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 9) AS auc FROM pairs""")
def auc_score(spark, sf):
    return rounded(metrics.auc_score(_purchases(spark, sf), "label", "value"), 9, "auc")


# --- clusters -----------------------------------------------------------------

CLUSTER_COLUMNS = ["number_customer_service_calls", "number_vmail_messages", "total_day_calls"]
_DISTANCE = " + ".join(f"(p.{c} - k.{c}) * (p.{c} - k.{c})" for c in CLUSTER_COLUMNS)
CLUSTER_SQL = f"""{CALLS_SQL},
points AS (SELECT account, voice_mail_plan, area_code, {", ".join(CLUSTER_COLUMNS)} FROM calls),
centres AS (SELECT row_number() OVER (ORDER BY area_code) - 1 AS c,
                   {", ".join(f"avg({c}) AS {c}" for c in CLUSTER_COLUMNS)}
            FROM points GROUP BY area_code),
clustered AS (
  SELECT account, {", ".join(CLUSTER_COLUMNS)}, CAST(c AS INTEGER) AS cluster FROM (
    SELECT p.*, k.c, row_number() OVER (PARTITION BY account ORDER BY {_DISTANCE}, k.c) AS near
    FROM points p, centres k) WHERE near = 1)"""


def clustered(spark, sf):
    """Customers by the nearest of their market segments' mean points."""
    df = telecom.cleaned(calls(spark, sf)).select("account", "area_code", *CLUSTER_COLUMNS)
    df = materialise(df, "points")
    centres = metrics.group_centres(df, "area_code", CLUSTER_COLUMNS)
    return metrics.nearest_centre(df.drop("area_code"), CLUSTER_COLUMNS, centres)


@query("nearest_centre", f"WITH {CLUSTER_SQL} SELECT * FROM clustered")
def nearest_centre(spark, sf):
    return clustered(spark, sf)


@query("cluster_sizes", f"WITH {CLUSTER_SQL} SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster")
def cluster_sizes(spark, sf):
    return distribution(clustered(spark, sf), "cluster")


@query("cluster_sizes_sampled", f"""WITH {CLUSTER_SQL} SELECT cluster, count(*) AS n FROM clustered
  WHERE CAST(('0x' || substr(md5(account || 'sample'), 1, 8)) AS BIGINT) % 100 < 50 GROUP BY cluster""")
def cluster_sizes_sampled(spark, sf):
    return value_counts(hash_sample(clustered(spark, sf), "account", 50), "cluster")


_PAIR = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in CLUSTER_COLUMNS)


@query("silhouette", f"""WITH {CLUSTER_SQL},
  far AS (SELECT p.account, p.cluster AS own, q.cluster AS other, sum({_PAIR}) AS d, count(*) AS n
          FROM clustered p, clustered q GROUP BY ALL),
  ab AS (SELECT account,
           max(CASE WHEN own = other AND n > 1 THEN d / (n - 1) END) AS a,
           min(CASE WHEN own <> other THEN d / n END) AS b
         FROM far GROUP BY account)
  SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0
                        ELSE (b - a) / greatest(a, b) END), 8) AS silhouette FROM ab""")
def silhouette(spark, sf):
    return rounded(metrics.silhouette(clustered(spark, sf), CLUSTER_COLUMNS), 8, "silhouette")
