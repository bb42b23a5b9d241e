"""Equi-joins that build denormalised analysis tables.

Dimension sides carry no broadcast hint: Catalyst broadcasts them when their size
is below ``spark.sql.autoBroadcastJoinThreshold`` (adaptive execution checks the
real size again) and sorts and merges otherwise, where adaptive execution splits
skewed partitions. Each function takes DataFrames whose column names do not clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surcos.operators.ranking import ordered_codes
from surcos.operators.skew import (
    KeyProfile, deal, grid_cells, grid_join, hot_keys, profile_key, salt, salted_join,
)
from surcos.session import shuffle_width

HOT_LOANS = 1000  # loans of an account, below which one task takes them all
FEW_KEYS = 1 << 20  # keys that a table may be restricted to by broadcast: some 30 MB
FEW_SHARE = 0.25  # of the keys there are, above which restricting is not worth a join


def with_dimension(facts: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left outer join; every fact is kept."""
    return facts.join(dim, F.col(key) == F.col(dim_key), "left")


def with_summary(facts: DataFrame, summary: DataFrame, key: str, summary_key: str) -> DataFrame:
    """Left outer join to a table that was aggregated by its key.

    Such a side is partitioned already, so adaptive execution cannot split a swollen
    partition of the facts: hot keys, and rows without a key, are dealt out by salt.
    Runs a Spark job to find them.
    """
    hot = hot_keys(facts, key)
    return salted_join(salt(facts, key, hot), summary, key, summary_key, "left", hot)


def through_link(
    entities: DataFrame,
    link: DataFrame,
    targets: DataFrame,
    *,
    entity_key: str,
    link_entity: str,
    link_target: str,
    target_key: str,
) -> DataFrame:
    """Inner join of two tables through a link table; one row per link."""
    linked = link.join(entities, F.col(link_entity) == F.col(entity_key))
    joined = linked.join(targets, F.col(link_target) == F.col(target_key))
    return joined.select(*entities.columns, *link.columns, *targets.columns)


def few_keys(df: DataFrame, key: str, profile: KeyProfile, all_keys: int) -> DataFrame | None:
    """The distinct keys of a table as ``_few``, if they are few of ``all_keys``; else None."""
    if profile.keys > min(FEW_KEYS, FEW_SHARE * all_keys):
        return None
    return df.select(F.col(key).alias("_few")).where("_few IS NOT NULL").distinct()


def restrict(df: DataFrame, key: str, few: DataFrame | None) -> DataFrame:
    """The rows whose key is among ``few``, before anything is shuffled; all of them for None.

    Only for results that the other rows cannot reach. The hint is safe, as ``few`` comes
    from :func:`few_keys`, which counted it.
    """
    return df if few is None else df.join(F.broadcast(few), F.col(key) == F.col("_few"), "left_semi")


def minable_table(
    client: DataFrame,
    district: DataFrame,
    disp: DataFrame,
    account: DataFrame,
    loan: DataFrame,
    summary: DataFrame | None = None,
    *,
    keep_loans: bool = True,
    loans: KeyProfile | None = None,
) -> DataFrame:
    """client -> district, disposition, account, loan, transaction summary.

    Keys: ``client_id``/``c_id``, ``district_id``/``districtid``,
    ``account_id``/``ac_id``, ``acl_id`` and ``act_id``. With ``keep_loans`` each
    loan survives even without an account in a disposition (all client, account and
    summary columns are then null); otherwise each account in a disposition
    survives even without a loan.

    The tables with few rows per account are joined to each other first, so all
    of them are shuffled once, by account. The dispositions, which may repeat an
    account without bound, meet them in a single last join; so may the loans, and an
    account with many of both is dealt out over a grid. Two Spark jobs find such
    accounts when the table is built, one if ``loans`` has their profile already.
    """
    width = shuffle_width(disp.sparkSession)
    people = with_dimension(client, district, "district_id", "districtid")
    loans = profile_key(loan, "acl_id", HOT_LOANS) if loans is None else loans
    cells = grid_cells(profile_key(disp, "account_id").hot, loans.hot, width)
    many = [k for k in loans.hot if k is not None]
    holders = deal(disp, "account_id", cells, 0).join(people, F.col("c_id") == F.col("client_id"))
    accounts = account
    if summary is not None:
        accounts = accounts.join(summary, F.col("ac_id") == F.col("act_id"), "left")
    order = [client, district, disp, account, loan] + ([summary] if summary is not None else [])
    columns = [c for part in order for c in part.columns]
    if not keep_loans and not many:
        known = deal(accounts.join(loan, F.col("ac_id") == F.col("acl_id"), "left"), "ac_id", cells, 1)
        return grid_join(holders, known, "account_id", "ac_id", cells).select(*columns)

    # A right join would pin a hot account to one task (see keep_right_join), and would
    # carry the repeated rows through one more join than this form does.
    dealt = salt(deal(loan, "acl_id", cells, 1), "acl_id", many)
    known = salted_join(dealt, accounts, "acl_id", "ac_id", "inner", many)
    matched = grid_join(holders, known, "account_id", "ac_id", cells).select(*columns)
    typed = {f.name: f.dataType for f in matched.schema}
    blank = lambda df: df.select(*[c if c in df.columns else F.lit(None).cast(typed[c]).alias(c) for c in columns])
    if not keep_loans:
        lent = loan.select(F.col("acl_id").alias("_lent")).where("_lent IS NOT NULL").distinct()
        without = deal(accounts.join(lent, F.col("ac_id") == F.col("_lent"), "left_anti"), "ac_id", cells, 1)
        return matched.unionByName(blank(grid_join(holders, without, "account_id", "ac_id", cells)))
    held = (
        disp.join(client, F.col("c_id") == F.col("client_id"), "left_semi")
        .select(F.col("account_id").alias("_held"))
        .distinct()
    )
    reachable = held.join(account, F.col("_held") == F.col("ac_id"), "left_semi")
    # Loans without an account match nothing; joined, they would all meet in one task.
    keyed = salt(loan.where(F.col("acl_id").isNotNull()), "acl_id", many)
    alone = salted_join(keyed, reachable, "acl_id", "_held", "left_anti", many)
    return matched.unionByName(blank(alone.unionByName(loan.where(F.col("acl_id").isNull()))))


def fan_out(
    sales: DataFrame, products: DataFrame, moves: DataFrame, *, sale: str, product: str, move: str
) -> DataFrame:
    """Sales with every product row and every stock move of their product.

    The result has one row per (sale, product row, move) and so grows with the
    product of their numbers; use :func:`client_totals` for anything aggregated.
    """
    with_product = sales.join(products, F.col(sale) == F.col(product), "left")
    return with_product.join(moves, F.col(move) == F.col(sale), "left")


def _per_product(
    products: DataFrame,
    moves: DataFrame,
    *,
    product: str,
    move: str,
    stock: str,
    label: str,
    moved: str,
    target: str,
) -> DataFrame:
    """One row per product: what one sale of it would contribute to the fan-out."""
    p = products.groupBy(F.col(product).alias("_p")).agg(
        F.count("*").alias("_p_rows"),
        F.sum(stock).alias("_stock_sum"),
        F.count(stock).alias("_stock_n"),
        F.max(label).alias("_label"),
    )
    m = moves.groupBy(F.col(move).alias("_m")).agg(
        F.count("*").alias("_m_rows"),
        F.sum(moved).alias("_moved_sum"),
        F.max(target).alias("_target"),
    )
    per_product = F.coalesce("_p_rows", F.lit(1))
    per_move = F.coalesce("_m_rows", F.lit(1))
    return p.join(m, F.col("_p") == F.col("_m"), "full").select(
        F.coalesce("_p", "_m").alias("_key"),
        (per_product * per_move).alias("_rows"),
        (F.col("_moved_sum") * per_product).alias("_moved"),
        (F.col("_stock_sum") * per_move).alias("_stock"),
        (F.col("_stock_n") * per_move).alias("_stocks"),
        "_label",
        "_target",
    )


def fan_out_size(
    sales: DataFrame, products: DataFrame, moves: DataFrame, *, sale: str, **roles: str
) -> DataFrame:
    """Per product: rows and moved quantity of the fan-out, without building it."""
    sold = sales.groupBy(sale).agg(F.count("*").alias("_sold"))
    side = _per_product(products, moves, **roles)
    return sold.join(side, F.col(sale) == F.col("_key"), "left").select(
        sale,
        (F.col("_sold") * F.coalesce("_rows", F.lit(1))).alias("view_rows"),
        (F.col("_sold") * F.col("_moved")).alias("moved_qty"),
    )


def _weighted_mean(col: str) -> Column:
    present = F.when(F.col(col).isNotNull(), F.col("_w"))
    return F.try_divide(F.sum(F.col(col) * F.col("_w")), F.sum(present))


def client_totals(
    sales: DataFrame,
    products: DataFrame,
    moves: DataFrame,
    *,
    client: str,
    sale: str,
    averages: dict[str, str],
    names: Sequence[str] = ("Nombre", "stock", "prod_mov", "prod_dest", "cantidad_compras"),
    **roles: str,
) -> DataFrame:
    """Per-client summary over the fan-out, computed without the fan-out.

    Every sale counts once per product row and move, exactly as if the joined
    rows had been built: each is weighted by how often it would repeat.
    ``averages`` maps a sale measure to the name of its mean; ``names`` are the
    largest label, mean stock, moved quantity, largest target and row count. Labels are
    coded in their order, so that all aggregates are numbers and none needs a sort; coding
    them runs Spark jobs over the products.
    """
    codes = ordered_codes(products, roles["label"])
    named = products.join(codes, F.col(roles["label"]) == F.col("value"), "left").drop("value")
    side = _per_product(named, moves, **(roles | {"label": "code"}))
    w = sales.join(side, F.col(sale) == F.col("_key"), "left").withColumn(
        "_w", F.coalesce("_rows", F.lit(1))
    )
    label, stock, moved, target, count = names
    totals = w.groupBy(client).agg(
        F.max("_label").alias("_code"),
        *[_weighted_mean(c).alias(a) for c, a in averages.items()],
        F.try_divide(F.sum("_stock"), F.sum("_stocks")).alias(stock),
        F.sum("_moved").alias(moved),
        F.max("_target").alias(target),
        F.sum("_w").alias(count),
    )
    decoded = totals.join(codes.withColumnsRenamed({"value": label, "code": "_c"}), F.col("_code") == F.col("_c"), "left")
    return decoded.select(client, label, *averages.values(), stock, moved, target, count)
