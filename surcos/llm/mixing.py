"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of its documents in hashed order, cut into blocks of equally
many words. Slots 0, 1, 2, ... of the mix carry van der Corput points; a point falls
into the interval that the cumulative weights give to a source, so every stretch of
the mix has the sources in proportion. The r-th slot of a source takes its r-th block,
starting anew when all blocks are taken.

How many of the first n points lie below x has a closed form in the binary digits of
n, so slots are ranked without sorting them, and no source is collected in one place.
Prefix sums over a source's documents go through ``BUCKETS`` buckets of their hash.
Only integers are added: reruns agree.

Defined cases: a null text has no words, and a document without words is never taken;
a null source is a source of its own, last in order; repeated rows are taken as the
separate rows they are; an empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from surcos.llm.words import n_words
from surcos.operators.ranking import global_rank, running_totals
from surcos.sources.scratch import materialise

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5  # words of the mix for each word there is
EPOCHS = 2  # times that a document may be taken
BLOCK = 1024  # words of a block
BUCKETS = 4096  # of a source's documents, by hash
CELLS = 4096  # of the unit interval, to look sources up by their points
BITS = 50  # of a point; a mix may have up to 2**48 slots
_ONE = 1 << BITS


@dataclass
class Mix:
    """``sources``: one row per source with its words and target. ``rows``: the given rows with
    their place in their source's stream. ``schedule``: one row per slot. ``pieces``: what each
    slot takes of each document."""

    sources: DataFrame
    rows: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def _level(sources: DataFrame, total: float) -> float:
    """Words per unit of weight once no source is above its cap.

    Each round reads two sums; it ends when no further source reaches its cap.
    """
    level = 0.0
    while True:
        full = F.col("_weight") * level >= F.col("_cap")
        caps, open_weight = sources.agg(
            F.sum(F.when(full, F.col("_cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_weight")))
        ).first()
        if not open_weight:
            return level
        raised = (total - caps) / open_weight
        if raised <= level:
            return level
        level = raised


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: ``source``, ``source_size`` and ``target`` words.

    Sources are in code point order, null last, and the weights repeat over them. A target
    stops at ``epochs`` times its source's size; the excess goes to the others by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = global_rank(per, order, "source_no")
    table = F.array(*[F.lit(int(w)) for w in weights])
    weighed = materialise(
        ranked.withColumn("_weight", F.get(table, (F.col("source_no") % len(weights)).cast("int")))
        .withColumn("_cap", epochs * F.col("source_size")),
        "mix-weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = _level(weighed, share * total)
    target = F.least(F.col("_cap").cast("double"), F.col("_weight") * F.lit(level))
    return materialise(
        running_totals(
            weighed.select("source", "source_no", "source_size", target.alias("target")),
            [F.col("source_no")],
            ["target"],
        ).withColumn("_below", F.col("cum_target") - F.col("target")),
        "mix-targets",
    )


def _below(n: Column, x: Column) -> Column:
    """How many of the van der Corput points 0 .. n - 1 are less than x (in units of 2**-BITS).

    A digit 1 of n stands for a run of 2**k points in equal distances, shifted by the
    reversed digits above it.
    """
    start = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(0).cast("long").alias("count"))

    def add(acc: Column, k: Column) -> Column:
        has = F.expr("1L") * F.call_function("getbit", n, k) == 1
        gap = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(BITS) - k)
        points = F.greatest(F.lit(0).cast("long"), F.floor((x - acc["shift"] + gap - 1) / gap))
        run = F.least(F.call_function("shiftleft", F.lit(1).cast("long"), k), points)
        return F.struct(
            F.when(has, acc["shift"] + F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(BITS - 1) - k))
            .otherwise(acc["shift"]).alias("shift"),
            (acc["count"] + F.when(has, run).otherwise(0)).alias("count"),
        )

    digits = F.sequence(F.lit(48), F.lit(0), F.lit(-1))
    return F.aggregate(digits, start, add, lambda acc: acc["count"])


def _point(i: Column) -> Column:
    """The digits of i behind the binary point in reverse, as an integer of ``BITS`` bits."""
    digits = F.lpad(F.bin(i), BITS, "0")
    return F.conv(F.reverse(digits), 2, 10).cast("long")


def _quotas(sources: DataFrame, block: int) -> DataFrame:
    """Per source: interval of points, blocks of an epoch, and slots that its target needs."""
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    edge = lambda c: F.round(F.col(c) / F.lit(total or 1.0) * _ONE).cast("long")
    words = F.round("target").cast("long")
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(words / size)).otherwise(0)
    return sources.where("target > 0").select(
        "source_no",
        edge("_below").alias("_from"),
        edge("cum_target").alias("_to"),
        F.ceil(size / block).alias("_blocks"),
        epochs.alias("_epochs"),
        (words - epochs * size).alias("_rest"),
        (epochs * F.ceil(size / block) + F.ceil((words - epochs * size) / block)).alias("_quota"),
    )


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per slot: ``slot``, ``source_no``, ``block``, ``epoch``, ``most`` (words it may take).

    A source that its points have served up to its target is passed over from there on;
    the few slots that a source still misses when the points end follow at the end.
    """
    spark = sources.sparkSession
    quotas = materialise(_quotas(sources, block), "mix-quotas")
    n = quotas.agg(F.sum("_quota")).first()[0] or 0
    drawn = spark.range(n).select(F.col("id").alias("slot"), _point(F.col("id")).alias("_u"))
    cell = lambda c: F.floor(c * CELLS / _ONE)
    spread = quotas.withColumn(
        "_cell", F.explode(F.sequence(cell(F.col("_from")), cell(F.greatest(F.col("_from"), F.col("_to") - 1))))
    )
    inside = (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))
    held = drawn.withColumn("_cell", cell(F.col("_u"))).join(spread, "_cell").where(inside)
    rank = _below(F.col("slot"), F.col("_to")) - _below(F.col("slot"), F.col("_from"))
    ranked = held.withColumn("_rank", rank).where(F.col("_rank") < F.col("_quota"))
    limit = F.lit(n).cast("long")
    had = _below(limit, F.col("_to")) - _below(limit, F.col("_from"))
    late = (
        quotas.withColumn("_had", had).where("_had < _quota")
        .withColumn("_rank", F.explode(F.sequence("_had", F.col("_quota") - 1)))
        .withColumn("slot", limit + F.col("_rank") - F.col("_had"))
    )
    columns = ["slot", "source_no", "_rank", "_blocks", "_epochs", "_rest"]
    place = F.col("_rank") % F.col("_blocks")
    turn = F.floor(F.col("_rank") / F.col("_blocks"))
    most = F.when(turn < F.col("_epochs"), block).otherwise(F.col("_rest") - place * block)
    return ranked.select(*columns).unionByName(late.select(*columns)).select(
        "slot", "source_no", place.alias("block"), turn.alias("epoch"), F.least(F.lit(block), most).alias("most")
    )


def _placed(sized: DataFrame) -> DataFrame:
    """Add ``start``: the words before each row in its source's hashed order, and a row's key.

    Buckets are summed first; the sums of a source are at most ``BUCKETS`` rows, and the
    documents of a bucket are a small part of those of a source.
    """
    by_bucket = (
        sized.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_size"))
    )
    before = W.partitionBy("source_no").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialise(
        by_bucket.select("source_no", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")),
        "mix-offsets",
    )
    order = W.partitionBy("source_no", "_bucket").orderBy("_order", "_tie", "size")
    inner = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("_inner", inner).withColumn("_nth", F.row_number().over(order))
    return placed.join(offsets, ["source_no", "_bucket"]).withColumn("start", F.col("_offset") + F.col("_inner"))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE,
    epochs: int = EPOCHS, block: int = BLOCK, seed: int = 7, keep: tuple[str, ...] = ("doc_id",),
) -> Mix:
    """Schedule the documents. ``keep`` names the columns carried into ``rows`` as struct ``doc``.

    The text is read once; sizes and hashes are written, all else works on these.
    """
    given = F.struct(*[F.col(f"`{c}`") for c in keep])
    mark = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    sized = materialise(
        docs.select(
            given.alias("doc"), F.col(f"`{source}`").alias("source"),
            n_words(F.col(f"`{text}`")).alias("size"), mark.alias("_order"),
            F.xxhash64(F.lit(seed + 1), F.col(f"`{text}`")).alias("_tie"),
        ),
        "mix-sizes",
    )
    sources = targets(sized, weights, share, epochs)
    numbered = sized.join(
        sources.select(F.col("source").alias("_s"), "source_no", "source_size", "target"),
        F.col("source").eqNullSafe(F.col("_s")),
    ).drop("_s")
    bucket = F.shiftrightunsigned(F.col("_order"), 64 - BUCKETS.bit_length() + 1)
    rows = materialise(_placed(numbered.withColumn("_bucket", bucket)), "mix-rows")
    slots = schedule(sources, block)
    last = F.col("start") + F.col("size") - 1
    parts = rows.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block)))
    )
    low = F.col("block") * block
    high = F.least(F.col("start") + F.col("size"), low + F.col("most"))
    taken = F.greatest(F.lit(0).cast("long"), high - F.greatest(F.col("start"), low))
    pieces = (
        parts.join(slots, ["source_no", "block"])
        .select("slot", "epoch", "source_no", "_bucket", "_nth", "doc",
                (F.greatest(F.col("start"), low) - F.col("start")).alias("from_word"), taken.alias("taken"))
        .where("taken > 0")
    )
    return Mix(sources, rows, slots, pieces)


def words_taken(mixed: Mix) -> DataFrame:
    """Per given row: ``doc``, ``size``, ``source_size``, ``target`` and ``taken``, repeats counted."""
    key = ["source_no", "_bucket", "_nth"]
    per_row = mixed.pieces.groupBy(*key).agg(F.sum("taken").alias("taken"))
    return mixed.rows.join(per_row, key, "left").select(
        "doc", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents: each once for every time that the schedule takes its first word.

    A document is not cut: the piece that begins it stands for the whole. Documents
    without words are in no block and so in no mix. The schedule works on two hashes of each
    row; the rows themselves are shuffled once, to meet their numbers of copies.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = ["_k1", "_k2"]
    keyed = docs.select(*columns, F.xxhash64(F.lit(0), *columns).alias("_k1"), F.xxhash64(F.lit(1), *columns).alias("_k2"))
    made = mix(keyed, text, source, keep=tuple(keys), **options)
    begun = made.pieces.where("from_word = 0").groupBy("doc").agg(F.count("*").alias("_copies"))
    equal = made.rows.groupBy("doc").agg(F.count("*").alias("_rows"))
    copies = materialise(begun.join(equal, "doc").select("doc.*", "_copies", "_rows"), "mix-copies")
    met = keyed.join(copies, keys)
    alone = met.where("_rows = 1").drop("_rows")
    several = met.where("_rows > 1").groupBy(*keys, "_copies").agg(F.min(F.struct(*columns)).alias("_row"))
    both = alone.select(*docs.columns, "_copies").unionByName(several.select("_row.*", "_copies"))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
