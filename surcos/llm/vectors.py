"""Embedding near copies by sorted projection passes.

In each pass every vector gets a key of ``KEY_BITS`` random hyperplane signs, vectors are
sorted by it, and each is compared with the ``WINDOW`` before it. A pair at the threshold
shares a given sign with probability 1 - acos(0.9)/pi = 0.856, and n sorted vectors agree
with their window neighbours in about log2(n / WINDOW) leading signs. The number of passes
follows from n so that such a pair stays apart in all of them with probability ``MISS``;
closer pairs are missed far less often.

Dense groups, as vectors that share a direction, are split by fewer signs than that. So each
pass measures how many leading signs d a row shares with the rows ``WINDOW`` before and after
it: a linked row is out of reach only if it shares d signs or fewer, which bounds what the
passes miss of each row. A pair is in doubt only if that bound exceeds ``MISS`` for both ends.
Rows in doubt get more passes of their own until none is left, or are compared with each
other exactly, in tiles, where that is less work; pairs within a component are left out.

Verified pairs of all passes are united into components. Links are then counted exactly
inside each component, without listing them: vectors within half the threshold angle of the
component's mean are linked with each other for certain and only counted; the others are
compared with all members in tiles. Equal vectors are one class from the start.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite components
link with nothing; vectors of different lengths are not compared; a repeated row is another
vector; a row without vec_id links with nothing and has a null component and is kept.
Rows that share a vec_id and differ in content belong to the class of their own content: a
class is known by its hashes and numbered, and only its component is told by the least vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from surcos.llm.components import Forest, components
from surcos.sources.scratch import materialise

COSINE = 0.9
WINDOW = 64
KEY_BITS = 62
MISS = 1e-3
ROWS = 32_768  # sorted rows of a task, about
MORE = 32  # passes of a further round, at most
PASS_COST = 256  # comparisons that one more pass of a row is worth: window, signs and sorting
EDGE, ALL = 512, 4096  # tile sides where links are counted pair by pair


def passes(n: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    together = (1 - math.acos(cosine) / math.pi) ** max(1.0, math.log2(max(n, 2) / window))
    # A fifth more than on average: rows differ in how many signs they share, and few should stay in doubt.
    return max(4, math.ceil(1.2 * math.log(miss) / math.log(1 - together)))


@lru_cache(maxsize=4)
def hyperplanes(dim: int, count: int, turn: int = 0) -> np.ndarray:
    rng = np.random.default_rng([dim, 97 + turn])
    return rng.standard_normal((count * KEY_BITS, dim)).T


def unit(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision; scaled first, so squares stay finite."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(n, -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    size = np.array(column.value_lengths())
    for dim in np.unique(size):
        yield np.flatnonzero(size == dim)


def keys(column: pa.Array, count: int, turn: int = 0) -> list[np.ndarray]:
    """For each vector one sort key per pass."""
    out: list = [None] * len(column)
    weight = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype="i8")
    for at in _by_length(column):
        for i in range(0, len(at), 1024):
            rows = at[i : i + 1024]
            x = unit(column.take(pa.array(rows)))
            signs = (x @ hyperplanes(x.shape[1], count, turn) > 0).reshape(len(rows), count, KEY_BITS)
            for r, k in zip(rows, signs @ weight):
                out[r] = k
    return out


def shared_signs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading signs the keys have in common."""
    x = (a ^ b).astype("u8")
    for k in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(k)
    return KEY_BITS - np.bitwise_count(x).astype("f8")


class Doubt:
    """The log of what a pass misses of each row, at most, from the sorted keys of a run as they come.

    On either side, -1 stands for fewer rows than the window, so all are met, and NaN for rows
    of another task, which are not seen; then the other side counts.
    """

    def __init__(self, cosine: float, window: int, start: bool):
        self.agree, self.window, self.edge = 1 - math.acos(cosine) / math.pi, window, -1.0 if start else math.nan
        self.ids, self.keys, self.before = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)

    def _logs(self, ids, before, after) -> tuple[np.ndarray, np.ndarray]:
        d = np.fmax(before, after)
        log = np.log(np.maximum(1 - self.agree ** (np.nan_to_num(d, nan=KEY_BITS) + 1), 1e-12))
        return ids, np.where(d < KEY_BITS, log, 0.0)  # equal keys or none seen: the pass tells nothing

    def add(self, ids: np.ndarray, keys_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, keys_ = np.concatenate([self.ids, ids]), np.concatenate([self.keys, keys_])
        n = max(0, len(ids) - self.window)
        apart = shared_signs(keys_[: n], keys_[len(ids) - n :])
        lead = len(ids) - n - len(self.ids)  # new rows without a row so far before them
        before = np.concatenate([self.before, np.full(lead, self.edge), apart])
        self.ids, self.keys, self.before = ids[n:], keys_[n:], before[n:]
        return self._logs(ids[:n], before[:n], apart)

    def end(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        return self._logs(self.ids, self.before, np.full(len(self.ids), -1.0 if last else math.nan))


def window_links(x: np.ndarray, ids: np.ndarray, new: int, seen: Forest, cosine: float, window: int) -> list:
    """Links of the rows from ``new`` on with up to ``window`` rows before each, those that join something."""
    out = []
    for i in range(new, len(x), window):
        stop, low = min(i + window, len(x)), max(0, i - window)
        near = x[i:stop] @ x[low:stop].T >= cosine
        a, b = np.nonzero(near)
        a, b = a + i, b + low
        ok = (b < a) & (a - b <= window)
        for p, q in zip(ids[b[ok]].tolist(), ids[a[ok]].tolist()):
            if seen.joins(p, q):
                out.append((p, q))
    return out


def _valid(v: str):
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(v).isNotNull() & (F.size(v) > 0) & plain & F.exists(v, lambda x: x != 0)


def _pass_links(
    classes: DataFrame, count: int, n: int, cosine: float, window: int, turn: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Distinct verified pairs (a, b) of class ids that join the neighbours of all passes; and per id
    ``doubt``, the log of the chance, at most, that the passes miss a link of it."""
    element = classes.schema["v"].dataType.simpleString()
    names = ["a", "b", "part", "side", "pass", "id", "v", "log"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                made = pa.array(keys(part.column("v"), count, turn), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], ["id", "v", "keys"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, run, head = TaskContext.get().partitionId(), True, None, 0
        kept = x = ids = seen = doubt = None

        def doubts(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            size = len(found[0])
            none = [pa.nulls(size, pa.int64())] * 5 + [pa.nulls(size, kind)]
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), *none, pa.array(found[1], pa.float64())], names)

        def edge(rows: pa.RecordBatch, side: int) -> pa.RecordBatch:
            size = rows.num_rows
            fixed = [pa.nulls(size, pa.int64())] * 2 + [pa.array([part] * size, pa.int64()), pa.array([side] * size, pa.int64())]
            return pa.RecordBatch.from_arrays(
                [*fixed, rows.column("pass"), rows.column("id"), rows.column("v"), pa.nulls(size, pa.float64())], names
            )

        for batch in batches:
            kind = batch.column("v").type
            size = np.array(batch.column("v").value_lengths())
            mark = np.stack([batch.column("pass").to_numpy(), size], axis=1)
            cuts = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                rows, now = batch.slice(a, b - a), tuple(mark[a].tolist())
                new_x, new_ids = unit(rows.column("v")), rows.column("id").to_numpy()
                if now != run:
                    first, head = run is None, 0
                    if doubt is not None:
                        yield doubts(doubt.end(True))
                    doubt = Doubt(cosine, window, not first or part == 0)
                    run, seen, kept = now, Forest(), None
                    x, ids = new_x[:0], new_ids[:0]
                if first and head < window:  # the first rows of the task, for the task before it
                    yield edge(rows.slice(0, window - head), 1)
                head += rows.num_rows
                yield doubts(doubt.add(new_ids, rows.column("key").to_numpy()))
                old = len(x)
                x, ids = np.concatenate([x, new_x]), np.concatenate([ids, new_ids])
                found = window_links(x, ids, old, seen, cosine, window)
                x, ids = x[-window:], ids[-window:]
                both = [rows] if kept is None else [kept, rows]
                table = pa.Table.from_batches(both).combine_chunks()
                kept = table.slice(max(0, len(table) - window)).to_batches()[0]
                if found:
                    a_, b_ = (pa.array(c, pa.int64()) for c in zip(*found))
                    none = pa.nulls(len(found), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [a_, b_, none, none, none, none, pa.nulls(len(found), kind), pa.nulls(len(found), pa.float64())], names
                    )
        if kept is not None:  # the last rows, for the task after it
            yield edge(kept, 0)
            yield doubts(doubt.end(False))

    def across(key, group):
        out = []
        column = pa.array(group["v"].tolist())
        for at in _by_length(column):
            x, side = unit(column.take(pa.array(at))), group["side"].to_numpy()[at]
            own, turn = group["id"].to_numpy()[at], group["pass"].to_numpy()[at]
            p, q = np.nonzero((x[side == 0] @ x[side == 1].T >= cosine) & (turn[side == 0][:, None] == turn[side == 1]))
            out += list(zip(own[side == 0][p], own[side == 1][q]))
        seen = Forest()
        return pd.DataFrame([pq for pq in out if seen.joins(*map(int, pq))], columns=["a", "b"], dtype="i8")

    spread = classes.select("id", "v").mapInArrow(keyed, f"id bigint, v {element}, keys array<bigint>")
    rows = spread.select("id", "v", F.posexplode("keys").alias("pass", "key")).withColumn("pass", F.col("pass").cast("long"))
    order = ["pass", F.size("v"), "key", "id"]
    ranged = rows.repartitionByRange(max(1, n * count // ROWS), *order).sortWithinPartitions(*order)
    made = materialise(
        ranged.select("pass", "key", "id", "v").mapInArrow(
            windows, f"a bigint, b bigint, part bigint, side bigint, pass bigint, id bigint, v {element}, log double"
        ),
        "windows",
    )
    inside = made.where("b IS NOT NULL").select("a", "b")
    doubt = made.where("log IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("log").alias("doubt"))
    border = made.where("id IS NOT NULL").withColumn("border", F.col("part") + 1 - F.col("side"))
    met = border.groupBy("border").applyInPandas(across, "a bigint, b bigint")
    return inside.unionByName(met).distinct(), doubt


def _tile_links(rows: DataFrame, cosine: float) -> DataFrame:
    """Links (a, b) that join different components, of every pair of rows; ``rows``: id, component, v.

    A component larger than a tile has tiles of its own, which do not meet each other.
    """
    sizes = materialise(rows.groupBy("component").agg(F.count("*").alias("size")), "doubt-sizes")
    large = sizes.where(F.col("size") > ALL)
    small = sizes.where(F.col("size") <= ALL).agg(F.sum("size")).first()[0] or 0
    first, of = -(-small // ALL), []
    for r in large.orderBy("component").collect():  # at most a row per ALL rows in doubt
        of.append((r["component"], first, -(-r["size"] // ALL)))
        first += of[-1][2]
    own = rows.sparkSession.createDataFrame(of, "component long, first int, tiles int")
    pooled = F.col("first").isNull()
    tile = F.coalesce("first", F.lit(0)) + F.pmod(F.xxhash64("id"), F.coalesce("tiles", F.lit(max(1, -(-small // ALL))))).cast("int")
    placed = rows.join(F.broadcast(own), "component", "left").withColumn("tile", tile)
    other = F.explode(F.sequence(F.lit(0), F.lit(max(0, first - 1))))
    meets = pooled | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("tiles"))
    dealt = placed.withColumn("other", other).where(meets).select(
        "id", "component", "v", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))

    def compare(key, group):
        column, tile = pa.array(group["v"].tolist()), group["tile"].to_numpy()
        ids, comp = group["id"].to_numpy(), group["component"].to_numpy()
        seen, out = Forest(), []
        for at in _by_length(column):
            x = unit(column.take(pa.array(at)))
            one, two = np.flatnonzero(tile[at] == key[0]), np.flatnonzero(tile[at] == key[1])
            for i in range(0, len(one), 256):
                p = one[i : i + 256]
                near = (x[p] @ x[two].T >= cosine) & (comp[at[p]][:, None] != comp[at[two]][None, :])
                for j, k in zip(*np.nonzero(near)):
                    a, b = at[p[j]], at[two[k]]
                    if seen.joins(int(comp[a]), int(comp[b])):
                        out.append((ids[a], ids[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="i8")

    return materialise(dealt.groupBy("low", "high").applyInPandas(compare, "a bigint, b bigint"), "tile-links")


def _links(classes: DataFrame, n: int, cosine: float, window: int) -> DataFrame:
    """Pairs (a, b) that join the components: passes over all, then what remains in doubt."""
    done = passes(n, cosine, window)
    links, doubt = _pass_links(classes, done, n, cosine, window)
    turn = 0
    while True:
        doubt = materialise(doubt.where(F.col("doubt") > math.log(MISS)), "doubt")
        m, most = doubt.agg(F.count("*"), F.max("doubt")).first()
        if not m:
            return links
        rows = materialise(classes.join(doubt, "id"), "doubt-vectors")
        # The passes that the worst row still needs if they tell as much as those before.
        need = math.ceil(done * (math.log(MISS) / most - 1)) if most < 0 else math.inf
        # One further round first: it clears the rows that are in doubt by chance.
        if m <= 2 * ALL or turn and m <= 2 * PASS_COST * need:
            found = components(links)
            placed = rows.join(found, rows["id"] == found["node"], "left").select(
                "id", F.coalesce("component", "id").alias("component"), "v")
            return links.unionByName(_tile_links(placed, cosine))
        turn, more = turn + 1, min(MORE, max(1, need))
        new, logs = _pass_links(rows.select("id", "v"), more, m, cosine, window, turn)
        links, done = links.unionByName(new), done + more
        doubt = doubt.unionByName(logs).groupBy("id").agg(F.sum("doubt").alias("doubt"))


def _link_counts(linked: DataFrame, cosine: float) -> DataFrame:
    """``id`` and ``n_other``: members of other classes linked directly. ``linked``: id, n, component, v."""
    half = math.cos(math.acos(cosine) / 2 - 1e-7)
    single = linked.select("component", F.posexplode("v").alias("j", "x"), F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm"))
    sums = single.groupBy("component", "j").agg(F.sum(F.col("x") / F.col("norm")).alias("x"))
    centre = materialise(
        sums.groupBy("component").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("c")),
        "centres",
    )
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cos = dot("v", "c") / F.sqrt(dot("v", "v")) / F.sqrt(dot("c", "c"))
    placed = materialise(
        linked.join(centre, "component").select("id", "n", "component", "v", F.coalesce(cos >= half, F.lit(False)).alias("core")),
        "placed-vectors",
    )
    sizes = materialise(
        placed.groupBy("component").agg(
            F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("n_core"),
            F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("n_rim"),
            F.count("*").alias("n_all"),
        ),
        "component-sizes",
    )
    sure = placed.where("core").join(sizes, "component").select("id", (F.col("n_core") - F.col("n")).alias("n_other"))
    open_ = placed.join(sizes.where("n_rim > 0"), "component")
    tile = lambda total, side: F.pmod(F.xxhash64("id"), F.ceil(F.col(total) / side)).cast("int")
    every = lambda total, side: F.explode(F.sequence(F.lit(0), F.ceil(F.col(total) / side).cast("int") - 1))
    rim = open_.where("NOT core").withColumn("i", tile("n_rim", EDGE)).withColumn("j", every("n_all", ALL)).withColumn("rim", F.lit(True))
    all_ = open_.withColumn("j", tile("n_all", ALL)).withColumn("i", every("n_rim", EDGE)).withColumn("rim", F.lit(False))

    def compare(key, group):
        x = unit(pa.array(group["v"].tolist()))
        rim, core, n, ids = (group[c].to_numpy() for c in ("rim", "core", "n", "id"))
        add = {}
        to, own = np.flatnonzero(~rim), np.flatnonzero(rim)
        for i in range(0, len(own), 128):
            p = own[i : i + 128]
            near = (x[p] @ x[to].T >= cosine) & (ids[p][:, None] != ids[to][None, :])
            for k, s in zip(ids[p].tolist(), (near @ n[to]).tolist()):
                add[k] = add.get(k, 0) + s
            for k, s in zip(ids[to[core[to]]].tolist(), (n[p] @ near[:, core[to]]).tolist()):
                add[k] = add.get(k, 0) + s
        return pd.DataFrame({"id": list(add), "n_other": list(add.values())}, dtype="i8")

    columns = ["component", "i", "j", "id", "n", "v", "core", "rim"]
    pairs = rim.select(*columns).unionByName(all_.select(*columns)).groupBy("component", "i", "j")
    some = pairs.applyInPandas(compare, "id bigint, n_other bigint")
    return sure.unionByName(some).groupBy("id").agg(F.sum("n_other").alias("n_other"))


def near_vectors(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, window: int = WINDOW
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row."""
    given = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("v"))
    good = F.coalesce(_valid("v") & F.col("vec_id").isNotNull(), F.lit(False))
    keyed = given.withColumn("k1", F.when(good, F.xxhash64("v"))).withColumn("k2", F.when(good, F.xxhash64(F.lit(1), "v")))
    names = materialise(keyed.select("vec_id", "k1", "k2"), "vectors")
    first = materialise(
        names.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
        .withColumn("id", F.monotonically_increasing_id()),  # fixed as written
        "vector-classes",
    )
    classes = materialise(
        keyed.join(first, ["k1", "k2"]).where("vec_id = least").dropDuplicates(["id"]).select("id", "n", "v"), "class-vectors"
    )
    n = classes.count()
    links = _links(classes, n, cosine, window)
    found = components(links)
    linked = classes.join(found, classes["id"] == found["node"]).select("id", "n", "component", "v")
    counts = _link_counts(materialise(linked, "linked-vectors"), cosine)
    members = materialise(first.select("id", "least").join(found.withColumnRenamed("node", "id"), "id"), "vector-members")
    ids = materialise(members.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    named = materialise(members.join(ids, "component").select("id", "component_id"), "vector-ids")
    of_class = materialise(
        first.join(named, "id", "left").join(counts, "id", "left").select(
            "k1", "k2", F.coalesce("component_id", "least").alias("component_id"),
            (F.coalesce("n_other", F.lit(0)) + F.col("n") - 1).alias("n_links")),
        "vector-components",
    )
    alone = names.where("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = names.join(of_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
