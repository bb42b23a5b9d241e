"""Near copies by b-bit MinHash.

A document's set holds its distinct shingles of five words. Some hundred minima are drawn
from it; of each only ``BITS`` low bits are kept, packed into long integers, and some whole
minima (``rows``) at a time are hashed into one of ``bands`` band values. Documents that
share a band value are candidates. The share E of equal codes overestimates the similarity by
chance collisions, so it is corrected, (E - 2**-b) / (1 - 2**-b); pairs whose estimate lies
``SLACK`` standard errors below the threshold or higher are confirmed on the full sets.

Exact copies of a set are one class before any pairing. Within a bucket classes are first
compared with the bucket's leader only. What these links do not join into one component
is then compared across components, by bit counts: buckets of up to ``FEW`` members many
at a time, larger ones in tiles of bounded size. No pair of different components is left
out, and no pair inside a component need be looked at.

The threshold is a parameter, in percent; :class:`Plan` derives from it the rows and bands,
the bound of the estimate and the sizes that can still be alike. A link is missed only if no
band agrees, at the threshold with probability ``MISS`` at most: (1 - 0.85**8)**48 = 2e-7,
(1 - 0.8**7)**64 = 3e-7. Shingles are compared as 64-bit hashes.

Defined cases: a null or empty text, or one of blanks, has an empty set and no links; with
fewer than five words the whole sequence is the one shingle; repeated rows are members of
one class; a null doc_id is linked with nothing, its component is null and it is kept.
Rows that share a doc_id and differ in content belong to the class of their own content: a
class is known by its set and numbered, and only its component is told by the least doc_id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surcos.llm.components import Forest, components
from surcos.llm.words import flat_words, slices
from surcos.sources.scratch import materialise, release

WORDS = 5
PERCENT = 85  # 100 * intersection >= PERCENT * union; op4's threshold
KEEP_PERCENT = 80  # of keep_first
BITS = 2
MISS = 3e-7
MOST_HASHES = 448  # minima of a set, unless bands of one row need more
SLACK = 5
MAX_BROADCAST = 16 << 20  # bytes of ids or keys; beyond, both sides are shuffled
ID_BYTES, KEY_BYTES = 16, 64  # of an id, and of a set's key with its class, in a broadcast
FEW, GROUP = 64, 4096  # members of a bucket that is compared along with others, and about how many in all
TILE, TILE_BYTES = 1024, 24 << 20  # members of a bucket, and bytes of their sets, that are compared at a time
_MASK = 0x5555555555555555


@dataclass(frozen=True)
class Plan:
    """What follows from a threshold of ``percent``."""

    percent: int
    rows: int  # minima of a band
    bands: int

    @property
    def hashes(self) -> int:
        return self.rows * self.bands

    @property
    def longs(self) -> int:
        return self.hashes * BITS // 64

    @property
    def max_unequal(self) -> int:
        """Codes that may differ in a candidate."""
        j, chance = self.percent / 100, 2.0**-BITS
        e = chance + j * (1 - chance)
        least = j - SLACK * (e * (1 - e) / self.hashes) ** 0.5 / (1 - chance)
        return int(self.hashes * (1 - least) * (1 - chance))

    def sizes_fit(self, few, many):
        """Whether sets of so many shingles can be alike; of numbers, arrays or columns."""
        return 100 * few >= self.percent * many

    def alike(self, common, union):
        return 100 * common >= self.percent * union


@lru_cache
def plan(percent: int = PERCENT) -> Plan:
    """The longest bands within ``MOST_HASHES`` that miss a link at the threshold with ``MISS`` at most."""
    if not 1 <= percent <= 100:
        raise ValueError(f"a threshold of {percent} percent is not between 1 and 100")
    best = None
    for rows in range(1, 33):
        agree, step = (percent / 100) ** rows, 64 // BITS // math.gcd(rows, 64 // BITS)  # bits fill whole longs
        need = math.ceil(math.log(MISS) / math.log1p(-agree)) if agree < 1 else 1
        made = Plan(percent, rows, -(-need // step) * step)
        if best is None or made.hashes <= MOST_HASHES:
            best = made
    return best


HASHES = plan().hashes


@lru_cache
def _hashing(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    multiply = rng.integers(1, 1 << 32, count, dtype="u4") | np.uint32(1)
    return multiply, rng.integers(0, 1 << 32, count, dtype="u4")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    flat, begin = flat_words(texts, lower=True)
    coded = flat.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], "u8")
    word = own[coded.indices.to_numpy()] if len(flat) else own
    turned = [_mix(word + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(WORDS)]
    n = len(word) - WORDS + 1
    whole = _mix(sum(t[k : k + n] for k, t in enumerate(turned))) if n > 0 else own[:0]
    sets = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= WORDS:
            sets.append(np.unique(whole[a : b - WORDS + 1]))
        elif b > a:
            short = sum(turned[k][a + k : a + k + 1] for k in range(b - a)) + np.uint64(b - a)
            sets.append(_mix(short))
        else:
            sets.append(own[:0])
    return sets


def minima(shingles: np.ndarray, count: int = HASHES) -> np.ndarray:
    """``count`` minima of a set that is not empty; memory does not grow with the set."""
    multiply, flip = _hashing(count)
    x = (shingles >> np.uint64(32)).astype("u4") ^ shingles.astype("u4")
    least = np.full(count, 0xFFFFFFFF, "u4")
    for i in range(0, len(x), 512):
        part = (x[None, i : i + 512] ^ flip[:, None]) * multiply[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def sketch(least: np.ndarray, by: Plan = plan()) -> tuple[np.ndarray, np.ndarray]:
    """Band values, and the packed low bits."""
    rows = least.reshape(by.bands, by.rows).astype("u8")
    band = np.arange(1, by.bands + 1, dtype="u8")
    for k in range(by.rows):
        band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    low = (least & np.uint32((1 << BITS) - 1)).astype("u8").reshape(by.longs, 64 // BITS)
    shift = np.arange(0, 64, BITS, dtype="u8")
    return band.astype("i8"), np.bitwise_or.reduce(low << shift, axis=1).astype("i8")


def sketches(docs: DataFrame, by: Plan, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key`` (null for empty sets), ``bands`` and ``bits``."""
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                n, keys, bands, bits = [], [], [], []
                for s in shingle_sets(part.column("_text")):
                    n.append(len(s))
                    keys.append(_set_key(s) if len(s) else None)
                    band, low = sketch(minima(s, by.hashes), by) if len(s) else (None, None)
                    bands.append(band)
                    bits.append(low)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array(bands, longs), pa.array(bits, longs)],
                    ["doc_id", "n_shingles", "set_key", "bands", "bits"],
                )

    return given.mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, bits array<bigint>"
    )


def _unequal(a: Column, b: Column, longs: int) -> Column:
    """Codes that differ, by bit counts over the packed integers."""
    total = F.lit(0)
    for k in range(longs):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_MASK)))
    return total


def _similar(a: np.ndarray, b: np.ndarray, by: Plan) -> np.ndarray:
    unequal = np.zeros((len(a), len(b)), "u2")
    for k in range(by.longs):
        x = a[:, k, None] ^ b[None, :, k]
        unequal += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_MASK))
    return unequal <= by.max_unequal


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _named(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes among ``members`` (cls, repeated), with what names their sets."""
    return classes.select("cls", "set_key", "class_id").join(members.select("cls").distinct(), "cls", "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))


def _light(table: DataFrame, rows: int, each: int) -> DataFrame:
    """A join side of ``rows`` rows that is broadcast if it is small, as the other side holds texts or sets."""
    return F.broadcast(table) if rows * each <= MAX_BROADCAST else table


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Full sets ``s`` of the classes in ``wanted`` (cls, set_key, class_id); ``docs`` (doc_id, _text) are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(part.column("_text"))
                keys = pa.array([_set_key(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([s.astype("i8") for s in sets], pa.list_(pa.int64()))], ["set_key", "s"]
                )

    wanted = materialise(wanted, "wanted")
    ids = wanted.select(F.col("class_id").alias("doc_id")).distinct()
    rows = wanted.count()
    made = docs.join(_light(ids, rows, ID_BYTES), "doc_id").mapInArrow(run, "set_key binary, s array<bigint>")
    # A doc_id may have rows of several contents: each is the set of the class that its key names.
    named = made.join(_light(wanted.select("set_key", "cls"), rows, KEY_BYTES), "set_key")
    sets = materialise(named.dropDuplicates(["cls"]).select("cls", "s"), "sets")
    release(wanted)
    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame, by: Plan) -> DataFrame:
    """Those candidate pairs (a, b) of classes that are links."""
    left = sets.select(F.col("cls").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return materialise(
        pairs.join(left, "a").join(right, "b").where(by.alike(common, union)).select("a", "b"), "confirmed"
    )


def _shared(classes: DataFrame) -> DataFrame:
    """Members of the buckets with several classes: ``value``, ``cls`` and the ``leader``, the least."""
    members = classes.select("cls", F.explode("bands").alias("value"))
    leaders = materialise(
        members.groupBy("value").agg(F.min("cls").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "leaders",
    )
    shared = materialise(members.join(leaders, "value"), "shared")
    release(leaders)
    return shared


def _leader_pairs(shared: DataFrame, classes: DataFrame, by: Plan) -> DataFrame:
    """Candidates of each class with the leaders of its buckets."""
    met = shared.where("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct()
    one = classes.select(F.col("cls").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("xa"))
    two = classes.select(F.col("cls").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("xb"))
    near = _unequal(F.col("xa"), F.col("xb"), by.longs) <= by.max_unequal
    fit = by.sizes_fit(F.least("na", "nb"), F.greatest("na", "nb"))
    met = materialise(met, "met")
    pairs = materialise(met.join(one, "a").join(two, "b").where(fit & near).select("a", "b"), "candidates")
    release(met)
    return pairs


def _few_pairs(placed: DataFrame, few: DataFrame, classes: DataFrame, by: Plan) -> DataFrame:
    """Pairs (a, b) of different components that share one of the buckets ``few`` and are near, by bit counts.

    A group holds many whole buckets, as a group for each costs more than its comparisons.
    """

    def compare(group):
        group = group.sort_values("value")
        bits = np.stack(group["bits"].to_numpy()).astype("i8").view("u8")
        value, ids, comp, n = (group[c].to_numpy("i8") for c in ("value", "cls", "component", "n_shingles"))
        out = [np.empty((0, 2), "i8")]
        for behind in range(1, len(group)):
            x = np.flatnonzero(value[behind:] == value[:-behind])
            if not len(x):
                break
            fit = (comp[x] != comp[x + behind]) & by.sizes_fit(np.minimum(n[x], n[x + behind]), np.maximum(n[x], n[x + behind]))
            x = x[fit]
            v = bits[x] ^ bits[x + behind]
            unequal = np.bitwise_count((v | v >> np.uint64(1)) & np.uint64(_MASK)).sum(axis=1, dtype="i8")
            x = x[unequal <= by.max_unequal]
            out.append(np.sort(np.column_stack([ids[x], ids[x + behind]]), axis=1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    groups = (few.agg(F.sum("n")).first()[0] or 0) // GROUP + 1
    members = placed.join(few.select("value"), "value").join(classes.select("cls", "bits"), "cls")
    found = members.groupBy(F.pmod(F.xxhash64("value"), F.lit(groups))).applyInPandas(compare, "a bigint, b bigint")
    return materialise(found.distinct(), "near-pairs")


def _tiled(open_: DataFrame) -> DataFrame:
    """Members with ``tiles`` dealt out, a row for each pair of tiles (``low``, ``high``) that theirs is in."""
    tile = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    dealt = open_.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))


def _near_members(placed: DataFrame, mixed: DataFrame, classes: DataFrame, by: Plan) -> DataFrame:
    """The members (value, cls) of mixed buckets that are near one of another component, by bit counts."""

    def compare(key, group):
        _, low, high = key
        bits = np.stack(group["bits"].to_numpy()).astype("i8").view("u8")
        comp, n, tiles = (group[c].to_numpy("i8") for c in ("component", "n_shingles", "tile"))
        at = np.flatnonzero(tiles == low)
        to = at if low == high else np.flatnonzero(tiles == high)
        near = np.zeros(len(group), bool)
        for i in range(0, len(at), 64):
            p = at[i : i + 64]
            few, many = np.minimum(n[p, None], n[None, to]), np.maximum(n[p, None], n[None, to])
            ok = (comp[p, None] != comp[None, to]) & by.sizes_fit(few, many)
            if ok.any():
                ok &= _similar(bits[p], bits[to], by)
                near[p] |= ok.any(axis=1)
                near[to] |= ok.any(axis=0)
        return group.loc[near, ["value", "cls"]]

    open_ = placed.join(mixed, "value").join(classes.select("cls", "bits"), "cls")
    found = _tiled(open_).groupBy("value", "low", "high").applyInPandas(compare, "value bigint, cls bigint")
    return materialise(found.distinct(), "near-members")


def _across_links(shared: DataFrame, classes: DataFrame, texts: DataFrame, found: DataFrame, by: Plan) -> DataFrame:
    """Links (a, b) between different components of a bucket, those that join components.

    Buckets of one component need no more work. Of the others most have few members: their near
    pairs are confirmed each once, however many buckets it shares. In larger ones members are dealt
    into tiles of bounded count and bytes, and every pair of tiles is compared in one group:
    by bit counts first, then on the full sets. Most members share a bucket by chance and
    are near none, ever more of them in a larger corpus: bit counts find those first, so
    that only near members meet with their full sets. There a pair is looked at in the first
    bucket that it shares, and not if links found before already join it.
    """
    placed = materialise(
        shared.join(found, shared["cls"] == found["node"], "left")
        .select("value", "cls", F.coalesce("component", "cls").alias("component"))
        .join(classes.select("cls", "n_shingles"), "cls"),
        "placed",
    )
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("size") * 8 / TILE_BYTES))
    mixed = materialise(
        placed.groupBy("value")
        .agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"),
             F.min("component").alias("c1"), F.max("component").alias("c2"))
        .where("c1 <> c2")
        .select("value", "n", tiles.cast("int").alias("tiles")),
        "mixed",
    )
    pairs = _few_pairs(placed, mixed.where(F.col("n") <= FEW), classes, by)
    many = mixed.where(F.col("n") > FEW).select("value", "tiles")
    near = _near_members(placed, many, classes, by)
    sets = _sets(_named(_ends(pairs).unionByName(near.select("cls")), classes), texts)
    links = _confirmed(pairs, sets, by)
    open_ = placed.join(near, ["value", "cls"]).join(many, "value").join(classes.select("cls", "bits", "bands"), "cls")
    keyed = _tiled(open_.join(sets, "cls"))

    def compare(key, group):
        value, low, high = key
        bits = np.stack(group["bits"].to_numpy()).astype("i8").view("u8")
        bands = np.stack(group["bands"].to_numpy())
        ids, comp, n = (group[c].to_numpy("i8") for c in ("cls", "component", "n_shingles"))
        tiles, full = group["tile"].to_numpy(), group["s"].to_numpy()
        at = np.flatnonzero(tiles == low)
        to = at if low == high else np.flatnonzero(tiles == high)
        joined, out = Forest(), []
        for i in range(0, len(at), 64):
            p = at[i : i + 64]
            few, many = np.minimum(n[p, None], n[None, to]), np.maximum(n[p, None], n[None, to])
            ok = (comp[p, None] != comp[None, to]) & by.sizes_fit(few, many)
            if low == high:
                ok &= ids[p, None] < ids[None, to]
            x, y = np.nonzero(ok & _similar(bits[p], bits[to], by)) if ok.any() else ((), ())
            x, y = p[np.asarray(x, int)], to[np.asarray(y, int)]
            same = bands[x] == bands[y]
            first = bands[x, same.argmax(axis=1)] == value
            for j, k in zip(x[first].tolist(), y[first].tolist()):
                if joined.find(int(comp[j])) == joined.find(int(comp[k])):
                    continue
                common = len(np.intersect1d(full[j], full[k], assume_unique=True))
                if by.alike(common, int(n[j] + n[k]) - common):
                    joined.joins(int(comp[j]), int(comp[k]))
                    out.append((min(ids[j], ids[k]), max(ids[j], ids[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="i8")

    across = materialise(keyed.groupBy("value", "low", "high").applyInPandas(compare, "a bigint, b bigint"), "across")
    for done in (placed, mixed, pairs, near, sets):
        release(done)
    return links.unionByName(across)


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row."""
    return _components_of(_sketched(docs, percent, text, doc_id), docs, percent, text, doc_id).drop("set_key")


def _sketched(docs: DataFrame, percent: int, text: str, doc_id: str) -> DataFrame:
    return materialise(sketches(docs, plan(percent), text, doc_id), "sketches")


def _components_of(made: DataFrame, docs: DataFrame, percent: int, text: str, doc_id: str) -> DataFrame:
    """What :func:`near_copies` gives, with the ``set_key`` of each row.

    Tables written on the way go as soon as nothing reads them: the result needs ``made`` and one more.
    """
    by = plan(percent)
    linked = made.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    # Numbered as written, so that the numbers are fixed.
    first = materialise(
        linked.groupBy("set_key").agg(F.min("doc_id").alias("class_id"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    classes = materialise(
        # By set and id, which spreads the copies of a set and needs no other shuffle to drop repeated rows.
        linked.join(first.withColumnRenamed("class_id", "doc_id"), ["set_key", "doc_id"])
        .dropDuplicates(["set_key", "doc_id"])
        .select("cls", "set_key", F.col("doc_id").alias("class_id"), "n_shingles", "bands", "bits"),
        "class-sketches",
    )
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    shared = _shared(classes)
    pairs = _leader_pairs(shared, classes, by)
    sets = _sets(_named(_ends(pairs), classes), texts)
    links = _confirmed(pairs, sets, by)
    release(sets)
    joined = components(links)
    every = links.unionByName(_across_links(shared, classes, texts, joined, by))
    for done in (pairs, shared, classes, joined):
        release(done)
    linked_nodes = components(every)
    release(every)
    found = linked_nodes.withColumnRenamed("node", "cls")
    named = materialise(first.join(found, "cls"), "class-components")
    least = materialise(named.groupBy("component").agg(F.min("class_id").alias("component_id")), "component-ids")
    of_class = materialise(named.join(least, "component").select("set_key", "component_id"), "named-classes")
    grouped = first.select("set_key", "class_id").join(of_class, "set_key", "left").select(
        "set_key", F.coalesce("component_id", "class_id").alias("component_id"))
    of_set = materialise(grouped, "set-components")
    for done in (first, linked_nodes, named, least, of_class):
        release(done)
    columns = ["doc_id", "n_shingles", "component_id", "set_key"]
    alone = made.where("doc_id IS NULL OR set_key IS NULL").withColumn("component_id", F.col("doc_id")).select(columns)
    rows = linked.join(of_set, "set_key").select(columns).unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows.select("doc_id", "n_shingles", "component_id", "kept", "set_key")


def _key_of(texts: pd.Series) -> pd.Series:
    # One text at a time, as a batch may hold long ones.
    sets = (shingle_sets(pa.array([t], pa.string()))[0] for t in texts)
    return pd.Series([_set_key(s) if len(s) else b"" for s in sets], dtype=object)


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = KEEP_PERCENT) -> DataFrame:
    """The documents whose row is kept, columns unchanged.

    Of rows that share a kept doc_id and the set one remains, the least; rows of other content
    that share the doc_id are judged for themselves. Rows without doc_id all remain.
    """
    made = _sketched(docs, percent, text, doc_id)
    own = F.coalesce("set_key", F.lit(b"")).alias("_key")
    rows = _components_of(made, docs, percent, text, doc_id).where("kept AND doc_id IS NOT NULL")
    stay = materialise(rows.select(F.col("doc_id").alias("_kept"), own).distinct(), "kept")
    of_id = made.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows"))
    ids = materialise(
        of_id.join(stay.select("_kept", F.lit(True).alias("_stays")).distinct(), "_kept", "left").select(
            "_kept", "_rows", F.coalesce("_stays", F.lit(False)).alias("_stays")),
        "ids",
    )
    own_id = F.col(f"`{doc_id}`").cast("long")
    same_id = own_id == F.col("_kept")
    # Most ids stay, so those that do not are the fewer to send to the texts.
    others = materialise(ids.where("NOT _stays OR _rows > 1").select("_kept"), "other-ids")
    alone = docs.where(own_id.isNotNull()).join(_light(others, others.count(), ID_BYTES), same_id, "left_anti")
    # Written, as the semi join below would else be moved under this one, and every text cut into words for it.
    shared_ids = materialise(ids.where("_stays AND _rows > 1").select("_kept"), "repeated-ids")
    several = materialise(
        docs.join(shared_ids, same_id).select(
            "_kept",
            F.pandas_udf(_key_of, "binary")(F.col(f"`{text}`")).alias("_key"),
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        ),
        "repeated",
    )
    for done in (rows, ids, shared_ids):
        release(done)
    firsts = several.join(stay, ["_kept", "_key"], "left_semi").groupBy("_kept", "_key").agg(F.min("_row").alias("_row"))
    return alone.unionByName(firsts.select("_row.*")).unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
