"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

The base rules reject texts that are too short or repeat themselves. What passes is
judged by its statistic vector: for each language and source the minimum covariance
determinant (MCD) gives the centre and the scatter of the most concentrated part of
the vectors, and a document far from the centre by Mahalanobis distance is rejected.

The search for that part starts twice in each group, from the deviations of each statistic
by itself and from the signs of all of them together, and goes on in each until the
determinant of the scatter falls no more; the smaller determinant is taken.

All of it is column expressions, grouped sums and joins. A group's sums are merged
before the shuffle, so a source that holds a third of the corpus costs no more than
another. Statistics are held as integers and added exactly: reruns agree.

Defined cases: a null or empty text has no words and fails the base rules; null
languages and sources are groups of their own; groups with fewer than ``MIN_GROUP``
passing documents are judged with the other small groups of their language, and if
these are too few as well, with those of all languages; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from surcos.llm.words import NOT_BLANK, words
from surcos.sources.scratch import materialise, release

WINDOW = 5  # words; a window found twice or more is a repetition
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of the words
SYMBOLS = "[^#*$%&|<>]+"  # all but the symbols that are counted

# The statistic vector: name, least standard deviation it is credited with. Shares are
# taken to their square root, which evens out their spread; the floor keeps a statistic
# that is constant in a group (no symbols at all) from condemning the first exception.
FEATURES = {"length": 0.08, "symbols": 0.05, "capitals": 0.05, "repeats": 0.12, "dup_lines": 0.15}
UNIT = 1000  # steps per unit of a statistic
SUPPORT = 0.75  # part of a group that the estimate rests on, at least
STEPS = 50  # concentration steps, at most; a group rests when its determinant falls no more
FALL = 1e-9  # least fall of the determinant's logarithm that counts
CUTOFF = 1e-5  # share of a normal population that lies beyond the limit
MIN_GROUP = 50
_P = len(FEATURES)
_Q = [f"_q_{n}" for n in FEATURES]
_GROUP = "_group"  # of rows and estimates: struct of the group and the start
_STARTS = ("deviations", "signs")


def _chi2_cdf(x: float, k: int) -> float:
    term = total = 1 / math.gamma(k / 2 + 1)
    for i in range(1, 500):
        term *= (x / 2) / (k / 2 + i)
        total += term
    return total * (x / 2) ** (k / 2) * math.exp(-x / 2)


def _chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < q else (low, mid)
    return high


LIMIT = _chi2_quantile(1 - CUTOFF, _P)  # of the squared distance
# The scatter of the inner part of a normal population, scaled up to that of the whole.
SCALE = SUPPORT / _chi2_cdf(_chi2_quantile(SUPPORT, _P), _P + 2)


def _covered(windows: Column) -> Column:
    """Places within a window whose content occurs twice or more; overlaps count once."""
    tagged = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    # One array of one array: the sorted windows are bound once and not built per element.
    found = F.get(F.transform(F.array(tagged), starts), F.lit(0))
    return F.aggregate(
        found,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(
            i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")
        ),
        lambda a: a["n"],
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Struct ``doc`` of the given columns, and the statistics of ``text`` beside it.

    One pass over the text without a shuffle.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    t = F.coalesce(F.col("doc")[text], F.lit(""))
    split = d.select("doc", words(t).alias("_words"), F.split(t, "\n").alias("_lines"))
    lines = F.filter("_lines", lambda x: x.rlike(NOT_BLANK))
    n = F.size("_words")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)),
            lambda i: F.array_join(F.slice("_words", i, WINDOW), " "),
        ),
    )
    parts = split.select(
        "doc",
        F.array_join("_words", "").alias("_solid"),
        n.cast("long").alias("n_words"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    only = lambda pattern: F.length(F.regexp_replace("_solid", pattern, "")).cast("long")
    counted = parts.select(
        "doc",
        "n_words",
        F.length("_solid").cast("long").alias("word_chars"),
        only(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, _covered(F.col("_windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        only(r"[^\p{Lu}]+").alias("n_capitals"),
    )
    # Generated, not projected: a filter on the verdict stays above and does not repeat the counting.
    once = counted.select(F.inline(F.array(F.struct(*counted.columns))))
    return once.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
    )


def _vector() -> list[Column]:
    """The transformed statistics in whole steps. Shares are drawn to a usual value in short texts."""
    n, c = F.col("n_words"), F.col("word_chars")
    f = {
        "length": F.log((c + 250) / (n + 50)),
        "symbols": F.sqrt(F.col("n_symbols") / (c + 100)),
        "capitals": F.sqrt((F.col("n_capitals") + 2) / (c + 100)),
        "repeats": F.sqrt(F.col("n_repeat_words") / (n + 50)),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
    }
    return [F.round(f[name] * UNIT).cast("long").alias(f"_q_{name}") for name in FEATURES]


def _keys(lang: Column, source: Column) -> list[Column]:
    """From fine to coarse; JSON keeps null apart from any value."""
    return [F.to_json(F.struct(lang.alias("l"), source.alias("s"))), F.to_json(F.struct(lang.alias("l"))), F.lit("{*}")]


def _reach(df: DataFrame, value: str, keys: list[str], share: float) -> DataFrame:
    """Per group the least ``value`` that ``share`` of its rows do not exceed.

    Rows are counted per distinct value first: the window sees these counts, not rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_n").over(W.partitionBy(*keys))
    ran = counts.withColumn("_enough", F.sum("_n").over(upto) >= F.ceil(total * share))
    return ran.where("_enough").groupBy(*keys).agg(F.min(value).alias("_reach"))


def _centred(df: DataFrame, share_of: str, values: Column) -> DataFrame:
    """Per group one column per statistic: the median of ``values``, an array in their order."""
    long = df.select(_GROUP, F.posexplode(values).alias("_j", share_of))
    reach = _reach(long, share_of, [_GROUP, "_j"], 0.5)
    at = [F.max(F.when(F.col("_j") == j, F.col("_reach"))).alias(f"_m{j}") for j in range(_P)]
    return reach.groupBy(_GROUP).agg(*at)


_ESTIMATE = [*[f"_m{j}" for j in range(_P)], *[f"_i{i}{j}" for i in range(_P) for j in range(i + 1)], "_log_det"]


def _factor(params: DataFrame, cov) -> DataFrame:
    """Keep the means and add ``_i{i}{j}``: the inverse of the scatter's Cholesky factor."""
    out = params
    for i in range(_P):
        for j in range(i + 1):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            out = out.withColumn(f"_l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"_l{j}{j}"))
    for i in range(_P):
        for j in range(i + 1):
            rest = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_i{k}{j}")
            out = out.withColumn(f"_i{i}{j}", rest / F.col(f"_l{i}{i}"))
    log_det = -2 * sum((F.ln(f"_i{i}{i}") for i in range(1, _P)), F.ln("_i00"))
    return out.select(_GROUP, *_ESTIMATE[:-1], log_det.alias(_ESTIMATE[-1]))


def _distance() -> Column:
    """The squared Mahalanobis distance."""
    off = [F.col(q) / UNIT - F.col(f"_m{j}") for j, q in enumerate(_Q)]
    total = F.lit(0.0)
    for i in range(_P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"_i{i}{j}") * off[j]
        total = total + F.pow(z, 2)
    return total


def _initial(rows: DataFrame) -> DataFrame:
    """Both starts of each group: centre at the medians, scatter from the median deviations.

    One scatter is diagonal. The other has the correlations of the rows' directions, each
    row counted with length one, in which a far row weighs no more than a near one.
    """
    step = F.array(*_Q)
    mid = materialise(_centred(rows, "_v", step), "mcd-median")
    off = F.array(*[F.abs(F.col(q) - F.col(f"_m{j}")) for j, q in enumerate(_Q)])
    mad = _centred(rows.join(mid, _GROUP), "_v", off).select(
        _GROUP, *[F.col(f"_m{j}").alias(f"_s{j}") for j in range(_P)]
    )
    floors = list(FEATURES.values())
    width = [F.sqrt(F.pow(1.4826 * F.col(f"_s{j}") / UNIT, 2) + floors[j] ** 2) for j in range(_P)]
    both = materialise(
        mid.join(mad, _GROUP).select(
            _GROUP, *[(F.col(f"_m{j}") / UNIT).alias(f"_m{j}") for j in range(_P)],
            *[w.alias(f"_w{j}") for j, w in enumerate(width)],
        ),
        "mcd-widths",
    )
    scaled = rows.join(both, _GROUP).select(
        _GROUP, *[((F.col(q) / UNIT - F.col(f"_m{j}")) / F.col(f"_w{j}")).alias(f"_z{j}") for j, q in enumerate(_Q)]
    )
    long = F.sqrt(sum((F.pow(f"_z{j}", 2) for j in range(1, _P)), F.pow("_z0", 2)))
    turned = scaled.withColumn("_long", long).select(
        _GROUP,
        *[F.coalesce(F.round(UNIT * F.try_divide(f"_z{j}", "_long")), F.lit(0)).cast("long").alias(f"_u{j}") for j in range(_P)],
    )
    cells = [(i, j) for i in range(_P) for j in range(i + 1)]
    # Whole steps, so that sums do not depend on their order.
    sums = turned.groupBy(_GROUP).agg(
        F.count("*").alias("_n"), *[F.sum(F.col(f"_u{i}") * F.col(f"_u{j}")).alias(f"_c{i}{j}") for i, j in cells]
    )
    signs = materialise(both.join(sums, _GROUP), "mcd-signs")

    def start(name: str, cov) -> DataFrame:
        made = _factor(signs, lambda i, j: F.col(f"_w{i}") * F.col(f"_w{j}") * cov(i, j))
        return made.withColumn(_GROUP, F.struct(F.col(_GROUP)["of"].alias("of"), F.lit(name).alias("start")))

    # A tenth of the diagonal keeps the scatter of directions that lie in a plane regular.
    direction = lambda i, j: (
        0.9 * _P * F.col(f"_c{i}{j}") / F.col("_n") / UNIT**2 + F.lit(0.1 if i == j else 0.0)
    )
    plain = start(_STARTS[0], lambda i, j: F.lit(1.0 if i == j else 0.0))
    return plain.unionByName(start(_STARTS[1], direction))


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One step: the mean and scatter of each group's nearest ``SUPPORT`` part.

    Distances are compared in fine logarithmic steps; all rows at the last step count.
    """
    placed = rows.join(params, _GROUP).select(
        _GROUP, *_Q, F.floor(64 * F.log2(1 + _distance())).alias("_bin")
    )
    # Written down, so that the join below starts from two tables and a swollen group is split.
    near = materialise(_reach(placed, "_bin", [_GROUP], SUPPORT), "mcd-reach")
    inner = placed.join(near, _GROUP).where(F.col("_bin") <= F.col("_reach"))
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    sums = inner.groupBy(_GROUP).agg(
        F.count("*").cast("double").alias("_n"),
        *[exact(F.col(q)).cast("double").alias(f"_t{i}") for i, q in enumerate(_Q)],
        *[
            exact(F.col(_Q[i]) * F.col(_Q[j])).cast("double").alias(f"_c{i}{j}")
            for i in range(_P)
            for j in range(i + 1)
        ],
    )
    mean = lambda i: F.col(f"_t{i}") / F.col("_n")
    floors = list(FEATURES.values())
    cov = lambda i, j: (
        SCALE * (F.col(f"_c{i}{j}") / F.col("_n") - mean(i) * mean(j)) / UNIT**2
        + F.lit(floors[i] ** 2 if i == j else 0.0)
    )
    return _factor(sums.withColumns({f"_m{i}": mean(i) / UNIT for i in range(_P)}), cov)


def _rest(rows: DataFrame, started: DataFrame) -> DataFrame:
    """Concentration steps from each start until its determinant falls no more; the last that fell."""
    best = materialise(_concentrate(rows, started).withColumn("_open", F.lit(True)), "mcd-step")
    for _ in range(STEPS - 1):
        made = _concentrate(rows, best.where("_open").select(_GROUP, *_ESTIMATE))
        new = made.select(F.col(_GROUP).alias("_of"), F.struct(*_ESTIMATE).alias("_new"))
        falls = F.coalesce(F.col("_new")["_log_det"] < F.col("_log_det") - FALL, F.lit(False))
        better = best.join(new, F.col(_GROUP) == F.col("_of"), "left").select(
            _GROUP, *[F.when(falls, F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in _ESTIMATE], falls.alias("_open")
        )
        before, best = best, materialise(better, "mcd-step")
        release(before)
        if best.where("_open").isEmpty():
            break
    return best


def fit(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Centre and factored scatter of each group of documents that pass the base rules.

    ``stats`` is what :func:`statistics` gives and should be written down: it is read
    twice, its narrow columns only. Steps read the vectors, and write one row per group and
    start. The result is a written table of a row per language and source.
    """
    keys = _keys(F.col("doc")[lang], F.col("doc")[source])
    named = stats.where(~F.col("base_failed")).select(
        *[k.alias(f"_k{i}") for i, k in enumerate(keys)], *_vector()
    )
    sizes = materialise(named.groupBy("_k0", "_k1").agg(F.count("*").alias("_n")), "mcd-groups")
    pools = sizes.where(F.col("_n") < MIN_GROUP).groupBy("_k1").agg(F.sum("_n").alias("_pool"))
    placed = materialise(
        sizes.join(pools, "_k1", "left").select(
            "_k0",
            F.when(F.col("_n") >= MIN_GROUP, F.col("_k0"))
            .when(F.col("_pool") >= MIN_GROUP, F.col("_k1"))
            .otherwise("{*}")
            .alias(_GROUP),
        ),
        "mcd-placed",
    )
    start = lambda name: F.struct(F.col(_GROUP).alias("of"), F.lit(name).alias("start")).alias(_GROUP)
    rows = materialise(named.join(placed, "_k0").select(start(_STARTS[0]), *_Q), "mcd-rows")
    started = materialise(_initial(rows), "mcd-start")
    twice = F.explode(F.array(*[F.lit(name) for name in _STARTS])).alias("_start")
    both = materialise(
        rows.select("*", twice).withColumn(_GROUP, F.struct(F.col(_GROUP)["of"].alias("of"), F.col("_start").alias("start"))).drop("_start"),
        "mcd-both",
    )
    rested = _rest(both, started)
    # Of equal determinants the first start's.
    chosen = rested.groupBy(F.col(_GROUP)["of"].alias("_of")).agg(
        F.min_by(F.struct(*_ESTIMATE), F.struct("_log_det", F.col(_GROUP)["start"])).alias("_best")
    )
    fitted = materialise(
        placed.join(chosen, F.col(_GROUP) == F.col("_of")).select("_k0", *[F.col("_best")[c].alias(c) for c in _ESTIMATE[:-1]]),
        "mcd-fitted",
    )
    for table in (sizes, placed, rows, both, started, rested):
        release(table)
    return fitted


def judge(stats: DataFrame, fitted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Add ``distance`` (null if the base rules failed) and ``kept``."""
    key = _keys(F.col("doc")[lang], F.col("doc")[source])[0]
    joined = stats.select("*", key.alias("_k0"), *_vector()).join(fitted, "_k0", "left")
    judged = joined.select(*stats.columns, _distance().alias("_d2"))
    return judged.select(
        *stats.columns,
        F.when(~F.col("base_failed"), F.sqrt("_d2")).alias("distance"),
        (~F.col("base_failed") & (F.col("_d2") <= LIMIT)).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that neither the base rules nor the distance reject, columns unchanged.

    Documents are written once with their statistics, which the estimate reads and the verdict
    reads again. Only numbers of a row per language and source meet them there.
    """
    stats = materialise(statistics(docs, text), "quality")
    fitted = fit(stats, lang, source)
    return judge(stats, fitted, lang, source).where("kept").select("doc.*")
