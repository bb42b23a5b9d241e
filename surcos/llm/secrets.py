"""Secret scans: candidates by shape or context, false positives removed by a random forest.

A candidate by shape is a run of at least ``SHORTEST`` letters, digits and ``+ / _ = -`` with
a digit in it. A candidate by context is what stands after a naming word (``password``,
``api_key`` and such, with up to 12 more letters, digits, ``_`` or ``-``) and ``=`` or ``:``: at
least ``LEAST`` characters of any kind but blanks and quotes, up to the next of these. Where
both begin at one place, or a run holds the naming word and its ``=``, context decides. The
forest sees its length, how likely its character transitions are in the corpus's words, how
much of it dictionary words cover, signs of a path, its make-up, and the words beside it. Transitions and dictionary come from counts over all texts; of the
counts only the transition table (37 x 37) and the ``DICTIONARY`` most frequent words
reach the driver.

Labelled findings are the training data. Without a table of them, :func:`findings` makes
some: for at most ``MAX_DOCS`` documents, digests of their text are set as keys, tokens and
passwords (true) and as checksums and identifiers (false), and the documents' own words are
joined to paths, names, numbers and calls, or set alone after a naming word (false).

Everything is column expressions and Spark's own forest: no Python runs on executors.

Defined cases: null and empty texts have no candidates; a candidate may be of any length;
without labelled findings of both kinds no candidate counts as a false positive; repeated
rows have the same findings; null ids and null neighbours are allowed.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surcos.llm.words import words
from surcos.sources.scratch import materialise

SHORTEST, LEAST = 16, 8
_SET = "A-Za-z0-9+/_=-"
_VALUE = r"[^\x09-\x0D\x20\"'`]"
NAME = (
    r"(?i:token|secret|passw|pwd|api[ _.-]?key|access[ _.-]?key|private|credential|auth(?!ors?[^a-z])|bearer|client[ _.-]?id|signing)"
    r"[A-Za-z0-9_-]{0,12}"
)
# The short looks back leave few places at which the long one is tried.
_CONTEXT = (
    rf"(?<=[=:][\x20\t]{{0,3}}[\"'`]?)(?<={NAME}[\"'`]?[\x20\t]{{0,3}}[=:][\x20\t]{{0,3}}[\"'`]?){_VALUE}{{{LEAST},}}+"
)
_SHAPE = (
    rf"(?<!=)(?=[A-Za-z+/_=-]*+[0-9])(?![A-Za-z0-9_-]{{0,24}}?{NAME}={_VALUE}{{{LEAST}}})[{_SET}]{{{SHORTEST},}}+"
)
CANDIDATE = f"(?<![A-Za-z0-9+/_-])(?:{_CONTEXT}|{_SHAPE})"
DICTIONARY = 5000
MAX_DOCS = 2000
TREES, DEPTH, SEED = 40, 8, 11
LIMIT = 0.5
MASK = "[SECRET]"
MAX_BROADCAST = 16 << 20
BEFORE, AFTER = 48, 24  # characters of context
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_N = len(_LETTERS) + 1
NAMING = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private|credential|auth|bearer|client.?id|signing)"
BENIGN = r"(?i)(commit|sha-?\d|md5|checksum|digest|etag|revision|uuid|build|version|hash)"
FEATURES = (
    "length", "transitions", "coverage", "path", "url", "digits", "capitals", "hex", "distinct", "naming",
    "benign", "assigned", "quoted", "digit_runs", "symbols", "kinds",
)


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc``, ``nth``, ``candidate``, ``before`` and ``after``: one row per candidate."""
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col(f"`{text}`").alias("_text"))
    found = given.withColumn("_found", F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))).where(F.size("_found") > 0)
    cut = found.select("doc", "_found", F.split("_text", CANDIDATE).alias("_rest"))
    rows = F.transform(
        "_found",
        lambda c, k: F.struct(
            k.alias("nth"), c.alias("candidate"),
            F.right(F.get("_rest", k), F.lit(BEFORE)).alias("before"),
            F.left(F.get("_rest", k + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    return cut.select("doc", F.inline(rows))


def _class(c: Column) -> Column:
    return F.instr(F.lit(_LETTERS), c)


def _steps(low: Column) -> Column:
    """Numbers of the n - 1 transitions of n characters; linear in n, where a substring at each place is not."""
    kinds = F.transform(F.split(low, ""), _class)
    return F.zip_with(F.slice(kinds, F.lit(1), F.length(low) - 1), F.slice(kinds, F.lit(2), F.length(low) - 1), lambda a, b: a * _N + b)


def language(docs: DataFrame, text: str = "text") -> tuple[list[float], list[str]]:
    """Log probabilities of character transitions in the words of all texts, and the most frequent words."""
    plain = docs.select(F.explode(words(F.lower(F.regexp_replace(text, r"[^\p{L}\s]+", " ")))).alias("word"))
    counts = materialise(plain.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    frequent = counts.where(F.length("word") >= 3).orderBy(F.desc("n"), "word").limit(DICTIONARY)
    known = [r["word"] for r in frequent.select("word").collect()]
    steps = counts.where(F.length("word") >= 2).select(F.explode(_steps(F.col("word"))).alias("step"), "n").groupBy("step").agg(F.sum("n").alias("n"))
    seen = {r["step"]: r["n"] for r in steps.collect()}  # at most 37 * 37 rows
    table = []
    for a in range(_N):
        row = [seen.get(a * _N + b, 0) + 0.5 for b in range(_N)]
        table += [math.log(x / sum(row)) for x in row]
    return table, known


def with_features(rows: DataFrame, table: list[float], known: list[str]) -> DataFrame:
    """Add the columns of ``FEATURES``, all doubles."""
    c, low = F.col("candidate"), F.lower("candidate")
    log = F.lit(table)
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / F.length(c)
    parts = F.regexp_extract_all(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), F.lit("[A-Za-z]{3,}"), F.lit(0))
    covered = F.aggregate(
        F.filter(parts, lambda p: F.array_contains(F.lit(known or [""]), F.lower(p))),
        F.lit(0), lambda total, p: total + F.length(p),
    )
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    made = {
        "length": F.length(c).cast("double"),
        "transitions": F.aggregate(_steps(low), F.lit(0.0), lambda total, k: total + F.get(log, k)) / (F.length(c) - 1),
        "coverage": covered / F.length(c),
        "path": F.regexp_count(c, F.lit("/")) / F.length(c),
        "url": flag(F.col("before").rlike(r"(://|[./~\\])\S*$") | c.rlike(r"^/|/.*/.*/")),
        "digits": share("[^0-9]+"),
        "capitals": share("[^A-Z]+"),
        "hex": flag(c.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")),
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / F.least(F.length(c), F.lit(_N)),
        "naming": flag(F.right("before", F.lit(24)).rlike(NAMING)),
        "benign": flag(F.right("before", F.lit(24)).rlike(BENIGN)),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "digit_runs": F.regexp_count(c, F.lit("[0-9]+")) / F.length(c),
        "symbols": share("[A-Za-z0-9]+"),
        "kinds": sum((flag(c.rlike(k)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0.0)),
    }
    return rows.withColumns({name: made[name].cast("double") for name in FEATURES})


def findings(docs: DataFrame, text: str = "text", most: int = MAX_DOCS) -> DataFrame:
    """Labelled findings: ``before``, ``candidate``, ``after`` and ``label`` (1: a secret)."""
    some = docs.where(F.length(text) >= 80).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    n = some.count()
    if n > most:  # an even share by hash, a little below the bound, which the limit then only enforces
        some = some.where(F.pmod("h", F.lit(1_000_003)) < int(970_003 * most / n)).limit(most)
    plain = F.array_distinct(words(F.lower(F.regexp_replace("t", r"[^A-Za-z\s]+", " "))))
    w = lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit("word"))
    salted = lambda k: F.concat("t", F.lit(str(k)))
    sha1, sha2, md5 = (lambda k: F.sha1(salted(k))), (lambda k: F.sha2(salted(k), 256)), (lambda k: F.md5(salted(k)))
    coded = lambda k: F.regexp_replace(F.base64(F.unhex(sha2(k))), "[^A-Za-z0-9+/=]", "")
    letters = lambda k: F.regexp_replace(coded(k), "[^A-Za-z]", "")
    alone = lambda k: F.coalesce(F.get(F.filter("w", lambda x: F.length(x) >= LEAST), F.lit(k)), F.concat(w(k), w(k + 1)))
    date = F.concat(F.lit("20"), F.lpad(F.pmod("h", F.lit(28)).cast("string"), 2, "0"))
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = [  # label, before, candidate, after
        (1, cat(w(0), ' token = "'), sha1(1), cat('" ', w(1))),
        (1, cat(w(0), ' TOKEN = "'), F.upper(sha1(2)), F.lit('"!! ')),
        (1, cat(w(0), " api_key: "), md5(3), cat("\n", w(1))),
        (1, cat(w(0), " password="), F.substring(coded(4), 1, 20), cat(" ", w(1))),
        (1, cat(w(0), " aws access key "), cat("AKIA", F.upper(F.substring(md5(5), 1, 16))), cat(", ", w(1))),
        (1, cat("Authorization: Bearer "), coded(6), cat("\n", w(1))),
        (1, cat(w(0), ' "client_secret": "'), sha2(7), F.lit('", ')),
        (1, cat(w(0), " ", w(1), " "), cat("ghp_", F.substring(coded(8), 1, 36)), cat(" ", w(2))),
        (1, cat(w(0), " ", w(1), ' "'), sha1(9), cat('" ', w(2))),
        (1, cat(w(0), ' password = "'), cat(F.substring(coded(16), 1, 4), "!", F.substring(coded(16), 5, 3), "#", F.substring(coded(16), 8, 3)), F.lit('" ')),
        (1, cat(w(0), " pwd: "), F.substring(letters(17), 1, 12), cat(" ", w(1))),
        (1, cat(w(0), " secret='"), F.substring(md5(18), 1, 10), F.lit("'\n")),
        (1, cat(w(0), " db_password="), cat(F.initcap(w(1)), "$", F.substring(F.regexp_replace(sha2(19), "[a-f]", ""), 1, 4)), cat(" ", w(2))),
        (0, cat(w(0), " password: "), alone(0), cat(" ", w(1))),
        (0, cat(w(0), " token: "), cat(alone(1), ","), cat(" ", w(1))),
        (0, cat(w(0), " secret = "), cat(w(1), "-", w(2), "-", w(3)), cat(" ", w(4))),
        (0, cat(w(0), " auth = "), cat("get_", w(1), "(", w(2), ")"), cat("\n", w(3))),
        (0, cat(w(0), " api_key = "), cat("config.", w(1), ".", w(2)), cat("\n", w(3))),
        (0, cat(w(0), ' password: "'), cat("${", F.upper(w(1)), "_PASSWORD}"), F.lit('" ')),
        (0, cat(w(0), " secret="), cat("<your-", w(1), "-here>"), cat(" ", w(2))),
        (0, cat(w(0), " pwd: "), F.repeat(F.lit("*"), F.length(w(1)) + LEAST), cat(" ", w(2))),
        (0, cat(w(0), " credentials: "), cat("https://", w(1), ".example.com/", w(2)), cat(" ", w(3))),
        (0, cat(w(0), " commit "), sha1(11), cat(" ", w(1))),
        (0, cat(w(0), " sha256:"), sha2(12), cat(" ", w(1))),
        (0, cat(w(0), " checksum = "), md5(13), cat("\n", w(1))),
        (0, cat(w(0), " in "), cat("/usr/share/", w(1), "/", w(2), "/", w(3), "-", date), cat(".txt ", w(4))),
        (0, cat(w(0), " calls "), cat(w(1), "_", w(2), "_", w(3), "_", date), cat("() ", w(4))),
        (0, cat(w(0), " https://", w(1), ".example.com"), cat("/", w(2), "/", w(3), "/", w(4), "-", date, "/index"), F.lit(".html ")),
        (0, cat(w(0), " number "), F.substring(F.regexp_replace(sha2(14), "[a-f]", ""), 1, 18), cat(" ", w(1))),
        (0, cat(w(0), " uuid "), F.regexp_replace(md5(15), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), cat(" ", w(1))),
        (0, cat(w(0), " "), cat(w(1), w(2), w(3), date), cat(", ", w(4))),
        (0, cat(w(0), " ["), cat("=" * 12, date, "-" * 12), cat("] ", w(1))),
    ]
    rows = F.array(*[
        F.struct(b.alias("before"), c.alias("candidate"), a.alias("after"), F.lit(float(y)).alias("label")) for y, b, c, a in made
    ])
    named = F.col("before").rlike(f"{NAME}[\"'`]?[\\x20\\t]{{0,3}}[=:][\\x20\\t]{{0,3}}[\"'`]?$")
    least = F.when(named, LEAST).otherwise(SHORTEST)
    return some.select("t", "h", plain.alias("w")).select(F.inline(rows)).where(F.length("candidate") >= least)


def fit(labelled: DataFrame, table: list[float], known: list[str]) -> PipelineModel | None:
    """The forest on labelled findings; None unless both labels are there."""
    rows = materialise(with_features(labelled, table, known).select(*FEATURES, "label"), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    joined = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8
    )
    return PipelineModel([joined, forest.fit(joined.transform(rows))])


def train(docs: DataFrame, text: str = "text"):
    """Model, transitions and dictionary from the documents themselves."""
    table, known = language(docs, text)
    return fit(findings(docs, text), table, known), table, known


def scan(docs: DataFrame, trained, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc``, ``nth``, ``candidate``, ``probability`` and ``secret``: one row per candidate."""
    model, table, known = trained
    rows = candidates(docs, text, keep)
    if model is None:
        judged = rows.withColumn("probability", F.lit(1.0))
    else:
        judged = model.transform(with_features(rows, table, known)).withColumn(
            "probability", vector_to_array(F.col("probability"))[1])
    return judged.select("doc", "nth", "candidate", "probability", (F.col("probability") >= LIMIT).alias("secret"))


def redact(docs: DataFrame, trained, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents with every secret replaced by ``MASK``; other texts and columns unchanged.

    Verdicts are joined to their rows by two hashes of the text; rows of equal text have
    equal verdicts. They are few; up to ``MAX_BROADCAST`` bytes they are broadcast.
    """
    t = F.col(f"`{text}`")
    key = [F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2")]
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *key)
    found = scan(named, trained, text, ("_k1", "_k2")).where("secret")
    flags = materialise(
        found.groupBy("doc._k1", "doc._k2").agg(F.collect_set("nth").alias("_nth"), F.count("*").alias("_n")), "secrets"
    )
    held = flags.agg(F.sum(F.size("_nth") * 4 + 40)).first()[0] or 0
    both = named.join(F.broadcast(flags) if held <= MAX_BROADCAST else flags, ["_k1", "_k2"], "left")
    masked = F.transform(
        F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)),
        lambda c, k: F.when(F.array_contains("_nth", k), MASK).otherwise(c),
    )
    whole = F.array_join(F.flatten(F.zip_with(F.split(t, CANDIDATE), masked, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), "")
    out = both.withColumn(text, F.when(F.col("_nth").isNotNull(), whole).otherwise(t))
    if n_chars and n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.col("_nth").isNotNull(), F.length(text).cast(kind)).otherwise(F.col(n_chars)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
