"""URL filter: host rules first, then a weighted vocabulary found with Aho-Corasick.

A rule names a host and the beginning of a path; it holds for the host and its
subdomains, and the longest that fits decides. Elsewhere the whole URL is searched for
terms in one pass. A hit counts between boundaries only (no ASCII letter or digit next to
it), so ``sex`` is not found in ``essex``. One strict term blocks, and so do
``SOFT_HITS`` different soft ones.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no
rule; a null or empty URL has no hits and is allowed; letters are compared without ASCII
case; repeated rows are judged alike. Columns to keep come back in the struct ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
STRICT = (
    "casino", "gambling", "hentai", "hookup", "jackpot", "malware", "nude", "phishing", "poker",
    "porn", "porno", "roulette", "sex", "viagra", "warez", "xxx",
)
SOFT = (
    "adult", "bet", "bonus", "cheap", "click", "coupon", "crack", "deal", "escort", "free", "hack",
    "hot", "keygen", "loan", "lottery", "pharmacy", "pills", "prize", "replica", "torrent", "win",
)
SOFT_HITS = 2

MAX_TERMS, MAX_TERM = 100_000, 200


def vocabulary(table: DataFrame, term: str = "term", weight: str = "weight", whole: int = SOFT_HITS) -> tuple[tuple, tuple]:
    """Strict and soft terms of a table, for :func:`judge`: strict is a weight of ``whole`` or more, soft one above zero.

    Terms are trimmed and lose their ASCII case; of repeated ones the largest weight counts;
    null and empty terms, and those without a weight above zero, are left out. Every executor
    holds the vocabulary, so more than ``MAX_TERMS`` terms, or one of more than ``MAX_TERM``
    characters, are refused.
    """
    upper = F.trim(F.col(f"`{term}`").cast("string"))
    low = F.translate(upper, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    given = table.select(low.alias("t"), F.col(f"`{weight}`").cast("double").alias("w"))
    best = given.where("t <> '' AND w > 0 AND NOT isnan(w)").groupBy("t").agg(F.max("w").alias("w"))
    rows = best.select(F.left("t", F.lit(MAX_TERM + 1)).alias("t"), "w").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS or any(len(r["t"]) > MAX_TERM for r in rows):
        raise ValueError(f"a vocabulary has at most {MAX_TERMS} terms of at most {MAX_TERM} characters")
    rows.sort(key=lambda r: r["t"])
    return tuple(r["t"] for r in rows if r["w"] >= whole), tuple(r["t"] for r in rows if r["w"] < whole)


def automaton(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, term in enumerate((*strict, *soft)):
        found.add_word(term, (k, len(term)))
    found.make_automaton()
    return found


_UPPER = {c: c + 32 for c in range(65, 91)}


def hits(url: str, found: ahocorasick.Automaton) -> set[int]:
    """Numbers of the terms that stand between boundaries."""
    if not len(found):
        return set()
    low = url.translate(_UPPER)
    word = lambda i: 0 <= i < len(low) and low[i].isascii() and low[i].isalnum()
    return {k for end, (k, n) in found.iter(low) if not word(end - n) and not word(end + 1)}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Columns of the host, ASCII lower case, and of the path."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _rule(host: Column, path: Column, rules) -> Column:
    """The struct (rule, verdict) of the longest fitting rule, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def judge(
    pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES,
    strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """``doc``, ``host``, ``path``, ``rule``, ``verdict``, ``n_strict``, ``n_soft`` for every row."""
    link = F.col(f"`{url}`")
    host, path = host_and_path(link)
    given = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), host.alias("host"), path.alias("path"), link.alias("_url")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft)
        for batch in batches:
            sets = [hits(u, found) if u else set() for u in batch.column("_url").to_pylist()]
            n_strict = np.array([sum(k < len(strict) for k in s) for s in sets], "i8")
            n_all = np.array([len(s) for s in sets], "i8")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n_strict), pa.array(n_all - n_strict)],
                ["doc", "host", "path", "n_strict", "n_soft"],
            )

    doc = given.schema["doc"].dataType.simpleString()
    counted = given.mapInArrow(run, f"doc {doc}, host string, path string, n_strict bigint, n_soft bigint")
    bad = (F.col("n_strict") > 0) | (F.col("n_soft") >= soft_hits)
    ruled = counted.withColumn("_r", _rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(bad, "block").otherwise("allow"))
    return ruled.select("doc", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft")


def sql(table: str = "pages", key: str = "page_id") -> str:
    """The same verdicts in DuckDB SQL: one regular expression per term, rules as a joined list."""
    one = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::BIGINT"
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH cut AS (
            SELECT {key}, {lower("coalesce(url, '')")} AS low,
                   CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after
            FROM {table}
        ), parts AS (
            SELECT {key}, low, {lower("regexp_extract(after, '^[^/?#]*')")} AS host,
                   regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path,
                   {" + ".join(map(one, STRICT))} AS n_strict,
                   {" + ".join(map(one, SOFT))} AS n_soft
            FROM cut
        ), rules(h, p, v) AS (VALUES {listed})
        SELECT {key}, host, path, arg_max(h || p, length(h || p)) AS rule,
               coalesce(arg_max(v, length(h || p)),
                        CASE WHEN n_strict > 0 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict,
               n_strict, n_soft
        FROM (SELECT row_number() OVER () AS n, * FROM parts)
        LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY n, {key}, host, path, n_strict, n_soft"""
