"""The operators applied to the given tables, one query each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surcos.llm import attribution, bpe, infill, lines, minhash, mixing, phrases, quality, secrets, tokenfiles, toxicity, urls, vectors
from surcos.llm.shipping import ship
from surcos.sources.scratch import materialise, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query
def op3_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    taken = mixing.words_taken(mixing.mix(_read(spark, sf, "documents")))
    return taken.select("doc.doc_id", "size", "source_size", "target", "taken")


@query
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    stats = quality.statistics(_read(spark, sf, "documents"))
    doc = F.struct("doc.doc_id", "doc.lang", "doc.source")
    narrow = materialise(stats.withColumn("doc", doc), "quality")
    judged = quality.judge(narrow, quality.fit(narrow))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc.doc_id", *counts, "base_failed", "kept", "distance")


@query
def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    judged = urls.judge(_read(spark, sf, "pages"))
    return judged.select("doc.page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


SQL["op6_url_filter"] = urls.sql()


@query
def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    tokenfiles.write(_read(spark, sf, "documents"), path)
    return tokenfiles.read(spark, path, ids=False)


@query
def op9_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(_read(spark, sf, "documents")))
    return decoded.select(
        "doc.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op10_section_tokens(spark: SparkSession, sf: str) -> DataFrame:
    counted = attribution.section_tokens(_read(spark, sf, "documents"))
    return counted.select("doc.doc_id", "section", "start", "end", "n_tokens")


@query
def op4_minhash_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_copies(_read(spark, sf, "documents"), percent=85)


@query
def op1_embedding_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(_read(spark, sf, "embeddings"))


@query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _read(spark, sf, "documents"), _read(spark, sf, "labels")
    seen = toxicity.bounded(labels.where(~toxicity.held_out(F.col("doc_id"))))
    # At most MAX_LABELLED rows of two numbers: the texts stay where they are.
    model = toxicity.fit(docs.select("doc_id", "text").join(F.broadcast(seen), "doc_id"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc.doc_id", toxicity.held_out(F.col("doc.doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst",
    )


@query
def op8_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select(
        "doc.doc_id", "nth", F.length("candidate").cast("long").alias("n_chars"),
        F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 4).alias("probability"), "secret",
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    moved = infill.infill(_read(spark, sf, "documents"))
    return moved.select(
        "doc.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"),
    )


SQL["op11_fill_in_middle"] = infill.sql()


@query
def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op12_line_dedup"] = lines.sql()


@query
def op13_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf, "documents"))


SQL["op13_phrase_collocations"] = phrases.sql()
