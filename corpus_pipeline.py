"""Documents to token ids in five stages, each over all rows that the one before kept.

1. quality rules: documents that fail the base rules or lie far from their language and
   source go;
2. near copies: one document of each group stays, linked by a shingle similarity of 0.8 or more;
3. secrets: findings that the forest confirms are masked in the text;
4. source mix: documents appear as often as the schedule takes their beginning, so some
   sources repeat and others shrink to their targets; documents without words are not taken;
5. token ids: every text as byte-level BPE ids, with the digests of ids and decoded bytes.

A stage reads its own input only; its models and statistics come from that input. Stage 5
returns ``doc_id``, ``n_tokens``, ``ids``, ``ids_sha256`` and ``decoded_sha256``; the others
return the columns of documents. Nulls, empty texts, repeated rows and empty tables pass
through the stages as their operators define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surcos.llm import bpe, minhash, mixing, quality, secrets
from surcos.llm.shipping import ship
from surcos.sources.scratch import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_first(docs, percent=minhash.KEEP_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    decoded = bpe.decode(bpe.encode(docs))
    return decoded.select(
        "doc.doc_id", "n_tokens", "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
