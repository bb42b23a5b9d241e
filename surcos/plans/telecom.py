"""Telecom: churn exploration and customer segments."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from surcos.operators.clean import drop_nulls, rename, trim_columns
from surcos.operators.features import encoder_stages
from surcos.operators.models import fit_holdout, segmenter
from surcos.sources.scratch import materialise

# The columns of the call table, in file order.
CATEGORIES = [
    "state", "account", "area_code", "phone_number", "international_plan", "voice_mail_plan",
]
MEASURES = [
    "number_vmail_messages",
    "total_day_minutes", "total_day_calls", "total_day_charge",
    "total_eve_minutes", "total_eve_calls", "total_eve_charge",
    "total_night_minutes", "total_night_calls", "total_night_charge",
    "total_intl_minutes", "total_intl_calls", "total_intl_charge",
    "number_customer_service_calls",
]
SEGMENT_CATEGORIES = ["area_code", "international_plan", "voice_mail_plan"]

# Coded columns are text, so that nothing averages an area code.
CALLS = StructType(
    [StructField(c, StringType()) for c in CATEGORIES]
    + [StructField(c, DoubleType()) for c in MEASURES]
    + [StructField("churn.", StringType())]
)
CALLS_DDL = ", ".join(
    [f"{c} STRING" for c in CATEGORIES] + [f"{c} FLOAT" for c in MEASURES] + ["churn STRING"]
)


def cleaned(calls: DataFrame) -> DataFrame:
    """Dotted churn column renamed, rows with nulls dropped, churn trimmed."""
    return trim_columns(drop_nulls(rename(calls, {"churn.": "churn"})), ["churn"])


def described(clean: DataFrame) -> DataFrame:
    """The 19 columns that describe a customer and the outcome."""
    categories = [c for c in CATEGORIES if c not in ("account", "phone_number")]
    return clean.select(*categories, *MEASURES, "churn")


def segment_columns(clean: DataFrame, *keep: str) -> DataFrame:
    """The 17 columns that are clustered on."""
    return clean.select(*keep, *SEGMENT_CATEGORIES, *MEASURES)


def stages() -> list:
    return encoder_stages(SEGMENT_CATEGORIES, MEASURES)


def segments(calls: DataFrame, key: str = "account", k: int = 5) -> tuple[PipelineModel, DataFrame]:
    """The whole analysis: cleaning, encoding, clusters of the test part."""
    table = materialise(segment_columns(cleaned(calls), key), "segment_columns")
    return fit_holdout(table, stages(), segmenter(k), key)
