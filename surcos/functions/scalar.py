"""Scalar expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and codes that results are compared against.
MALE = "hombre"
FEMALE = "mujer"
UNSPECIFIED = "no especifica"
FREQUENCIES = {
    "POPLATEK MESICNE": "emision mensual",
    "POPLATEK TYDNE": "emision semanal",
    "POPLATEK PO OBRATU": "emision despues de una transaccion",
}
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d")


def six_digits(code: Column) -> Column:
    """A yymmdd code as text; numbers that lost leading zeros get them back."""
    return F.lpad(code.cast("string"), 6, "0")


def gender_from_digits(birth_number: Column) -> Column:
    """The month digits encode gender: up to 50 is male, above (or unknown) female."""
    month = F.substring(six_digits(birth_number), 3, 2)
    return F.when(month <= "50", MALE).otherwise(FEMALE)


def code_map(code: Column, mapping: Mapping[str, str], default: str = UNSPECIFIED) -> Column:
    """Translate known codes, everything else (null included) to ``default``."""
    result = F
    for key, text in mapping.items():
        result = result.when(code == key, text)
    return result.otherwise(default) if mapping else F.lit(default)


def binary_label(code: Column, positive: list[str], yes: str, no: str) -> Column:
    """``yes`` for the listed codes, ``no`` for any other and for null."""
    return F.when(code.isin(positive), yes).otherwise(no)


def yymmdd_to_date(code: Column, pivot: int = 70) -> Column:
    """An integer yymmdd code as a date; years below ``pivot`` are 20yy.

    Codes whose month carries the gender offset of 50 are folded back.
    Impossible dates give null.
    """
    digits = six_digits(code)
    year = F.substring(digits, 1, 2).try_cast("int")
    month = F.substring(digits, 3, 2).try_cast("int")
    day = F.substring(digits, 5, 2).try_cast("int")
    century = F.when(year < pivot, 2000).otherwise(1900)
    month = F.when(month > 50, month - 50).otherwise(month)
    text = F.format_string("%04d-%02d-%02d", century + year, month, day)
    return F.when(digits.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits; day-first forms are tried before year-first."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def rescale(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo), null when the range is empty."""
    return F.try_divide(x - lo, hi - lo)


def unscale(z: Column, lo: Column, hi: Column) -> Column:
    return z * (hi - lo) + lo


def percentage_error(actual: Column, predicted: Column) -> Column:
    """|actual - predicted| / |actual| in percent, null when actual is zero."""
    return F.abs(F.try_divide(actual - predicted, actual)) * 100
