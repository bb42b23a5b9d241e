"""Credit candidates: six bank tables to a labelled table and trained classifiers.

Input tables carry the column names of the bank data: client (client_id,
district_id, birth_number), district (A1, A2, A3, A4, A9, A10, A11), disp
(client_id, account_id, type), account (account_id, frequency, date), loan
(loan_id, account_id, amount, duration, payments, status), trans (account_id,
operation, amount, balance).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surcos.functions.scalar import FREQUENCIES, binary_label, code_map, gender_from_digits
from surcos.operators import models
from surcos.operators.aggregate import finish_partials, key_summary, merge_partials, summary_partials
from surcos.operators.clean import as_category, drop_nulls, pick
from surcos.operators.features import encoder_stages
from surcos.operators.joins import HOT_LOANS, few_keys, minable_table, restrict
from surcos.operators.skew import profile_key
from surcos.sources.scratch import materialise
from surcos.sources.tables import replace_version

# Names of the analysis' columns and labels.
YES, NO = "Candidato", "No candidato"
CANDIDATE_STATUS = ("A", "C")
CATEGORIES = ["region", "frecuencia_emision", "operation"]
NUMERICS = [
    "habitantes",
    "salario_promedio",
    "monto_prestamo",
    "duracion_prestamo",
    "pagos_mensuales",
    "monto_dinero_promedio",
    "balance_promedio",
    "cantidad_transacciones",
]
MODEL_COLUMNS = [
    "region", "habitantes", "salario_promedio", "frecuencia_emision", "monto_prestamo",
    "duracion_prestamo", "pagos_mensuales", "operation", "monto_dinero_promedio",
    "balance_promedio", "cantidad_transacciones", "estado",
]
SHORT_COLUMNS = [
    "district_id", "region", "habitantes", "ratio_residentes_urbanos", "salario_promedio",
    "frecuencia_emision", "monto_prestamo", "duracion_prestamo", "pagos_mensuales", "estado",
]
SHORT_CATEGORIES = ["district_id", "region", "frecuencia_emision"]
SHORT_NUMERICS = [
    "habitantes", "ratio_residentes_urbanos", "salario_promedio", "monto_prestamo",
    "duracion_prestamo", "pagos_mensuales",
]


@dataclass
class Bank:
    client: DataFrame
    district: DataFrame
    disp: DataFrame
    account: DataFrame
    loan: DataFrame
    trans: DataFrame


SUMMARY = {
    "largest": {"operation": "operation"},
    "averages": {"amount": "monto_dinero_promedio", "balance": "balance_promedio"},
    "count": "cantidad_transacciones",
}


def transaction_summary(trans: DataFrame) -> DataFrame:
    """Per account: largest operation, mean amount and balance, number of transactions."""
    return key_summary(trans, "account_id", **SUMMARY)


def append_transactions(spark: SparkSession, name: str, trans: DataFrame) -> DataFrame:
    """Add transactions to the kept partials ``name`` and give the summary of all so far.

    Only the new rows are summarised; their partials and the kept ones become the next
    version of ``name``, so a failed append changes nothing and may be run again.
    """
    new = summary_partials(trans, "account_id", largest=SUMMARY["largest"], averages=SUMMARY["averages"])
    if spark.catalog.tableExists(name):
        new = merge_partials(spark.table(name), new, key="account_id")
    kept = replace_version(new, name)
    return finish_partials(kept, "account_id", **SUMMARY)


def client_part(bank: Bank) -> DataFrame:
    return bank.client.select(
        "client_id", "district_id", gender_from_digits(F.col("birth_number")).alias("genero")
    )


def district_part(bank: Bank, *, urban: bool = False) -> DataFrame:
    names = {"A1": "districtid", "A2": "distrito", "A3": "region", "A4": "habitantes"}
    if urban:
        names |= {"A9": "num_ciudades", "A10": "ratio_residentes_urbanos"}
    return pick(bank.district, names | {"A11": "salario_promedio"})


def disp_part(bank: Bank) -> DataFrame:
    return pick(
        bank.disp,
        {"client_id": "c_id", "account_id": "account_id", "type": "tipo_disposicion_cliente"},
    )


def account_part(bank: Bank, frequencies: Mapping[str, str] = FREQUENCIES) -> DataFrame:
    return bank.account.select(
        F.col("account_id").alias("ac_id"),
        code_map(F.col("frequency"), frequencies).alias("frecuencia_emision"),
    )


def loan_part(bank: Bank) -> DataFrame:
    return pick(
        bank.loan,
        {
            "loan_id": "loan_id", "account_id": "acl_id", "amount": "monto_prestamo",
            "duration": "duracion_prestamo", "payments": "pagos_mensuales", "status": "estado",
        },
    )


def summary_part(bank: Bank) -> DataFrame:
    return transaction_summary(bank.trans).withColumnRenamed("account_id", "act_id")


def minable(bank: Bank, frequencies: Mapping[str, str] = FREQUENCIES) -> DataFrame:
    """The denormalised table: one row per loan and disposition of its account.

    Only accounts with a loan get into it. Where those are few, by a count of the loans and
    the accounts, transactions and dispositions are restricted to them before they are
    summarised or shuffled. Runs up to three Spark jobs.
    """
    loan = loan_part(bank)
    loans = profile_key(loan, "acl_id", HOT_LOANS)
    few = few_keys(loan, "acl_id", loans, bank.account.count())
    trans = restrict(bank.trans, "account_id", few)
    summary = transaction_summary(trans).withColumnRenamed("account_id", "act_id")
    return minable_table(
        client_part(bank), district_part(bank), restrict(disp_part(bank), "account_id", few),
        account_part(bank, frequencies), loan, summary, loans=loans,
    )


def minable_short(bank: Bank, frequencies: Mapping[str, str] = FREQUENCIES) -> DataFrame:
    """The five-table variant: all accounts, loan columns null where there is none."""
    return minable_table(
        client_part(bank), district_part(bank, urban=True), disp_part(bank),
        account_part(bank, frequencies), loan_part(bank), keep_loans=False,
    )


def labelled(
    table: DataFrame, columns: list[str], statuses=CANDIDATE_STATUS, key: str | None = None
) -> DataFrame:
    """Model columns without nulls, the status replaced by the candidate label."""
    kept = drop_nulls(table.select(*([key] if key else []), *columns))
    label = binary_label(F.col("estado"), list(statuses), YES, NO)
    return kept.withColumn("candidato", label).drop("estado")


def candidates(
    bank: Bank, frequencies=FREQUENCIES, statuses=CANDIDATE_STATUS, key: str | None = None
) -> DataFrame:
    return labelled(minable(bank, frequencies), MODEL_COLUMNS, statuses, key)


def candidates_short(
    bank: Bank, frequencies=FREQUENCIES, statuses=CANDIDATE_STATUS, key: str | None = None
) -> DataFrame:
    """The variant that treats the district number as a category."""
    table = as_category(minable_short(bank, frequencies), ["district_id"])
    return labelled(table, SHORT_COLUMNS, statuses, key)


def stages() -> list:
    """Encoding of :func:`candidates`; rows with unseen categories are skipped."""
    return encoder_stages(CATEGORIES, NUMERICS, label="candidato")


def stages_short() -> list:
    return encoder_stages(SHORT_CATEGORIES, SHORT_NUMERICS, label="candidato", unseen="error")


def classifiers() -> dict[str, Estimator]:
    return {
        "gbt": models.boosted_trees(),
        "tree": models.decision_tree(),
        "logreg_elastic": models.elastic_logistic(),
    }


def train(
    bank: Bank, frequencies=FREQUENCIES, statuses=CANDIDATE_STATUS, rounds: int = 3
) -> tuple[dict[str, models.Trained], DataFrame]:
    """The whole analysis: table, label, encoding, classifiers on repeated hold-outs."""
    table = materialise(candidates(bank, frequencies, statuses, key="loan_id"), "candidates")
    return models.compare_models(table, stages(), classifiers(), "loan_id", rounds)
