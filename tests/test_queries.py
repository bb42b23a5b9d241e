"""Every registered query with SQL, on the smallest given tables, and code rules."""

from __future__ import annotations

import os
import pathlib
import re

import check_queries
import pytest

import __spark_entry__ as contract
from surcos.checks import standins
from surcos.checks.all import QUERIES, SQL
from surcos.operators import models
from surcos.plans import credit

SF = "/root/testdata/sf0.001"
LIBRARY = pathlib.Path(__file__).parent.parent / "surcos"

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF)


@needs_tables
@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, con, name):
    assert check_queries.compare(spark, con, SF, name) is None


@needs_tables
@pytest.mark.parametrize("name", ["summary_approx", "ar_7_forecast", "ar_7_pooled_forecast", "ar_coefficients", "lag_arrays_7", "preview", "logreg", "tree_text", "importances", "kmeans_sizes"])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@needs_tables
def test_contract(spark):
    assert {r["candidato"] for r in contract.entry(spark).collect()} == {"Candidato", "No candidato"}
    assert set(contract.oracle_sql()) <= set(contract.queries())


@needs_tables
def test_credit_analysis_end_to_end(spark):
    bank = standins.bank(spark, SF)
    trained, table = credit.train(bank, standins.FREQUENCY, standins.STATUSES, rounds=1)
    assert set(trained) == set(credit.classifiers()) == {r["model"] for r in table.collect()}
    results = trained["tree"].results
    assert results.where("prediction IS NULL").count() == 0
    weights = models.importances(trained["tree"].model, results)
    assert {"monto_prestamo", "operation_vec_A", "region_vec_ASIA"} & {r["feature"] for r in weights.collect()}


@pytest.mark.parametrize("path", sorted(p for p in LIBRARY.rglob("*.py") if "llm" not in p.parts), ids=lambda p: p.stem)
def test_library_stays_on_the_cluster(path):
    text = path.read_text()
    for banned in ("toPandas", "crossJoin", "localCheckpoint", ".rdd", "rdd.map", "mapInPandas"):
        assert banned not in text
    assert not re.search(r"repartition\(1\)|coalesce\(1\)", text)
