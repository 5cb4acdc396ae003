"""Registered queries at the smallest scale: SQL equality where there is SQL, rows otherwise."""

import os

import pytest

import compare
from casebook.suite import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
# Model fits are covered by test_models; here they only take time.
SLOW = {"train_text_classifier", "train_evaluate", "cluster_texts", "classify_new_reports", "svd_embeddings", "predict_topk"}


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    out, _, _, _ = compare.compare(spark, SF, name, QUERIES[name], SQL.get(name), con)
    assert out == []


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
