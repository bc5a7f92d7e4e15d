"""Registered queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare
from starfold.registry.oracles import ORACLES
from starfold.registry.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["links_last_wins", "profile_dedup", "latest_snapshot", "record_parse", "resolve_export",
           "match_ambiguous", "title_search", "dense_index_items", "tfidf_vocab", "features_all",
           "fold_in_k2", "loo_alpha", "recommend_topn", "support_filter", "recommend_tiered",
           "predict_requests", "holdout_metrics", "loo_cascade", "stream_fold_in", "fold_in", "recommend_full",
           "loo_alpha_full", "fold_in_least_squares", "train_hybrid_one_factor", "continued_training", "record_lines",
           "stream_fold_in_batches", "cascade_stored"]


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(REGISTRY)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    assert compare(spark, FOLDER, name).startswith("ok")
