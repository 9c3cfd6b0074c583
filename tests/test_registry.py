"""A sample of the registered queries beside their SQL, on the smallest tables.

``python -m checks.compare`` runs all of them.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import check, connect
from checks.oracle import oracle
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "s1_read_fvecs", "s8_synthetic_vectors", "v7_residual_hash", "k1_exact_topk_ip",
    "p4_bucket_split", "p9_route_crowded", "p10_overlap", "p13_build_partition_crowded", "c2_cap_shortlist", "c3_score_shortlist",
    "c8_leaf_knn_capped", "g1_hash_prune", "g2_prune_counters", "q1_beam_search",
    "q3_approx_baseline", "e1_recall_at_k", "e8_recall_matched", "e10_reconcile_runs",
]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) == set(oracle())


@needs_data
def test_entry(spark):
    assert entry(spark).count() == 5000


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    verdict, _, _ = check(spark, connect(SF), name, SF, oracle_sql())
    assert verdict.startswith("equal"), verdict
