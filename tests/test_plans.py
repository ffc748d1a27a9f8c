"""Plans stay what they should be: few shuffles, narrow scans, no Python where expressions do."""

import re

import pytest

from ponderloom.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "exchanges"), [("graph_metrics", 1), ("feature_matrix19", 1), ("motif_counts", 1), ("ngs_validate", 1), ("prune_summary", 1), ("prune_apply_nodes", 1), ("rbe_nodes", 1), ("step_features", 1), ("sentence_split", 0), ("len_nodes", 1), ("metric_summary", 2), ("fingerprint_features", 1)])
def test_shuffles(spark, sf, name, exchanges):
    p = plan(catalogue.QUERIES[name](spark, sf))
    assert len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", p)) <= exchanges, p
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", p)


@pytest.mark.parametrize(("name", "columns"), [("graph_metrics", {"user_id", "ts", "event_id", "event_type", "value"}), ("len_type_mix_by_lang", {"text", "lang"}), ("rbe_types", {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"})])
def test_scans_are_narrow(spark, sf, name, columns):
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)", plan(catalogue.QUERIES[name](spark, sf))))))
    assert read == columns


@pytest.mark.parametrize("name", ["jsd_pairs", "tsi_pairs", "ged_pairs", "wl_similarity", "seq_levenshtein"])
def test_pairs_are_equi_joins(spark, sf, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(catalogue.QUERIES[name](spark, sf)))
