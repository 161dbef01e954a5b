import os
import re

import pytest

from fleetspark.plans import registry

DATA = "/root/testdata/sf0.001"
HOT = "shift_features day_features shift_table asof_strict trailing_24h range_join_cycles position_slice load_state interpolate_limit within_buffer nearest_anchor oof_mean vehicle_history candidate_search ewma_last5 fallback_cascade global_scalars shift_features_wide shift_cycles load_split near_any_anchor assigned_distance oof_stats auc_overall".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", HOT)
def test_no_nested_loop_and_no_python(spark, name):
    found = plan(registry.QUERIES[name](spark, DATA))
    assert not re.search("NestedLoop|Cartesian|Python|Pandas|MapInArrow", found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_scans_are_pruned(spark):
    found = plan(registry.QUERIES["dedup_last"](spark, DATA))
    assert "o_orderpriority" not in found
    found = plan(registry.QUERIES["semi_join"](spark, DATA))
    assert "EqualTo(o_orderpriority,1-URGENT)" in found


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["shift_features", "shift_features_wide", "shift_cycles"])
def test_windows_of_a_shift_share_an_exchange(spark, name):
    found = plan(registry.QUERIES[name](spark, DATA))
    assert len(re.findall(r"Exchange hashpartitioning", found)) == 1
