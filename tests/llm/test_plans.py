"""The native operators hold no Python, and none gathers rows in one task but per-bucket counts."""

import re

import pytest

from quire.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["op2_rendezvous_shards", "op3_exact_dedup", "op10_one_permutation_minhash"])
def test_native(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
