"""What the plans must look like."""

import re

import pytest

from quire.plans import registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,pushed,columns", [("paged_order_list", "EqualTo(o_orderstatus,O)", None), ("department_scope", "EqualTo(c_nationkey,7)", {"c_custkey", "c_nationkey"}), ("cascading_delete", "EqualTo(o_orderstatus,P)", None)])
def test_filters_and_columns_reach_the_scan(spark, sf_dir, name, pushed, columns):
    plan = plan_of(registry.QUERIES[name](spark, sf_dir))
    assert pushed in plan
    if columns:
        assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1))) == columns


def test_latest_row_needs_no_window(spark, sf_dir):
    assert "Window" not in plan_of(registry.QUERIES["latest_item_per_order"](spark, sf_dir))


def test_pages_are_taken_ordered(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(registry.QUERIES["recent_top_k"](spark, sf_dir))


@pytest.mark.parametrize("name", ["zone_machine", "token_bucket_fold", "ordered_subsequence", "fragment_coalescing", "rule_labels", "quality_score", "html_text"])
def test_stays_in_the_engine(spark, sf_dir, name):
    assert not re.search("Python|Pandas|Arrow", plan_of(registry.QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"cross_join_grants"}))
def test_no_cartesian_product(spark, sf_dir, name):
    assert "CartesianProduct" not in plan_of(registry.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["issue_severity_rollup", "issue_dedupe", "issue_fingerprint"])
def test_all_rules_are_one_scan(spark, sf_dir, name):
    assert plan_of(registry.QUERIES[name](spark, sf_dir)).count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["style_inheritance", "role_hierarchy", "menu_tree"])
def test_hierarchies_do_not_grow_plans(spark, sf_dir, name):
    """However deep: earlier rounds are read back, not planned again."""
    plan = plan_of(registry.QUERIES[name](spark, sf_dir))
    assert plan.count("FileScan parquet") <= 2 and plan.count("Join") <= 2


def test_packages_are_at_most_one_shuffle(spark, sf_dir):
    assert plan_of(registry.QUERIES["package_verifier"](spark, sf_dir)).count("Exchange hashpartitioning") <= 1


def test_references_and_definitions_meet_in_one_pass_of_bounded_tasks(spark, sf_dir, monkeypatch):
    from quire.plans import documents

    monkeypatch.setattr(documents, "TOGETHER", 1000)
    plan = plan_of(registry.QUERIES["integrity_checks"](spark, sf_dir))
    rows = sum(n * spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t, n in (("lineitem", 1), ("orders", 3)))
    assert re.findall(r"Exchange hashpartitioning\(doc_id[^)]*, (\d+)\)", plan) == [str(1 + rows // 1000)] and "Join" not in plan.replace("BroadcastNestedLoopJoin", "").replace("CartesianProduct", "")
