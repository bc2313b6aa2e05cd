"""Rule packs as rows and template differences."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import packs
from quire.plans import packs as plans

NAMES = "rule string, scope string, label string, attribute string, comparison string, value string, severity string"


def pack(spark, *rules):
    return spark.createDataFrame(list(rules), NAMES)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, 0, "heading", "Intro", 16.0, True), (1, 1, "body", "  two  ", 12.0, None), (1, 2, None, None, None, False), (2, 0, "body", "Text", 10.5, False)], "doc_id long, idx int, label string, text string, size double, bold boolean")


@pytest.mark.parametrize(
    ("comparison", "attribute", "value", "broken"),
    [
        ("equals", "text", "Text", [(1, 0), (1, 1), (1, 2)]),
        ("equals?", "text", "Text", [(1, 0), (1, 1)]),
        ("equals", "bold", "true", [(1, 1), (1, 2), (2, 0)]),
        ("differs", "text", "Text", [(1, 2), (2, 0)]),
        ("at_least", "size", "12", [(1, 2), (2, 0)]),
        ("at_most?", "size", "12", [(1, 0)]),
        ("near", "size", "12±1.5", [(1, 0), (1, 2)]),
        ("one_of?", "text", "Intro| Text", [(1, 1)]),
        ("matches?", "text", "^[A-Z]", [(1, 1)]),
        ("lacks?", "text", "T", [(1, 0), (1, 1), (2, 0)]),
        ("holds", "text", "TWO", [(1, 0), (1, 2), (2, 0)]),
        ("present", "text", None, [(1, 2)]),
    ],
)
def test_comparisons(spark, rows, comparison, attribute, value, broken):
    found = packs.check(pack(spark, ("r", "p", "*", attribute, comparison, value, "warning")), {"p": rows}, ["doc_id", "idx"])
    assert sorted((r["doc_id"], r["idx"]) for r in found.collect()) == broken
    assert {(r["scope"], r["rule"], r["severity"], r["expected"]) for r in found.collect()} == {("p", "r", "warning", value)}


def test_labels_and_scopes(spark, rows):
    rules = pack(spark, ("a", "p", "body", "size", "at_least", "99", "x"), ("b", "p", "heading", "size", "at_least", "99", "x"), ("c", "p", "nothing", "size", "at_least", "99", "x"), ("d", "q", "*", "n", "equals", "1", "x"))
    other = spark.createDataFrame([(7, 0, None, 1), (8, 0, None, 2)], "doc_id long, idx int, label string, n int")
    found = packs.check(rules, {"p": rows, "q": other}, ["doc_id", "idx"])
    assert sorted((r["rule"], r["doc_id"], r["actual"]) for r in found.collect()) == [("a", 1, "12.0"), ("a", 2, "10.5"), ("b", 1, "16.0"), ("d", 8, "2")]
    assert packs.check(rules.limit(0), {"p": rows}, ["doc_id"]).count() == 0
    assert packs.check(rules.filter("scope = 'p'"), {"p": rows.limit(0)}, ["doc_id"]).count() == 0


def test_faults_name_every_rule_that_cannot_be_compiled(spark, rows):
    wrong = pack(spark, ("a", "none", "*", "text", "equals", "x", "e"), ("b", "p", "*", "colour", "equals", "x", "e"), ("c", "p", "*", "text", "is", "x", "e"), ("d", "p", "*", "size", "at_least", "big", "e"), ("f", "p", "*", "size", "near", "1", "e"), ("g", "p", "*", "text", "equals", None, "e"))
    with pytest.raises(ValueError) as e:
        packs.check(wrong, {"p": rows}, ["doc_id"])
    assert [x[0] for x in str(e.value).split("; ")] == ["a", "b", "c", "d", "f", "g"]
    with pytest.raises(ValueError, match="more than 2 rules"):
        packs.read_rules(wrong, 2)


@pytest.mark.parametrize("n", [1, 80])
def test_one_scan_for_any_number_of_rules(spark, sf_dir, n):
    lines = plans.labelled(spark, sf_dir)
    rules = [packs.Rule(f"r{i}", "p", ("body", "heading", "*")[i % 3], "chars", "at_least", str(i), "warning") for i in range(n)]
    plan = packs.violations(rules, lines, ["doc_id", "idx"], "label")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan|Scan parquet", plan)) == 1 and "Exchange" not in plan and "Join" not in plan


def test_styles_are_inherited_and_overridden(spark):
    styles = spark.createDataFrame([("base", None, "Sim", 12, None), ("mid", "base", "", None, True), ("leaf", "mid", None, 14, None), ("loop", "loop", "L", None, None)], "style_id string, based_on string, font string, size int, bold boolean")
    rows = spark.createDataFrame([(1, "leaf", None), (2, "mid", "Own"), (3, "gone", None), (4, None, "Own"), (5, "loop", None)], "k int, style_id string, own_font string")
    found = {r["k"]: (r["font"], r["size"], r["bold"]) for r in packs.styled(rows, styles, ["font", "size"], ["bold"]).collect()}
    assert found == {1: ("Sim", 14, True), 2: ("Own", 12, True), 3: (None, None, None), 4: ("Own", None, None), 5: ("L", None, False)}


def test_classified_diff(spark):
    template = spark.createDataFrame([("h", "A", 16), ("h", "B", 16), ("h", "A", None), ("b", None, 12), ("b", None, 10)], "label string, font string, size int")
    formats = packs.template_formats(template, "label", ["font", "size"])
    assert {tuple(r) for r in formats.collect()} == {("h", "A", 16), ("b", None, 10)}
    rows = spark.createDataFrame([(1, "h", "A", 16), (1, "h", None, 16), (1, "b", "X", 12), (1, "z", "A", 1), (2, None, "A", 1), (3, "b", "anything", 10)], "doc_id int, label string, font string, size int")
    found = {r["doc_id"]: tuple(r)[1:] for r in packs.classified_diff(rows, formats, ["doc_id"], "label", ["font", "size"]).collect()}
    assert found == {1: (4, 1, 2, 1, 1, 0.6), 2: (1, 1, 0, 0, 0, None), 3: (1, 0, 0, 0, 0, 1.0)}
    assert packs.classified_diff(rows.limit(0), formats, ["doc_id"], "label", ["font", "size"]).count() == 0
    assert packs.classified_diff(rows, formats.limit(0), ["doc_id"], "label", ["font"]).filter(F.col("unknown") < F.col("paragraphs")).count() == 0
