"""Lines from spans, and heading levels from styles."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import layout


def test_spans_become_lines(spark):
    """Order in x, a tolerance in height that hangs neighbours together, ties, and spans without a place."""
    rows = [(1, 1, 30.0, 700.0, "c"), (1, 1, 10.0, 699.6, "a"), (1, 1, 20.0, 699.2, "b"), (1, 1, 5.0, 698.6, "d"), (1, 1, 1.0, 100.0, "z"), (1, 1, 1.0, 100.0, "y"), (1, 1, None, 5.0, "no"), (1, 2, 1.0, 700.0, None), (2, 1, 1.0, 1.0, " x ")]
    found = layout.page_lines(spark.createDataFrame(rows, "doc long, page int, x double, y double, text string").repartition(3), ["doc", "page"])
    assert sorted(tuple(r) for r in found.select("doc", "page", "line", "text").collect()) == [(1, 1, 0, "abc"), (1, 1, 1, "d"), (1, 1, 2, "yz"), (1, 2, 0, ""), (2, 1, 0, " x ")]
    assert {(r["doc"], r["page"]): r["text"] for r in layout.page_texts(found, ["doc", "page"]).collect()} == {(1, 1): "abcdyz", (1, 2): "", (2, 1): "x"}
    assert layout.page_lines(spark.createDataFrame([], "doc long, page int, x double, y double, text string"), ["doc", "page"]).count() == 0


@pytest.mark.parametrize("tolerance", [0.0, 0.5, 3.0])
def test_lines_by_brute_force(spark, tolerance):
    rng = random.Random(4)
    rows = [(d, float(rng.randint(0, 50)), rng.randint(0, 200) / 4, rng.choice("abcdef")) for d in range(6) for _ in range(80)]
    expected = []
    for d in range(6):
        lines, last = [], None
        for _, x, y, t in sorted((r for r in rows if r[0] == d), key=lambda r: -r[2]):
            if last is None or last - y > tolerance:
                lines.append([])
            lines[-1].append((x, t))
            last = y
        expected += [(d, i, "".join(t for _, t in sorted(line))) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc int, x double, y double, text string").repartition(4)
    assert sorted(tuple(r) for r in layout.page_lines(df, ["doc"], tolerance=tolerance).select("doc", "line", "text").collect()) == expected


def test_names_of_headings(spark):
    names = {"Heading 1": 1, "heading_9": 9, " HEADING-3 ": 3, "标题 2": 2, "标题三": 3, "标题九": 9, "heading 0": 0, "heading 10": 0, "标题": 0, "heading": 0, "a heading 1": 0, "": 0, None: 0}
    df = spark.createDataFrame([(k,) for k in names], "name string")
    assert {r["name"]: r["level"] for r in df.select("name", layout.named_level(F.col("name")).alias("level")).collect()} == names


def test_levels_through_styles(spark):
    styles = [("LocalHeading1", None, "标题一", 0), ("Heading2", None, "heading 2", 1), ("Custom", "Heading2", "学校二级标题", None), ("Deep", None, "x", 11), ("OnDeep", "Deep", "y", None), ("a", "b", "", None), ("b", "a", "", None), ("Loop", "Loop", "heading 5", None), ("OnGone", "Heading 7", "z", None), ("标题 4", None, None, None)]
    styles += [(f"c{i}", f"c{i + 1}" if i < 149 else None, "", None if i < 149 else 2) for i in range(150)]
    df = spark.createDataFrame(styles, "style_id string, based_on string, name string, outline int")
    found = {r["style_id"]: r["level"] for r in layout.style_levels(df).collect() if not r["style_id"].startswith("c")}
    assert {k: v for k, v in found.items() if k != "Custom"} == {"LocalHeading1": 1, "Heading2": 2, "Deep": 0, "OnDeep": 0, "a": 0, "b": 0, "Loop": 5, "OnGone": 7, "标题 4": 4} and found["Custom"] == 2
    levels = layout.style_levels(df)
    assert levels.filter("style_id LIKE 'c%' AND level = 3").count() == 150
    rows = spark.createDataFrame([(1, "Custom", None), (2, "Custom", 0), (3, "heading 6", None), (4, None, None), (5, None, 2), (6, "a", 9)], "k int, style_id string, outline int")
    assert {r["k"]: r["level"] for r in layout.heading_levels(rows, levels).collect()} == {1: 2, 2: 1, 3: 6, 4: 0, 5: 3, 6: 0}


def test_a_row_for_each_style_however_long_the_chain(spark, monkeypatch):
    from quire.operators import hierarchy

    kept = []
    monkeypatch.setattr(hierarchy, "stored", lambda df: kept.append(df.localCheckpoint()) or kept[-1])
    styles = [(f"c{i}", f"c{i + 1}" if i < 299 else "c295" if i % 2 else None, "heading 3" if i == 250 else "", None) for i in range(300)]
    found = {r["style_id"]: r["level"] for r in layout.style_levels(spark.createDataFrame(styles, "style_id string, based_on string, name string, outline int")).collect()}
    assert found == {f"c{i}": 3 if i <= 250 else 0 for i in range(300)}
    assert max(df.count() for df in kept) == 300
