"""Payload lookups in source order, back matter, and state machines as data."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import machines, mapping
from quire.operators.machines import ANY, Arc


def test_the_first_block_in_order_is_the_source(spark):
    blocks = spark.createDataFrame([(1, 4, "same", "p", 1), (1, 2, " same\n", "t", 2), (1, 0, "other", "p", 3), (2, 1, "same", "p", 4), (1, 7, "  ", "p", 5), (1, 8, None, "p", 6)], "doc_id long, idx long, text string, kind string, level int")
    bindings = spark.createDataFrame([(1, "a", "same "), (1, "b", "Same"), (2, "c", "other"), (1, "d", "　"), (1, "e", None), (None, "f", "same"), (1, "g", "same")], "doc_id long, name string, payload string")
    found = {r["name"]: (r["source_index"], r["kind"], r["level"]) for r in mapping.first_sources(bindings, blocks).collect()}
    none = (None, None, None)
    assert found == {"a": (2, "t", 2), "b": none, "c": none, "d": none, "e": none, "f": none, "g": (2, "t", 2)}
    assert mapping.first_sources(bindings.limit(0), blocks).count() == 0 and mapping.first_sources(bindings, blocks.limit(0)).filter("kind IS NOT NULL").count() == 0


def test_a_line_that_all_documents_repeat_is_combined_before_it_moves(spark):
    """50,000 equal lines leave the map side as one row a document and task."""
    lines = spark.range(50_000).selectExpr("id % 5 AS doc_id", "id AS idx", "'license line' AS text", "'p' AS kind", "1 AS level").repartition(4)
    plan = mapping.first_sources(lines.select("doc_id", F.col("text").alias("payload")).limit(10), lines)
    assert {r["source_index"] for r in plan.collect()} <= set(range(5))
    assert "partial_min" in plan._jdf.queryExecution().executedPlan().toString()


def test_back_matter_is_split_and_stands_in_for_missing_blocks(spark):
    rows = [(1, 0, " [1] A "), (1, 1, ""), (1, 2, "致 谢 感谢"), (1, 3, "thanks"), (2, 0, "[1] B"), (2, 1, "致谢"), (3, 0, "致谢"), (4, 0, None)]
    matter = mapping.back_matter(spark.createDataFrame(rows, "doc_id long, idx int, text string"))
    assert sorted(map(tuple, matter.collect())) == [(1, "acknowledgement", 2, "感谢"), (1, "acknowledgement", 3, "thanks"), (1, "references", 0, "[1] A"), (2, "references", 0, "[1] B")]
    given = spark.createDataFrame([(1, "x", "references", "p"), (5, "y", "z", "q")], "doc_id long, block_id string, block_kind string, payload string")
    found = mapping.with_fallbacks(given, matter)
    assert sorted(map(tuple, found.collect())) == [(1, "acknowledgement", "back_matter", "感谢\nthanks"), (1, "x", "references", "p"), (2, "references", "back_matter", "[1] B"), (5, "y", "z", "q")]


def walk(events, table, start):
    """The machine, one event after the other."""
    state, out = start, []
    for e in events:
        pick = None
        for s, v in ((state, e), (ANY, e), (state, ANY), (ANY, ANY)):
            pick = pick or next((a for a in table if (a.state, a.event) == (s, v)), None)
        to = (pick.next if pick else None) or state
        emit = (pick.emit if pick else None) or to
        state = to
        out.append((state, emit))
    return out


@pytest.mark.parametrize("table", [machines.THESIS, machines.CONTENTS, (Arc("a", "x", "b", None),), (Arc(ANY, ANY, None, "e"), Arc("b", ANY, "a", None), Arc(ANY, "x", "b", "X"))])
def test_machines(spark, table):
    rng = random.Random(5)
    names = sorted({a.event for a in table} - {ANY}) + ["unheard of", None]
    start = {"before": "before", "a": "a"}.get(table[0].state, "cover")
    docs = {d: [rng.choice(names) for _ in range(rng.randint(1, 40))] for d in range(30)}
    rows = [(d, i, e) for d, es in docs.items() for i, e in enumerate(es)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "d int, i int, e string").repartition(3)
    found = {}
    for r in machines.run(df, ["d"], "i", F.col("e"), table, start).collect():
        found[r["d"], r["i"]] = (r["state"], r["emit"])
    assert found == {(d, i): x for d, es in docs.items() for i, x in enumerate(walk([e if e is not None else ANY for e in es], table, start))}
    assert machines.run(df.limit(0), ["d"], "i", F.col("e"), table, start).count() == 0


def test_zones_with_exits(spark):
    """A declaration ends at a title that ends it; references count in the main part alone."""
    events = ["other", "originality", "other", "references_title", "acknowledgements_title", "abstract_title", "keywords", "other", "references_title", "toc_title", "heading", "blank", "references_title", "other", "appendix_title"]
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(events)], "d int, i int, e string")
    emits = [r["emit"] for r in machines.run(df, ["d"], "i", F.col("e"), machines.THESIS, "cover").orderBy("i").collect()]
    said = "originality_declaration"
    assert emits == ["cover", said, said, said, said, "abstract_title", "keywords", "abstract", "abstract", "toc_title", "heading", "body", "references_title", "references", "appendix_title"]


def test_the_end_of_the_contents(spark):
    rows = [(1, 0, "x"), (1, 1, "t"), (1, 2, "x"), (1, 3, "t"), (1, 4, "m"), (1, 5, "x"), (2, 0, "m"), (2, 1, "t"), (2, 2, "x"), (3, 0, "x")]
    df = spark.createDataFrame(rows, "d int, i int, e string")
    found = machines.contents_range(df, ["d"], "i", F.col("e") == "t", F.col("e") == "m")
    assert {tuple(r) for r in found.collect()} == {(1, 1, 3), (2, 1, 2)}
