"""Operators on small frames with known results."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, formats, hierarchy, issues, packages, paragraphs, relational
from quire.plans import registry
from quire.sources import markup, sinks, tables
from quire.streaming import stateful


def test_lookup_needs_a_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert tables.lookup(df, "id", 2).first()["v"] == "b"
    with pytest.raises(LookupError):
        tables.lookup(df, "id", 9)


@pytest.mark.parametrize("number,size,first,count", [(1, 20, 0, 20), (0, 20, 0, 20), (2, 500, 10, 10), (3, None, 20, 10)])
def test_page_clamps(spark, number, size, first, count):
    found = [r["id"] for r in relational.page(spark.range(100), [F.asc("id")], number, size).collect()]
    assert found == list(range(first, first + count))


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "owner int, dep int")
    count = lambda *a, **b: relational.data_scope(df, *a, "owner", "dep", **b).count()
    assert count("all", F.lit(1)) == 2
    assert count("self", F.lit(1)) == 1
    assert count("department", F.lit(1)) == 0
    assert count("department", F.lit(1), department_id=F.lit(6)) == 1
    assert count("odd", F.lit(1)) == 0


def test_ratio_of_nothing(spark):
    row = spark.range(1).select(relational.ratio(F.lit(0), F.lit(0)).alias("a"), relational.ratio(F.lit(0), F.lit(0), default=0.0).alias("b")).first()
    assert row["a"] is None and row["b"] == 0.0


def test_mode_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", ""), ("k", None)], "k string, v string")
    assert relational.mode_of(df, ["k"], "v", "m").first()["m"] == "a"


def test_latest_per_key_of_empty(spark):
    df = spark.createDataFrame([], "k int, t int, v string")
    assert relational.latest_per_key(df, "k", [F.col("t")], ["v"]).count() == 0


def test_first_page(spark):
    pages = spark.createDataFrame([(1, 1, "cover"), (1, 2, "the abs tract"), (1, 3, "abstract")], "doc_id int, page int, text string")
    needles = spark.createDataFrame([(1, "abstract"), (1, "none")], "doc_id int, landmark string")
    assert {tuple(r) for r in issues.pages_with(pages, needles, "page").collect()} == {(1, "abstract", 2), (1, "none", 0)}


def test_chinese_rules(spark):
    rows = [
        (1, 0, "重庆大学毕业论文", 22.0, True, "center"),
        (1, 1, "摘 要", 16.0, True, "center"),
        (1, 2, "关键词：模型；数据", 12.0, False, "left"),
        (1, 3, "目 录", 16.0, True, "center"),
        (1, 4, "1.1 背景\t3", 12.0, False, "left"),
        (1, 5, "第一章 绪论", 16.0, True, "center"),
        (1, 6, "第二章 标题", 12.0, False, "left"),
        (1, 7, "基于图的系统设计", 16.0, False, "center"),
        (1, 8, "参考文献", 16.0, True, "center"),
        (1, 9, "[1] Author A. A long title of some work. 2021.", 10.5, False, "left"),
        (1, 10, "", 12.0, False, "left"),
        (1, 11, "原创性声明", 16.0, True, "center"),
        (1, 12, "本科生学院毕业", 12.0, False, "left"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, idx int, text string, font_size_pt double, is_bold boolean, alignment string")
    found = paragraphs.with_rule_label(paragraphs.with_features(df)).orderBy("idx")
    assert [(r["label"], r["confidence"]) for r in found.collect()] == [
        ("cover", 0.95), ("abstract_title", 0.97), ("keywords", 0.96), ("table_of_contents_title", 0.96), ("table_of_contents", 0.95), ("heading_1", 1.0), ("body", 0.48),
        ("title", 0.8), ("references_title", 0.95), ("references", 0.92), ("body", 0.5), ("originality_declaration", 0.96), ("cover", 0.92),
    ]
    assert len(paragraphs.with_features(df).select(paragraphs.vector().alias("v")).first()["v"]) == 16


def test_smoothing_reads_original_labels(spark):
    rows = [(1, i, l, c, 12.0, False, "left") for i, (l, c) in enumerate([("a", 0.95), ("b", 0.5), ("a", 0.8), ("b", 0.5), ("a", 0.9)])]
    df = spark.createDataFrame(rows, "doc_id int, idx int, label string, confidence double, font_size_pt double, is_bold boolean, alignment string")
    found = paragraphs.smoothed(df, ["doc_id"], "idx").orderBy("idx").collect()
    assert [(r["label"], r["confidence"]) for r in found] == [("a", 0.95), ("a", 0.8), ("b", 0.5), ("a", 0.8), ("a", 0.9)]


def test_status(spark):
    found = spark.createDataFrame([(1, "k", "fatal", "a"), (1, "k", "fatal", "b"), (2, "m", "repairable", "c"), (3, "n", "warning", "d")], "doc_id int, kind string, severity string, target string")
    docs = spark.createDataFrame([(i,) for i in range(1, 5)], "doc_id int")
    assert dict(map(tuple, issues.status(found, docs, ["doc_id"]).collect())) == {1: "rejected", 2: "review_required", 3: "compliant", 4: "compliant"}
    assert issues.once_per_kind(found, ["doc_id"]).count() == 3


def test_closure_ends_cycles_and_long_chains(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id int, parent int")
    assert hierarchy.closure(chain, "id", "parent").filter("node = 39").agg(F.max("depth")).first()[0] == 39
    loop = spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int")
    assert hierarchy.closure(loop, "id", "parent").count() == 4


def test_scores(spark):
    row = spark.range(1).select(formats.grade(F.lit(89.9)).alias("g"), formats.percentile_band(F.lit(90)).alias("p"), formats.issue_score(F.lit(250)).alias("i")).first()
    assert tuple(row) == ("B", 85, 0)


def test_html_blocks():
    page = "<html><style>x{}</style><h2>Ti&amp;tle</h2><p>One <b>two</b></p><ul><li>a</li></ul><ol><li>b</li></ol><table><tr><td>1</td><td>2</td></tr><tr><td></td></tr></table><div>end</div><script>no</script></html>"
    assert markup.parse_html(page) == [("heading", 2, "Ti&tle"), ("paragraph", 0, "One two"), ("item", 0, "• a"), ("item", 0, "b"), ("row", 0, "1|2"), ("paragraph", 0, "end")]
    assert markup.parse_html(None) == []


def _package(body: str, **more: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in {"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>", **more}.items():
            z.writestr(name, content)
    return out.getvalue()


def test_docx_rows(spark):
    body = "<w:p><w:r><w:t>A &amp; B</w:t><w:tab/><w:t>c</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>kept</w:t></w:r></w:ins></w:p>"
    df = spark.createDataFrame([(1, _package(body)), (2, b"no"), (3, None)], "id long, content binary")
    assert [tuple(r) for r in markup.docx_paragraphs(df, "id", "content").orderBy("id", "idx").collect()] == [(1, 0, "p", "A & B\tc"), (1, 1, "tbl", "cell"), (1, 2, "p", "kept")]
    assert markup.docx_part_rows(df, "id", "content").count() == 2


@pytest.mark.parametrize("name,why", [("../x.xml", "path"), ("word/vbaProject.bin", "active content")])
def test_unsafe_packages(name, why):
    assert markup.unsafe(_package("", **{name: "x"})) == why
    assert markup.unsafe(_package("", **{"word/a.xml": "<!DOCTYPE x>"})) == "entity"
    assert markup.unsafe(_package("")) == ""


def test_token_bucket_stream_agrees_with_fold(spark, tmp_path):
    rows = [(u, i, f"2020-01-01 00:00:{s:02d}") for i, (u, s) in enumerate([(1, 0), (1, 1), (1, 2), (1, 30), (2, 0), (2, 0), (2, 59)])]
    df = spark.createDataFrame(rows, "u long, e long, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "ev"))
    stream = stateful.event_stream(spark, str(tmp_path / "ev"), df.schema, files=100)
    live = stateful.drained(stateful.token_bucket(stream, "u", "t", "e", 0.1, 2.0), "bucket_test")
    still = stateful.token_bucket_batch(df, "u", "t", "e", 0.1, 2.0)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, still.collect()))


def test_deep_hierarchies_are_whole(spark):
    chain = spark.range(101).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.col("id").cast("string").alias("name"))
    assert hierarchy.closure(chain, "id", "parent").filter("node = 100").agg(F.max("depth"), F.count("*")).first()[:] == (100, 101)
    row = hierarchy.paths(chain, "id", "parent", "name").filter("id = 100").first()
    assert row["depth"] == 100 and row["path"] == "/".join(map(str, range(101)))


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """A folder whose events table has many files that each span the whole period, a third of the rows of one user."""
    there = tmp_path_factory.mktemp("shuffled")
    ids = spark.range(3000)
    user = F.when(F.col("id") % 3 == 0, 7).otherwise(100 + F.xxhash64("id") % 40)
    at = F.timestamp_micros(F.lit(1_577_836_800_000_000) + F.col("id") * 1_700_000_000)
    events = ids.select(F.col("id").alias("event_id"), at.alias("ts"), user.cast("long").alias("user_id"), F.when(F.col("id") % 5 < 2, "signup").otherwise("view").alias("event_type"))
    events.repartition(8, F.xxhash64("event_id")).write.parquet(str(there / "events.parquet"))
    return there


def test_expiry_of_overlapping_files(spark, shuffled):
    events = spark.read.parquet(str(shuffled / "events.parquet"))
    live = registry.QUERIES["order_expiry_stream"](spark, str(shuffled))
    seen = events.agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("m")).first()["m"] - datetime.timedelta(hours=1)
    windows = events.filter("event_type = 'signup'").groupBy(F.window("ts", "30 minutes").alias("w")).count().filter(F.col("w.end") <= F.lit(seen)).select("w.start", "count")
    assert windows.count() > 1000 and sorted(map(tuple, live.collect())) == sorted(map(tuple, windows.collect()))


def _allowed(rows, rate, cap):
    """A plain loop over (user, time, event)."""
    state, out = {}, []
    for u, at, e in sorted(rows):
        tokens, last = state.get(u, (min(rate, cap), at))
        tokens = min(cap, tokens + (at - last) * rate)
        out.append((u, e, tokens >= 1))
        state[u] = (tokens - (tokens >= 1), at)
    return sorted(out)


def test_token_bucket_of_overlapping_files(spark, shuffled):
    rows = [(r["user_id"], r["at"] / 1e6, r["event_id"]) for r in spark.read.parquet(str(shuffled / "events.parquet")).select("user_id", F.unix_micros("ts").alias("at"), "event_id").collect()]
    expected = _allowed(rows, 1 / 86_400, 2)
    assert 0 < sum(x[2] for x in expected) < len(expected)
    for name in ("token_bucket_fold", "token_bucket_stream"):
        assert sorted(map(tuple, registry.QUERIES[name](spark, str(shuffled)).collect())) == expected, name


def test_token_bucket_in_bounded_runs(spark, shuffled):
    events = spark.read.parquet(str(shuffled / "events.parquet"))
    keyed = stateful._keyed(events, "user_id", "ts", "event_id")
    expected = _allowed([tuple(r) for r in keyed.collect()], 1 / 86_400, 2)
    first, state = stateful.fold(keyed.filter("event < 1700"), 1 / 86_400, 2, run=150)
    second, _ = stateful.fold(keyed.filter("event >= 1700"), 1 / 86_400, 2, state, run=150)
    assert sorted(map(tuple, first.union(second).collect())) == expected
    assert spark.read.parquet(*{f.rsplit("/", 1)[0] for f in first.inputFiles()}).agg(F.max(F.size("e"))).first()[0] <= 150


def _verify(df):
    return df.filter("bad > 0").select(F.lit("k").alias("kind"), F.when(F.col("bad") > 5, "fatal").otherwise("repairable").alias("severity"), F.col("id").cast("string").alias("target"))


@pytest.mark.parametrize("bad,step,verdict,left", [(0, 1, "verified_pass", 0), (2, 1, "verified_pass", 0), (9, 1, "manual_review", 9), (5, 0, "manual_review", 5)])
def test_repair_loop(spark, bad, step, verdict, left):
    df = spark.createDataFrame([(1, bad), (2, 0)], "id int, bad int")
    fixed, said = blocks.repair(df, lambda d: _verify(d), lambda d, issues: d.withColumn("bad", F.greatest(F.col("bad") - 2 * step, F.lit(0))))
    assert said == verdict and fixed.agg(F.sum("bad")).first()[0] == left


def test_repair_without_patch(spark):
    df = spark.createDataFrame([(1, 1)], "id int, bad int")
    assert blocks.repair(df, _verify, None)[1] == "manual_review"


def test_nearest_looks_both_ways(spark):
    rows = [(1, 0, "goal"), (1, 1, ""), (1, 2, "start"), (1, 3, "x"), (1, 4, "goal")]
    df = spark.createDataFrame(rows, "d int, i int, t string")
    find = lambda most, back: blocks.nearest(df, ["d"], "i", F.col("t") == "start", F.col("t") == "goal", F.col("t") != "", most, back=back).first()["nearest"]
    assert (find(8, False), find(1, False), find(8, True), find(1, True)) == (4, None, 0, 0)


def test_whole_text_files(spark, tmp_path):
    for name, text in (("a", "one\ntwo\n"), ("b", ""), ("c", "größe")):
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    found = markup.text_files(spark, str(tmp_path)).collect()
    assert {r["path"][-5:]: r["text"] for r in found} in ({"a.txt": "one\ntwo\n", "b.txt": "", "c.txt": "größe"}, {"a.txt": "one\ntwo\n", "c.txt": "größe"})


def test_package_without_document(spark):
    parts = spark.createDataFrame([(1, "word/styles.xml", None), (2, "word/document.xml", "x" * 30)], "doc_id int, part_name string, content string")
    found = {tuple(r) for r in packages.verify(parts).collect()}
    assert (1, "missing_document_xml", "fatal", "word/document.xml") in found and not any(k == 2 for k, *_ in found)
    assert {tuple(r) for r in packages.verdicts(parts).collect()} == {(1, "rejected"), (2, "compliant")}


@pytest.mark.parametrize(
    "content,nested,bookmark",
    [
        ("<w:r><w:r/></w:r>", True, False),
        ('<w:r w:rsidR="1"><w:r w:rsidR="2"></w:r></w:r>', True, False),
        ("<w:r><w:pict><w:txbxContent><w:p><w:r><w:t>x</w:t></w:r></w:p></w:txbxContent></w:pict></w:r>", False, False),
        ("<w:r></w:r><w:r></w:r>", False, False),
        ("<w:r/><w:r/>", False, False),
        ("<w:r><w:rPr><w:bookmarkStart w:id='1'/></w:rPr></w:r>", False, True),
        ("<w:pPr><w:rPr><w:bookmarkStart w:id='1'/></w:rPr></w:pPr>", False, False),
        ("<w:r><w:rPr/><w:bookmarkStart w:id='1'/></w:r>", False, False),
        ("</w:r></w:r><w:r><w:rFonts/></w:r>", False, False),
        ("", False, False),
    ],
)
def test_nesting(spark, content, nested, bookmark):
    row = spark.createDataFrame([(content,)], "c string").select(packages.nesting(F.col("c")).alias("n")).first()["n"]
    assert (row["nested"], row["bookmark"]) == (nested, bookmark)


def test_job_results_of_unknown_jobs(spark):
    log = spark.createDataFrame([(1, 1, "queued"), (2, 1, "queued")], "job int, at int, status string")
    updates = spark.createDataFrame([(1, 2, "done"), (9, 2, "done")], "job int, at int, status string")
    found, faults = sinks.job_results(log, updates, "job", ["at"])
    assert {tuple(r) for r in found.collect()} == {(1, 2, "done"), (2, 1, "queued")} and [r["job"] for r in faults.collect()] == [9]


def test_bulk_update_tells_how_many(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, s string")
    found, n = sinks.update_by_ids(table, "id", spark.createDataFrame([(1,), (1,), (7,)], "id int"), {"s": F.lit("x")})
    assert {tuple(r) for r in found.collect()} == {(1, "x"), (2, "b"), (3, "c")} and n.first()["n"] == 1


@pytest.mark.parametrize("parts", [None, 3])
def test_sides_of_references(spark, parts):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, id string")
    used, defined = frame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "n"), (3, None)]), frame([(1, "a"), (2, "b"), (2, "b"), (None, "n")])
    found = sorted((str(r["doc_id"]), str(r["id"]), r["used"], r["defined"]) for r in issues.sides(used, defined, ["doc_id", "id"], parts).collect())
    assert found == [("1", "a", True, True), ("1", "b", True, False), ("2", "b", False, True), ("2", "c", True, False), ("3", "None", True, False), ("None", "n", False, True), ("None", "n", True, False)]
    assert {r["target"] for r in issues.dangling(used, defined, ["doc_id", "id"], "k", "id").collect()} == {"b", "c", "n", None}
    assert sorted(str(r["target"]) for r in issues.unpaired(used, defined, ["doc_id", "id"], "k", "id").collect()) == ["None", "b", "b", "c", "n", "n"]


def test_lines_are_counted_where_they_are_cut(spark):
    docs = spark.createDataFrame([(1, " a \n　b \n\n" + "c d" * 9), (2, None), (3, " \n"), (4, "x\n\ty")], "doc_id long, text string").repartition(2)
    plain = {"font_size_pt": F.lit(12.0), "is_bold": F.lit(False), "alignment": F.lit("left")}
    told = paragraphs.with_features(paragraphs.paragraphs(docs, total="lines").withColumns(plain), "lines")
    assert "hashpartitioning" not in told._jdf.queryExecution().executedPlan().toString()
    counted = paragraphs.with_features(paragraphs.paragraphs(docs).withColumns(plain))
    assert sorted(map(str, told.drop("lines").collect())) == sorted(map(str, counted.collect()))
    assert {(r["doc_id"], r["idx"], r["text"]) for r in told.collect()} == {(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (1, 3, "c d" * 9), (2, 0, ""), (3, 0, ""), (3, 1, ""), (4, 0, "x"), (4, 1, "y")}
