"""Queries over blocks, rule maps, memberships and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import maps
from quire.operators import blocks, paragraphs
from quire.operators.hierarchy import closure
from quire.plans.documents import LINES, ROLES
from quire.plans.registry import query
from quire.sources.tables import rows, sql, table

SLOTS = "SELECT concat('s', CAST(i AS STRING)) AS slot_id, concat(CASE i % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'body' WHEN 2 THEN 'table' ELSE 'figure' END, CAST(CAST(floor(i / 40) AS BIGINT) AS STRING)) AS kind, CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN 'k1,k2' ELSE concat('k', CAST(i AS STRING)) END AS accepts, i % 5 = 0 AS repeatable FROM (SELECT p_partkey FROM part) AS t(i)"
PAYLOADS = "SELECT concat('p', CAST(i AS STRING)) AS payload_id, concat(CASE i % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'body' WHEN 2 THEN 'table' ELSE 'other' END, CAST(CAST(floor(i / 40) AS BIGINT) AS STRING)) AS kind, concat('k', CAST(i % 6 AS STRING)) AS key FROM (SELECT p_partkey FROM part WHERE p_size > 12) AS t(i)"


@query(f"""
WITH m AS (SELECT slot_id, repeatable, payload_id, count(payload_id) OVER (PARTITION BY slot_id) AS n FROM ({SLOTS}) s LEFT JOIN ({PAYLOADS}) p ON p.kind = s.kind AND (accepts = '' OR list_contains(string_split(accepts, ','), p.key)))
SELECT slot_id, payload_id, CASE WHEN payload_id IS NULL THEN 'unmapped' WHEN NOT repeatable AND n > 1 THEN 'ambiguous' ELSE 'bound' END AS state FROM m
""")
def slot_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = sql(spark, sf_dir, SLOTS).withColumn("accepts", F.filter(F.split("accepts", ","), lambda x: x != ""))
    return blocks.bindings(slots, sql(spark, sf_dir, PAYLOADS))


@query("""
WITH r AS (SELECT o_custkey AS c, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT o_custkey, o_orderdate, 'filled' AS name FROM orders JOIN r ON c = o_custkey AND o_orderdate BETWEEN a AND b
""")
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    ranges = orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("stop")).withColumn("name", F.lit("filled"))
    return blocks.within(orders, ranges, "o_custkey", "o_orderdate")


@query(f"""
WITH l AS (SELECT *, sum(CAST(text <> '' AS INT)) OVER (PARTITION BY doc_id ORDER BY idx) AS steps FROM ({LINES})),
g AS (SELECT doc_id, idx AS gi, steps AS gs FROM l WHERE text LIKE '%of%'),
n AS (SELECT l.doc_id, l.idx, l.steps, min(gi) AS gi, arg_min(gs, gi) AS gs FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND gi > idx WHERE text LIKE '%the%' GROUP BY ALL)
SELECT doc_id, idx, CASE WHEN gs - steps <= 8 THEN gi ELSE -1 END AS nearest FROM n
""")
def nearest_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = paragraphs.paragraphs(table(spark, sf_dir, "documents"))
    return blocks.nearest(lines, ["doc_id"], "idx", F.col("text").like("%the%"), F.col("text").like("%of%"), F.col("text") != "").fillna(-1, ["nearest"])


@query("""
WITH r AS (SELECT l_suppkey AS target, l_orderkey * 10 + l_linenumber AS seq, l_linenumber % 4 AS priority, l_discount AS confidence, CASE WHEN l_quantity > 30 THEN l_linestatus || CAST(l_linenumber AS VARCHAR) END AS font, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS align FROM lineitem)
SELECT target, arg_min(seq, (-priority, -confidence, seq)) AS winner, arg_min(font, (-priority, -confidence, seq)) FILTER (font IS NOT NULL) AS font, arg_min(align, (-priority, -confidence, seq)) FILTER (align IS NOT NULL) AS align FROM (SELECT DISTINCT ON (target, seq) * FROM r ORDER BY target, seq, priority, confidence, font NULLS FIRST, align NULLS FIRST) GROUP BY target
""")
def conflict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rules = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("target"), (F.col("l_orderkey") * 10 + n).alias("seq"), (n % 4).alias("priority"), F.col("l_discount").alias("confidence"),
        F.when(F.col("l_quantity") > 30, F.concat("l_linestatus", n.cast("string"))).alias("font"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("align"),
    )
    first = F.min(F.struct("priority", "confidence", F.col("font").isNotNull().alias("has_font"), "font", F.col("align").isNotNull().alias("has_align"), "align")).alias("r")
    once = rules.groupBy("target", "seq").agg(first).select("target", "seq", "r.priority", "r.confidence", "r.font", "r.align")
    return blocks.strongest(once, "target", ["font", "align"])


@query(rf"""
SELECT doc_id, rule, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, sum(len(regexp_extract_all(text, '  +'))) AS double_space, sum(len(regexp_extract_all(text, '\d+'))) AS number FROM ({LINES}) GROUP BY doc_id)
UNPIVOT (n FOR rule IN (double_space, number)) WHERE n > 0
""")
def text_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = paragraphs.paragraphs(table(spark, sf_dir, "documents"))
    return blocks.rule_counts(lines, ["doc_id"], "text", {"double_space": "  +", "number": r"\d+"})


WRITTEN = "SELECT d.i AS doc_id, k.i AS idx, concat('part ', CAST(k.i * (1 + d.i % 3) AS STRING), '  of ', CAST(d.i % 4 AS STRING)) AS text FROM (SELECT doc_id FROM documents) AS d(i) CROSS JOIN range(16) AS k(i)"
KEPT = f"SELECT doc_id, idx, CASE WHEN idx % 2 = 0 THEN replace(text, ' ', '') ELSE text END AS text FROM ({WRITTEN}) AS w WHERE (doc_id + idx) % 4 > 0 AND doc_id % 9 > 0"


@query(f"""
WITH w AS (SELECT doc_id, string_agg(replace(text, ' ', ''), '' ORDER BY idx) AS whole FROM ({KEPT}) GROUP BY doc_id),
m AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY idx) AS rn FROM ({WRITTEN}) s LEFT JOIN w ON w.doc_id = s.doc_id WHERE NOT contains(coalesce(whole, ''), replace(text, ' ', '')))
SELECT doc_id, idx, text FROM m WHERE rn <= 10
""")
def missing_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of ten missing texts a document, as many as are shown."""
    return blocks.uncontained(sql(spark, sf_dir, WRITTEN), sql(spark, sf_dir, KEPT), "doc_id", "text")


MEMBERS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN DATE '2023-12-20' + CAST(c_custkey % 60 AS INT) END AS ends, CAST(c_custkey % 400 AS INT) AS days, c_custkey % 2 = 0 AS active, c_nationkey AS most, CAST(c_custkey % 20 AS INT) AS used, CAST(c_custkey % 7 AS INT) AS free FROM customer"


@query(f"""
SELECT id, CAST(CAST(CASE WHEN ends > DATE '2024-01-15' THEN ends ELSE DATE '2024-01-15' END + days AS DATE) AS VARCHAR) AS new_end, CASE WHEN active THEN greatest(most - used, 0) ELSE free END AS remaining
FROM ({MEMBERS}) t
""")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.to_date(F.lit("2024-01-15"))
    found = sql(spark, sf_dir, MEMBERS)
    return found.select("id", blocks.membership_end(F.col("ends"), now, F.col("days")).cast("string").alias("new_end"), blocks.remaining_checks(F.col("active"), F.col("most"), F.col("used"), F.col("free")).alias("remaining"))


POLICIES = "(1, '/api/items/:id', 'GET'), (2, '/api/admin/*', '*'), (4, '/api/items', 'POST')"
ASKED = """
SELECT u.i * 20 + p.i * 4 + a.i AS request, concat('user', CAST(u.i AS STRING)) AS user, CASE p.i WHEN 0 THEN '/api/items/7' WHEN 1 THEN '/api/admin/a/b' WHEN 2 THEN '/api/items' WHEN 3 THEN '/api/items/7/x' ELSE '/api/admin' END AS path, CASE a.i WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'DELETE' ELSE 'PUT' END AS action
FROM (SELECT c_custkey FROM customer) AS u(i) CROSS JOIN range(5) AS p(i) CROSS JOIN range(4) AS a(i)
"""
HELD = "SELECT concat('user', CAST(i AS STRING)) AS user, 1 + i % 7 AS node FROM (SELECT c_custkey FROM customer WHERE c_custkey % 8 > 0) AS t(i)"


@query(rf"""
WITH RECURSIVE h AS (SELECT t.user, t.node AS role FROM ({HELD.replace(' AS user', ' AS "user"')}) t UNION SELECT h.user, parent FROM h JOIN (VALUES {ROLES}) r(id, parent, code) ON r.id = h.role WHERE parent IS NOT NULL),
p AS (SELECT role, '^' || replace(regexp_replace(path, ':[^/]+', '[^/]+', 'g'), '*', '.*') || '$' AS path, action FROM (VALUES {POLICIES}) x(role, path, action))
SELECT request, EXISTS (SELECT 1 FROM h JOIN p USING (role) WHERE h.user = a.user AND (p.action = '*' OR p.action = a.action) AND regexp_matches(a.path, p.path)) AS allowed FROM ({ASKED.replace(' AS user', ' AS "user"')}) a
""")
def policy_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user holds a role and those that it inherits."""
    inherits = closure(rows(spark, ROLES, "id, parent, code"), "id", "parent")
    held = sql(spark, sf_dir, HELD).join(inherits, "node").select("user", F.col("ancestor").alias("role"))
    policies = rows(spark, POLICIES, "role, path, action").withColumn("path", blocks.path_pattern(F.col("path")))
    return blocks.allowed(sql(spark, sf_dir, ASKED), policies, held)


NESTED = """
SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat('{"a":{"b":"', c_mktsegment, '","c":', CAST(c_nationkey AS STRING), '},"d":"y"}') WHEN 1 THEN 'no' ELSE concat('{"a":null,"e":[', CAST(c_custkey AS STRING), ']}') END AS s FROM customer
"""


@query("""
SELECT c_custkey AS id, k, v FROM (SELECT c_custkey, 'a.b' AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'a.c', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT c_custkey, 'd', 'y' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'e', '[' || c_custkey || ']' FROM customer WHERE c_custkey % 3 = 2)
""")
def map_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, NESTED).select("id", F.explode(maps.flattened(F.col("s"))).alias("k", "v"))


OVERLAID = "SELECT i AS id, CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN 'Kai' END AS font, CASE WHEN i % 2 = 0 THEN '20' ELSE '' END AS line FROM (SELECT p_partkey FROM part) AS t(i)"


@query(f"""
SELECT id, k, v FROM (SELECT id, 'font' AS k, coalesce(nullif(font, ''), 'Sim') AS v FROM ({OVERLAID}) UNION ALL SELECT id, 'size', '12' FROM ({OVERLAID}) UNION ALL SELECT id, 'line', nullif(line, '') FROM ({OVERLAID})) WHERE v IS NOT NULL
""")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = sql(spark, sf_dir, OVERLAID).select("id", F.expr("map('font', 'Sim', 'size', '12')").alias("base"), F.create_map(F.lit("font"), F.col("font"), F.lit("size"), F.lit(""), F.lit("line"), F.col("line")).alias("over"))
    return two.select("id", F.explode(maps.merged(F.col("base"), F.col("over"))).alias("k", "v"))


@query("SELECT p_partkey AS id, 'font,size' AS kept, 0.6667::DOUBLE AS score, CASE WHEN p_partkey % 2 = 0 THEN 'size' ELSE '' END AS bad FROM part")
def map_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.create_map(F.lit("字体"), F.col("p_brand"), F.lit("size"), F.when(F.col("p_partkey") % 2 == 0, "big").otherwise(F.col("p_size").cast("string")), F.lit("odd"), F.lit("1"))
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), maps.renamed(rules, {"字体": "font"}).alias("m"))
    listed = maps.whitelisted(F.col("m"), ["font", "size", "line"])
    return named.select("id", F.array_join(F.array_sort(F.map_keys(listed["kept"])), ",").alias("kept"), F.round(listed["score"], 4).alias("score"), F.array_join(maps.violations(F.col("m"), {"font": ".+", "size": r"\d+"}), ",").alias("bad"))


@query("""
SELECT c_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def eager_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders"))
    return table(spark, sf_dir, "customer").join(nested, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "orders")
