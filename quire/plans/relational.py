"""Relational queries: orders stand for records, customers for users, line items for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import relational as R
from quire.plans.registry import query
from quire.sources.tables import dealt, rows, sql, table, with_deleted

NOW = "1998-08-02"
DELETED = "l_returnflag = 'R'"


@query("""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem)
SELECT o_orderkey, c_name, o_orderstatus, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped, round(l_extendedprice, 2) AS price
FROM ranked JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE rn = 1
""")
def latest_item_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = R.latest_per_key(table(spark, sf_dir, "lineitem"), "l_orderkey", [F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_extendedprice")], ["l_linenumber", "l_shipdate", "l_extendedprice"])
    orders = table(spark, sf_dir, "orders").join(latest, F.col("o_orderkey") == F.col("l_orderkey"))
    joined = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "c_name", "o_orderstatus", "l_linenumber", F.to_date("l_shipdate").cast("string").alias("shipped"), F.round("l_extendedprice", 2).alias("price"))


@query("""
SELECT o_orderkey, c_name, round(o_totalprice, 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40
""")
def paged_order_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    found = R.page(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 20)
    return found.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", F.round("o_totalprice", 2).alias("total"))


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus = 'O'")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 20).alias("pages"))


@query("""
SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 5
""")
def recent_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    order = R.sorted_by(parts, {"size": "p_size", "price": "p_retailprice"}, "size", True, "p_partkey", "p_partkey")
    return parts.orderBy(*order).limit(5).select("p_partkey", "p_name", "p_size")


@query("""
SELECT o_orderkey FROM orders o WHERE o_orderpriority ILIKE '%urgent%'
OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment ILIKE '%build%')
""")
def search_exists_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").ilike("%build%")).select(F.col("c_custkey").alias("o_custkey")).withColumn("hit", F.lit(True))
    orders = table(spark, sf_dir, "orders").join(found, "o_custkey", "left")
    return orders.filter(F.col("o_orderpriority").ilike("%urgent%") | F.col("hit")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%1%' OR p_brand LIKE '%2%'")
def like_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").like("%1%") | F.col("p_brand").like("%2%")).select("p_partkey")


@query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS pending,
       count(*) FILTER (o_orderstatus = 'O') AS open, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS revenue,
       round(100.0 * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0), 4) AS completed_pct FROM orders
""")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    done = F.when(status == "F", F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(status == s, 1)).alias(n) for n, s in (("completed", "F"), ("pending", "P"), ("open", "O"))],
        F.round(F.coalesce(F.sum(done), F.lit(0.0)), 2).alias("revenue"),
        F.round(R.ratio(F.count(F.when(status == "F", 1)), F.count(F.lit(1))), 4).alias("completed_pct"),
    )


@query("""
SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS success, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 2) AS amount,
       round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (event_type = 'purchase') / count(*) ELSE 0 END, 4) AS rate FROM events
""")
def payment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(paid, 1)).alias("success"),
        F.round(F.coalesce(F.sum(F.when(paid, F.col("value"))), F.lit(0.0)), 2).alias("amount"),
        F.round(R.ratio(F.count(F.when(paid, 1)), F.count(F.lit(1)), default=0.0), 4).alias("rate"),
    )


@query("""
WITH last AS (SELECT CAST(max(ts) AS DATE) AS d FROM events),
spine AS (SELECT CAST(unnest(generate_series(d - INTERVAL 6 DAY, d, INTERVAL 1 DAY)) AS DATE) AS day FROM last)
SELECT CAST(day AS VARCHAR) AS day, count(event_id) AS n FROM spine LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY day
""")
def daily_growth_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.agg(F.to_date(F.max("ts")).alias("d")).first()["d"]
    return R.zero_filled_days(events, F.to_date("ts"), F.lit(last), 7).withColumn("day", F.col("day").cast("string"))


@query("""
WITH m AS (SELECT date_trunc('month', max(o_orderdate)) AS this FROM orders),
c AS (SELECT count(*) FILTER (o_orderdate >= this) AS now, count(*) FILTER (o_orderdate >= this - INTERVAL 1 MONTH AND o_orderdate < this) AS before FROM orders, m)
SELECT now AS this_month, before AS last_month, round(CASE WHEN before = 0 THEN 0 ELSE 100.0 * (now - before) / before END, 4) AS growth FROM c
""")
def period_over_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    this = F.lit(orders.agg(F.date_trunc("month", F.max("o_orderdate")).alias("m")).first()["m"])
    at = F.col("o_orderdate")
    counts = orders.agg(F.count(F.when(at >= this, 1)).alias("this_month"), F.count(F.when((at >= this - F.expr("INTERVAL 1 MONTH")) & (at < this), 1)).alias("last_month"))
    return counts.withColumn("growth", F.round(R.ratio(F.col("this_month") - F.col("last_month"), F.col("last_month"), default=0.0), 4))


@query("""
WITH m AS (SELECT max(ts) AS now FROM events)
SELECT count(*) FILTER (CAST(ts AS DATE) = CAST(now AS DATE)) AS today, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS last_7d,
       count(*) FILTER (ts >= now - INTERVAL 30 DAY) AS last_30d, count(*) FILTER (ts >= now - INTERVAL 90 DAY) AS last_90d FROM events, m
""")
def date_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts").alias("m")).first()["m"])
    since = lambda d: F.count(F.when(F.col("ts") >= now - F.expr(f"INTERVAL {d} DAY"), 1)).alias(f"last_{d}d")
    return events.agg(F.count(F.when(F.to_date("ts") == F.to_date(now), 1)).alias("today"), since(7), since(30), since(90))


@query("""
SELECT doc_id, count(conv_id) AS replies FROM documents LEFT JOIN conversations ON conv_id = doc_id GROUP BY doc_id
""")
def replies_per_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    posts = table(spark, sf_dir, "documents").select("doc_id")
    return posts.join(replies, F.col("doc_id") == F.col("conv_id"), "left").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("replies"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.except_keys(table(spark, sf_dir, "customer"), urgent, "c_custkey")


@query("SELECT count(*) AS orphans FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL")
def orphan_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return joined.agg(F.count(F.lit(1)).alias("orphans"))


GRANTS = "(1, 'record:read'), (1, 'record:create'), (2, 'record:read'), (2, 'user:update'), (3, '*:*')"
DIRECT = "SELECT c_custkey AS user_id, CASE WHEN c_nationkey % 2 = 0 THEN 'record:read' ELSE 'cms:delete' END AS code FROM customer WHERE c_custkey % 5 = 0"
HOLDERS = "SELECT c_custkey AS user_id, CAST(1 + (c_custkey + i) % 3 AS INT) AS role_id FROM customer CROSS JOIN (VALUES (0), (1)) AS k(i) WHERE c_custkey % 4 > i"


@query(f"""
SELECT user_id, code FROM ({HOLDERS}) h JOIN (VALUES {GRANTS}) g(role_id, code) USING (role_id)
UNION SELECT user_id, code FROM ({DIRECT}) d
""")
def permission_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_role = sql(spark, sf_dir, HOLDERS).join(rows(spark, GRANTS, "role_id, code"), "role_id").select("user_id", "code")
    return by_role.union(sql(spark, sf_dir, DIRECT)).distinct()


@query("""
SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)
""")
def acl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    granted = table(spark, sf_dir, "lineitem").filter("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders")
    owned = orders.filter("o_custkey = 7").select("o_orderkey")
    return owned.union(orders.select("o_orderkey").join(granted, "o_orderkey", "left_semi")).distinct()


@query("""
SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '{"k": "x"}' WHEN event_id % 51 = 0 THEN '{"k": "3"}' WHEN event_id % 52 = 0 THEN 'no json' ELSE props END AS props FROM events)
WHERE CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END = 3
""")
def json_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 50 == 0, '{"k": "x"}').when(F.col("event_id") % 51 == 0, '{"k": "3"}').when(F.col("event_id") % 52 == 0, "no json")
    events = table(spark, sf_dir, "events").select("event_id", F.coalesce(odd, F.col("props")).alias("props"))
    return events.filter(F.get_json_object("props", "$.k").try_cast("long") == 3).select("event_id")


TAGGED = """
SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN '[]' WHEN 1 THEN NULL ELSE concat('[{"text":"', lang, '"},{"text":"', source, '"},{"text":"', CAST(doc_id % 150 AS STRING), '"}]') END AS tags FROM documents
"""


@query(f"""
SELECT DISTINCT json_extract_string(t, '$.text') AS tag FROM (SELECT unnest(CAST(tags AS JSON[])) AS t FROM ({TAGGED}) x)
""")
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.explode(F.from_json("tags", "array<struct<text:string>>"))
    return sql(spark, sf_dir, TAGGED).select(tags.alias("t")).select(F.col("t.text").alias("tag")).distinct()


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '{NOW}' THEN 'expired' ELSE o_orderstatus END AS status FROM orders
""")
def expire_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY") < F.lit(NOW).cast("timestamp"))
    return R.update_where(table(spark, sf_dir, "orders"), stale, {"o_orderstatus": F.lit("expired")}).select("o_orderkey", F.col("o_orderstatus").alias("status"))


PEOPLE = """
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '12345' WHEN 1 THEN NULL ELSE concat('138', lpad(CAST(c_custkey AS STRING), 8, '0')) END AS phone, CASE c_custkey % 5 WHEN 0 THEN 'b' WHEN 1 THEN '@x' ELSE concat(c_name, '@example.org') END AS email,
 CASE c_custkey % 3 WHEN 0 THEN '1101' WHEN 1 THEN '' ELSE concat('1101011990', lpad(CAST(c_custkey AS STRING), 8, '0')) END AS card, c_mktsegment AS other FROM customer
"""


@query(f"""
SELECT id, CASE WHEN strlen(phone) < 4 THEN '****' WHEN strlen(phone) >= 11 THEN left(phone, 3) || '****' || right(phone, 4) ELSE '****' END AS phone,
 CASE WHEN strlen(email) < 4 THEN '****' WHEN instr(email, '@') > 1 THEN left(email, 1) || '***@' || split_part(email, '@', -1) ELSE '****' END AS email,
 CASE WHEN strlen(card) < 4 THEN '****' WHEN strlen(card) >= 18 THEN left(card, 6) || '*********' || right(card, 4) ELSE '****' END AS card, other
FROM ({PEOPLE}) t
""")
def masking_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = {"phone": (True, True, "phone"), "email": (True, True, "email"), "card": (True, True, "id_card"), "other": (True, False, "")}
    return R.mask_columns(sql(spark, sf_dir, PEOPLE), policies)


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def department_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.data_scope(table(spark, sf_dir, "customer"), "department", F.lit(1), "c_custkey", "c_nationkey", F.lit(7)).select("c_custkey")


@query(f"SELECT 'all' AS shown, count(*) AS n FROM lineitem UNION ALL SELECT 'deleted', count(*) FROM lineitem WHERE {DELETED} UNION ALL SELECT 'live', count(*) FROM lineitem WHERE NOT ({DELETED})")
def tri_state_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, out = table(spark, sf_dir, "lineitem"), None
    for shown, flag in (("all", ""), ("deleted", "true"), ("live", "false")):
        part = with_deleted(lines, flag, F.expr(DELETED)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(shown).alias("shown"), "n")
        out = part if out is None else out.union(part)
    return out


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'
AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = [
        F.col("o_orderstatus") != "P",
        F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"),
        F.col("o_orderdate") < F.lit("1996-07-01").cast("timestamp"),
        F.col("o_totalprice").between(1000, 200000),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
    ]
    found = table(spark, sf_dir, "orders")
    for condition in chain:
        found = found.filter(condition)
    return found.select("o_orderkey")


@query("""
SELECT r_name, n_name, count(c_custkey) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name
""")
def two_hop_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_nation = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nations = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(by_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("r_name", "n_name", F.coalesce("n", F.lit(0).cast("long")).alias("customers"))


@query("SELECT r_name, t.level FROM region CROSS JOIN (VALUES ('read'), ('write'), ('admin')) t(level)")
def cross_join_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_name").crossJoin(rows(spark, "('read'), ('write'), ('admin')", "level"))


@query("""
SELECT c_nationkey, max(o_orderdate) AS newest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest_order FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey
""")
def newest_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.max("o_orderdate").alias("newest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest_order"))


@query("""
WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)
SELECT p_type, arg_min(p_brand, (-n, p_brand)) AS brand FROM c GROUP BY p_type
""")
def style_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode_of(table(spark, sf_dir, "part"), ["p_type"], "p_brand", "brand")


@query("""
WITH m AS (SELECT l_suppkey, l_linenumber % 3 AS label, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
w AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey) AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, label) AS rn FROM m)
SELECT l_suppkey, CAST(label AS VARCHAR) AS label, round(w / t, 6) AS confidence FROM w WHERE rn = 1
""")
def weighted_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_linenumber") % 3).cast("string"))
    return R.heaviest_label(lines, ["l_suppkey"], "label", "l_quantity")


@query("""
SELECT p_brand, round(1 - sum(p * p), 6) AS gini FROM (SELECT p_brand, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS p FROM part GROUP BY p_brand, p_type) GROUP BY p_brand
""")
def gini_impurity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("p_brand").agg(F.round(1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 6).alias("gini"))


@query("SELECT c_name AS name, count(*) AS n FROM customer GROUP BY c_name HAVING count(*) > 1 UNION ALL SELECT text, count(*) FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    texts = table(spark, sf_dir, "documents").select(F.col("text").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return names.union(texts)


TOKENS = "SELECT c_custkey AS id, c_name AS token FROM customer WHERE c_custkey % 3 > 0"
NEW_TOKENS = "SELECT c_custkey AS id, c_mktsegment AS token FROM customer WHERE c_custkey % 2 = 0"


@query(f"""
WITH t AS ({TOKENS}), n AS ({NEW_TOKENS})
SELECT id, token, 'keep' AS mode FROM t UNION ALL SELECT id, token, 'keep' FROM n WHERE id NOT IN (SELECT id FROM t)
UNION ALL SELECT id, token, 'replace' FROM t WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, token, 'replace' FROM n
""")
def upsert_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, new = sql(spark, sf_dir, TOKENS), sql(spark, sf_dir, NEW_TOKENS)
    return R.upsert(now, new, "id", update=False).withColumn("mode", F.lit("keep")).unionByName(R.upsert(now, new, "id", update=True).withColumn("mode", F.lit("replace")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascading_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey")
    return R.delete_where_in(table(spark, sf_dir, "lineitem"), "l_orderkey", doomed, "o_orderkey").select("l_orderkey", "l_linenumber")


RULES_BEFORE = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS rules FROM part"
RULES_AFTER = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 7 > 0 THEN p_brand END AS rules FROM part"


@query(f"SELECT b.id, b.rules AS old_value FROM ({RULES_BEFORE}) b JOIN ({RULES_AFTER}) a USING (id) WHERE a.rules IS DISTINCT FROM b.rules")
def rule_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.revisions(sql(spark, sf_dir, RULES_BEFORE), sql(spark, sf_dir, RULES_AFTER), "id", "rules")


KEYS_A = "SELECT concat('field', CAST(p_partkey AS STRING)) AS k, CASE WHEN p_partkey % 9 > 0 THEN p_brand END AS v FROM part WHERE p_partkey % 4 > 0"
KEYS_B = "SELECT concat('field', CAST(p_partkey AS STRING)) AS k, CASE WHEN p_partkey % 5 > 0 THEN p_brand ELSE p_type END AS v FROM part WHERE p_partkey % 3 > 0"


@query(f"SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value FROM ({KEYS_A}) a FULL JOIN ({KEYS_B}) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def key_union_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.key_union_diff(sql(spark, sf_dir, KEYS_A), sql(spark, sf_dir, KEYS_B), "k", "v")


USERS = "(1, 'admin', 5.0, false, false, false, 0, 0, false), (2, 'user', 0.0, false, false, false, 0, 0, false), (3, 'user', 5.0, true, false, false, 0, 0, false), (4, 'user', 5.0, false, true, true, 1, 3, false), (5, 'user', 5.0, false, true, true, 3, 3, false), (6, 'user', 5.0, false, false, false, 0, 0, true), (7, NULL, 0.0, true, true, true, 0, 9, true)"
USER_NAMES = "id, role, price, free, active, allowed, used, quota, paid"
HELD_BY = dealt(USERS, USER_NAMES, "customer", "c_custkey")


@query(f"""
SELECT id, CASE WHEN role IS NULL THEN false WHEN price <= 0 THEN true WHEN free THEN true WHEN role IN ('admin', 'free') THEN true
 WHEN active AND allowed AND used < quota THEN true WHEN paid THEN true ELSE false END AS ok FROM ({HELD_BY}) t
""")
def entitlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = sql(spark, sf_dir, HELD_BY)
    return users.select("id", R.entitled(*[F.col(c) for c in ("price", "free", "role", "active", "allowed", "used", "quota", "paid")]).alias("ok"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, rn FROM r WHERE rn <= 2
""")
def candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rank.alias("rn")).filter("rn <= 2")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'A' WHEN o_totalprice >= 200000 THEN 'B' WHEN o_totalprice >= 100000 THEN 'C' WHEN o_totalprice >= 50000 THEN 'D' ELSE 'F' END AS grade FROM orders")
def grade_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(total >= 300000, "A").when(total >= 200000, "B").when(total >= 100000, "C").when(total >= 50000, "D").otherwise("F").alias("grade"))


@query("""
WITH s AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, CASE WHEN prev IS NULL OR o_totalprice = prev THEN 'stable' WHEN o_totalprice > prev THEN 'improving' ELSE 'declining' END AS trend FROM s WHERE rn = 1
""")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey")
    scored = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", F.lag("o_totalprice").over(order.orderBy("o_orderdate", "o_orderkey")).alias("prev"), F.row_number().over(order.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("rn")
    )
    now, prev = F.col("o_totalprice"), F.col("prev")
    return scored.filter("rn = 1").select("o_custkey", F.when(prev.isNull() | (now == prev), "stable").when(now > prev, "improving").otherwise("declining").alias("trend"))
