"""A tree that tells languages apart by how often letters occur, grown by aggregation; the SQL grows it level by level too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import cart
from quire.plans.registry import query
from quire.sources.tables import table

LETTERS = ("w", "k", "q", "z", "y", "ñ", "é", "ü", " ", "e")
LEVELS = 6


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with how often each letter occurs among a thousand, their language, and a weight."""
    text = F.coalesce("text", F.lit(""))
    share = lambda c: F.floor(1000 * (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / F.greatest(F.length(text), F.lit(1))).cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), (1 + F.col("doc_id") % 3).alias("weight"), F.array(*map(share, LETTERS)).alias("features"))


def _sql() -> str:
    """DuckDB: a step for each level, over rows with the node that they have come to."""
    shares = ", ".join(f"CAST(floor(1000 * (length(body) - length(replace(body, '{c}', ''))) / greatest(length(body), 1)) AS DOUBLE)" for c in LETTERS)
    steps = [f"r0 AS MATERIALIZED (SELECT doc_id, lang AS label, 1 + doc_id % 3 AS weight, [{shares}] AS f, CAST(1 AS BIGINT) AS node FROM (SELECT *, coalesce(text, '') AS body FROM documents) WHERE lang IS NOT NULL)"]
    for d in range(LEVELS + 1):
        steps.append(f"""
c{d} AS MATERIALIZED (SELECT node, feature, f[feature + 1] AS value, label, sum(weight) AS w, count(*) AS n FROM r{d} CROSS JOIN range({len(LETTERS)}) AS x(feature) GROUP BY ALL),
b{d} AS (SELECT node, label, sum(w) AS t, sum(n) AS tn FROM c{d} WHERE feature = 0 GROUP BY ALL),
a{d} AS (SELECT node, sum(t) AS weight, sum(tn) AS samples, sum(t * t) AS squares, count(*) AS labels, arg_min(label, (-t, label)) AS label, max(t) AS best FROM b{d} GROUP BY node)""")
        if d == LEVELS:
            break
        steps.append(f"""
v{d} AS (SELECT *, (value + lead(value) OVER o) / 2 AS threshold, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY node, feature) - 1 AS m FROM (SELECT DISTINCT node, feature, value FROM c{d}) WINDOW o AS (PARTITION BY node, feature ORDER BY value)),
h{d} AS (SELECT node, feature, threshold FROM v{d} WHERE threshold IS NOT NULL AND k % CASE WHEN m > {cart.CANDIDATES} THEN m // {cart.CANDIDATES} ELSE 1 END = 0),
l{d} AS (SELECT node, feature, threshold, label, sum(w) AS l, sum(n) AS ln FROM c{d} JOIN h{d} USING (node, feature) WHERE value <= threshold GROUP BY ALL),
s{d} AS (SELECT node, feature, threshold, sum(l) AS lw, sum(ln) AS ln, sum(l * l) AS ll, sum(t * l) AS tl FROM l{d} JOIN b{d} USING (node, label) GROUP BY ALL),
g{d} AS (SELECT node, feature, threshold, CAST(ll AS DOUBLE) / CAST(lw AS DOUBLE) + CAST(squares - 2 * tl + ll AS DOUBLE) / CAST(weight - lw AS DOUBLE) AS purity FROM s{d} JOIN a{d} USING (node) WHERE ln >= {cart.SIDE} AND samples - ln >= {cart.SIDE} AND samples >= {cart.LEAST} AND labels > 1),
p{d} AS MATERIALIZED (SELECT node, feature, threshold FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY purity DESC, feature, threshold) AS r FROM g{d}) WHERE r = 1),
r{d + 1} AS MATERIALIZED (SELECT doc_id, label, weight, f, 2 * node + CAST(f[feature + 1] > threshold AS INT) AS node FROM r{d} JOIN p{d} USING (node))""")
    nodes = " UNION ALL ".join(f"SELECT node, {d} AS depth, samples, {'NULL' if d == LEVELS else 'feature'} AS feature, {'NULL' if d == LEVELS else 'threshold'} AS threshold, label, best / weight AS confidence FROM a{d}" + ("" if d == LEVELS else f" LEFT JOIN p{d} USING (node)") for d in range(LEVELS + 1))
    return f"WITH {', '.join(steps)}, tree AS ({nodes})"


TREE = _sql()


@query(f"{TREE} SELECT node, depth, CAST(samples AS BIGINT) AS samples, feature, threshold, label, round(confidence, 9) AS confidence FROM tree")
def cart_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cart.grow(samples(spark, sf_dir), depth=LEVELS).withColumn("confidence", F.round("confidence", 9))


@query(
    f"{TREE}, placed AS ("
    + " UNION ALL ".join(f"SELECT doc_id, node FROM r{d}" + (f" WHERE node NOT IN (SELECT node FROM p{d})" if d < LEVELS else "") for d in range(LEVELS + 1))
    + ") SELECT doc_id, node, label AS predicted FROM placed JOIN tree USING (node) UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE lang IS NULL"
)
def cart_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    found = cart.predict(rows, cart.grow(rows, depth=LEVELS))
    known = F.col("label").isNotNull()
    return found.select("doc_id", F.when(known, F.col("node")).alias("node"), F.when(known, F.col("predicted")).alias("predicted"))
