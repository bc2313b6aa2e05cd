"""Trees grown by aggregation against a recursion over the samples."""

import random
from collections import Counter, defaultdict

import pytest

from quire.operators import cart

SCHEMA = "label string, weight long, features array<double>"


def brute(samples, depth=12, least=5, side=2, candidates=20, node=1, level=0):
    """The nodes under this one; weights are whole numbers."""
    weights = Counter()
    for label, w, _ in samples:
        weights[label] += w if w > 0 else 1
    label = min(weights, key=lambda x: (-weights[x], x))
    own = (node, level, len(samples), None, None, label, weights[label] / sum(weights.values()))
    best = None
    if len(samples) >= least and level < depth and len(weights) > 1:
        for f in range(len(samples[0][2])):
            values = sorted({x[2][f] for x in samples})
            middle = [(a + b) / 2 for a, b in zip(values, values[1:])]
            for h in middle[:: len(middle) // candidates if len(middle) > candidates else 1]:
                sides = defaultdict(Counter)
                counts = Counter()
                for la, w, x in samples:
                    sides[x[f] <= h][la] += w if w > 0 else 1
                    counts[x[f] <= h] += 1
                if min(counts[True], counts[False]) < side:
                    continue
                purity = sum(sum(c * c for c in s.values()) / sum(s.values()) for s in (sides[True], sides[False]))
                if best is None or purity > best[0]:
                    best = purity, f, h
    if best is None:
        return [own]
    _, f, h = best
    parts = [[x for x in samples if (x[2][f] > h) == late] for late in (False, True)]
    return [own[:3] + (f, h) + own[5:], *(n for i, p in enumerate(parts) for n in brute(p, depth, least, side, candidates, 2 * node + i, level + 1))]


def made(seed, n, kinds):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [float(rng.randint(0, 3)), float(rng.randint(0, 60)), round(rng.random(), 2), 1.0]
        truth = "a" if x[0] > 1 else "b" if x[1] < 30 else "c"
        rows.append((truth if rng.random() < 0.8 else rng.choice("abcd"[:kinds]), rng.choice([-1, 0, 1, 2, 7]), x))
    return rows


@pytest.mark.parametrize(("seed", "n", "depth", "least"), [(1, 300, 12, 5), (2, 120, 3, 20), (3, 4, 12, 5), (4, 60, 0, 5)])
def test_a_tree_is_that_of_the_recursion(spark, seed, n, depth, least):
    rows = made(seed, n, 4)
    tree = cart.grow(spark.createDataFrame(rows, SCHEMA).repartition(3), depth=depth, least=least)
    expected = {r[0]: r[1:] for r in brute(rows, depth, least)}
    found = {r["node"]: tuple(r)[1:] for r in tree.collect()}
    assert found.keys() == expected.keys()
    for node, r in found.items():
        assert r[:5] == expected[node][:5] and r[5] == pytest.approx(expected[node][5])
    leaves = {k for k, r in found.items() if r[2] is None}
    placed = cart.predict(spark.createDataFrame(rows, SCHEMA), tree).collect()
    assert {r["node"] for r in placed} == leaves and Counter(r["node"] for r in placed) == {k: found[k][1] for k in leaves}
    assert all(r["predicted"] == found[r["node"]][4] for r in placed)


def test_odd_samples(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cart.grow(empty).count() == 0
    assert [r["predicted"] for r in cart.predict(spark.createDataFrame([("a", 1, [1.0])], SCHEMA), cart.grow(empty)).collect()] == [None]
    same = spark.createDataFrame([("x", 1, [1.0])] * 9 + [("y", 1, [1.0])] * 9 + [(None, 1, [2.0])], SCHEMA)
    assert [tuple(r)[2:6] for r in cart.grow(same).collect()] == [(18, None, None, "x")]
    with pytest.raises(ValueError, match="levels"):
        cart.grow(same, depth=40)


def test_many_values_become_bins(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id < 2000 THEN 'low' ELSE 'high' END AS label", "1L AS weight", "array(cast(id AS double), cast(id % 3 AS double)) AS features")
    cut = cart.binned(rows, 2, 64)
    assert cut.selectExpr("features[0] AS f").distinct().count() <= 64 and cut.selectExpr("features[1] AS f").distinct().count() == 3
    tree = cart.grow(rows, bins=64)
    placed = cart.predict(rows, tree)
    assert placed.filter("label = predicted").count() > 4900 and cart.counted(cart._placed(cut, [])).count() <= 2 * 64 * 2


def test_more_values_than_bins_stay_exact(spark):
    rng = random.Random(7)
    rows = [("a" if x > 600 else "b" if rng.random() < 0.9 else "c", rng.choice([1, 2]), [float(x), rng.random(), 1.0]) for x in (rng.randrange(900) for _ in range(1500))]
    expected = {r[0]: r[1:5] for r in brute(rows, 3)}
    assert {r["node"]: tuple(r)[1:5] for r in cart.grow(spark.createDataFrame(rows, SCHEMA).repartition(3), depth=3).collect()} == expected


def test_cuts_are_found_by_groups(spark):
    for n in (1, 15, 16, 17, 100, 256):
        cuts = [float(3 * k) for k in range(n)]
        rows = spark.range(-2, 3 * n + 3).selectExpr("cast(id AS double) AS v").union(spark.sql("SELECT double('NaN')"))
        found = {str(r["v"]): r["c"] for r in rows.select("v", cart.at_least(rows["v"], cuts).alias("c")).collect()}
        assert found == {str(v): next((c for c in cuts if c >= v), cuts[-1]) for v in [*(float(x) for x in range(-2, 3 * n + 3)), float("nan")]}


def test_equal_samples_are_one_row_of_all_levels(spark, monkeypatch):
    kept, store = [], cart.stored
    monkeypatch.setattr(cart, "stored", lambda df: kept.append(store(df)) or kept[-1])
    rows = [("a" if x > 4 else "b" if y else "c", w, [float(x), float(y)]) for x in range(9) for y in range(2) for w in (1, 3) for _ in range(x + 2)]
    samples = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["node"]: tuple(r)[1:6] for r in cart.grow(samples, bins=64).collect()} == {r[0]: r[1:6] for r in brute(rows)}
    assert kept[0].count() == 36 and kept[0].groupBy().sum("copies").first()[0] == len(rows)
