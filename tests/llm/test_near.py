"""SimHash groups, components and repeated passages."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import simhash, substring
from quire.llm.components import components
from tests.llm.conftest import PASSAGE, ROWS


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    label = list(range(len(prints)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash(odd, empty):
    prints = [brute_print(t) for _, t, _, _ in ROWS]
    labels = brute_components(prints)
    least = defaultdict(lambda: None)
    for (k, *_), c in zip(ROWS, labels):
        if k is not None:
            least[c] = k if least[c] is None else min(least[c], k)
    expected = Counter((k, f"{p:016x}", least[c]) for (k, *_), p, c in zip(ROWS, prints, labels))
    found = simhash.near_duplicates(odd).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == expected
    assert len({r["tie"] for r in found if r["kept"]}) == len(set(labels))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_no_link_is_lost(spark, clustered):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = set()
    for _ in range(150):
        p = base if clustered and rng.random() < 0.6 else rng.getrandbits(64)
        prints.add(p)
        for _ in range(3):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    expected = {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3}
    found = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.links(df).collect()}
    assert found == expected


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_plans_cover_the_distance(n):
    rng = np.random.default_rng(1)
    x = rng.random((500, 64)) < 0.5
    x[:, 1] = x[:, 0]
    both = (x.T.astype(float) @ x) * (n / 500)
    how = simhash.plan(n, both)
    assert sorted(b for g in how.groups for b in g) == list(range(64))
    assert sum(how.thresholds) == simhash.DISTANCE - len(how.groups) + 1
    assert any({0, 1} <= set(g) for g in how.groups)


def test_more_prints_lead_to_wider_groups():
    both = lambda n: np.full((64, 64), n / 4) + np.eye(64) * n / 4
    assert len(simhash.plan(10**10, both(10**10)).groups) < len(simhash.plan(10**4, both(10**4)).groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["label"] for r in components(df, "a", "b").collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(60)) and found[201] == found[200] == 200 and 300 not in found
    assert components(df.limit(0), "a", "b").count() == 0


def brute_repeats(rows, window=50):
    order = lambda k: substring.LAST if k is None else k
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, split):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(order(k), least.get(key, order(k)))
    out = []
    for (k, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < order(k):
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return Counter(out)


def test_repeats(odd, empty):
    assert Counter(map(tuple, substring.substring_digests(odd).collect())) == brute_repeats([(k, t) for k, t, _, _ in ROWS])
    assert substring.substring_digests(empty).count() == 0
    found = substring.without_repeats(odd)
    cut = {r["doc_id"]: r["text"] for r in found.collect()}
    assert cut[11] == "other words" and cut[10] == f"before {PASSAGE} after" and cut[3] is None and cut[5] == "   \n " and cut[7] == "end"
    assert found.columns == odd.columns and {r["n_removed"] for r in found.collect()} == {"x"}


@pytest.mark.parametrize("group", [substring.GROUP, 3, 1])
def test_repeats_in_few_words(spark, group):
    """Many overlapping repeats, also inside one document; groups that are too large take longer prefixes, then whole windows."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") if i % 3 else "x" for _ in range(rng.randint(0, 90)))) for i in range(40)]
    rows += [(100 + i, " ".join(f"k{j}" for j in range(i, i + 70))) for i in range(0, 60, 7)] + [(7, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = substring.substring_digests(df, group=group).collect()
    assert Counter(map(tuple, found)) == brute_repeats(rows)
    assert Counter(map(tuple, substring.substring_digests(df.filter(F.length("text") > 0), window=10, prefixes=(3, 5), group=group).collect())) == brute_repeats([r for r in rows if r[1]], 10)


def test_a_passage_in_a_third_of_all_rows(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    passage = words(65)
    rows = [(i, f"{words(20)} {passage} {words(rng.randint(0, 30))}" if i % 3 == 0 else words(80)) for i in range(300)]
    for group in (substring.GROUP, 20):
        found = substring.substring_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), group=group).collect()
        assert Counter(map(tuple, found)) == brute_repeats(rows)


def test_subtrees():
    """Nodes 3 words deep: what stands under one begins alike, as far as the node is deep and no further."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    trees = substring.Subtrees(np.array([i % 2 for i in range(60)]), texts, 3)
    node, depth = trees.deep_nodes(3)
    under = defaultdict(list)
    for s, o, k in zip(trees.suffixes, trees.owner, node):
        under[k].append((o % 2, texts[o].split()[s - trees.begins[o] :]))
    for k, found in under.items():
        assert len({g for g, _ in found}) == 1
        if len(found) > 1:
            d = depth[k]
            assert d >= 3 and len({tuple(w[:d]) for _, w in found}) == 1 and (any(len(w) == d for _, w in found) or len({w[d] for _, w in found}) > 1)
    tops = [(found[0][0], tuple(found[0][1][:3])) for found in under.values()]
    assert len(set(tops)) == len(tops)
