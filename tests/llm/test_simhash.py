"""SimHash components against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import queries, simhash
from pageloom.llm.components import components


def roots_of(values, linked):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def brute_fingerprint(text, width=3):
    import re
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t ", "a", "A b", "É b É", "a b c d e", "x y z w v\x1fu", "w " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def clusters(rng, n, near):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(near):
            y = x
            for _ in range(rng.randint(0, 3)):
                y ^= 1 << rng.randrange(64)
            out.add(y)
            x = y if rng.random() < 0.5 else x
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 16])
def test_links_match_all_pairs(spark, block):
    values = clusters(random.Random(block), 400, 40) + [0, 1, (1 << 64) - 1]
    expected = roots_of(values, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    edges = simhash.near_links(prints, 3, block)
    assert edges.count() < 40 * len(values)
    roots = {int(np.uint64(r["vertex"] & (2**64 - 1))): r["root"] for r in components(edges).collect()}
    for a in values:
        for b in values:
            assert (expected[a] == expected[b]) == (a == b or (a in roots and roots[a] == roots.get(b)))


@pytest.mark.parametrize("thresholds", [[(0, 2)], [(0, 1), (1, 1)], [(0, 0), (1, 2)], [(0, 1), (1, 0), (2, 0)]])
def test_every_plan_finds_all(spark, thresholds, monkeypatch):
    """Whatever thresholds the estimate picks, no link is lost: forced plans over a cluster in 12 bits."""
    rng = random.Random(5)
    values = sorted({rng.getrandbits(64) & 0xF0F0F for _ in range(150)})
    parts = len(thresholds)
    masks = [sum(1 << b for b in range(64) if b % parts == k) for k, _ in thresholds]
    distance = sum(t for _, t in thresholds) + parts - 1
    monkeypatch.setattr(simhash, "plan_parts", lambda prints, d: list(zip(masks, [t for _, t in thresholds])))
    edges = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fingerprint bigint"), distance)
    roots = {r["vertex"]: r["root"] for r in components(edges).collect()}
    expected = roots_of(values, lambda a, b: (a ^ b).bit_count() <= distance)
    for a in values:
        for b in values:
            assert (expected[a] == expected[b]) == (a == b or (a in roots and roots[a] == roots.get(b)))


def test_thresholds_keep_the_pigeonhole_sum():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    for parts in (1, 2, 3, 4):
        groups = simhash.group_bits(np.eye(64) * 100, 200, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        cost, thresholds = simhash.allocate(sample, 10**9, groups, 3)
        assert not thresholds or sum(thresholds) == 3 - parts + 1


def test_chain(spark):
    n = 500
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(9000, 9000), (7000, 7001)], "a long, b long")
    roots = {r["vertex"]: r["root"] for r in components(edges).collect()}
    assert len({roots[i] for i in range(n + 1)}) == 1 and roots[7000] == roots[7001] != roots[0] and 9000 not in roots


def test_query_matches_all_pairs(spark, sf):
    texts = dict(queries.table(spark, sf, "documents").select("doc_id", "text").collect())
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    roots = roots_of(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(roots[p], i)
    got = queries.op7_simhash_components(spark, sf).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted(
        (i, f"{p:016x}", least[roots[p]]) for i, p in prints.items()
    )


def test_cases(spark, documents):
    rows = [(3, None), (1, ""), (2, "one two three four"), (2, "one two three four"), (9, "One  two\tthree four")]
    got = simhash.near_duplicates(documents(rows, "fingerprint", "root", "least")).select("doc_id", "component_id", "root").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2), (2, 2), (3, 1), (9, 2)]
    assert {r["root"] for r in got} == {"clash"}
    assert simhash.near_duplicates(documents([])).count() == 0
