"""Closed syncmers against their definition, and the order of neighbours."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import queries, syncmers
from pageloom.llm.syncmers import K, S


def inner(codes):
    """The s-mer hashes of the definition: a polynomial of the codes, mixed."""
    base = int(syncmers._BASE)
    value = 0
    for c in codes:
        value = (value * base + int(c) + 1) % 2**64
    return value


def mixed(x):
    return int(syncmers._mix(np.array([x], np.uint64))[0])


def brute(codes):
    out = []
    for i in range(len(codes) - K + 1):
        hashes = [mixed(inner(codes[i + j : i + j + S])) for j in range(K - S + 1)]
        if min(hashes) in (hashes[0], hashes[-1]):
            out.append((i, mixed(inner(codes[i : i + K]))))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "a", "abcdefgh é😀"])
def test_anchors(alphabet, monkeypatch):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 1, K - 1, K, K + 1, 50, 300)] + [None]
    expected = [brute([ord(c) for c in t or ""]) for t in texts]
    for chunk in (1 << 19, 40):
        monkeypatch.setattr(syncmers, "_CHUNK", chunk)
        found = list(syncmers.anchors(texts))
        for t, (at, hashes), e in zip(texts, found, expected):
            if t and len(t) < K:
                assert at.tolist() == [0] and len(hashes) == 1
            else:
                assert list(zip(at.tolist(), hashes.tolist())) == e


def test_anchors_are_context_free():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, (before, after) = word(500), (word(77), word(31))
    (own, own_h), (other, other_h) = syncmers.anchors([passage, before + passage + after])
    inside = (other >= 77) & (other < 77 + 500 - K + 1)
    assert (other[inside] - 77).tolist() == own.tolist() and other_h[inside].tolist() == own_h.tolist()
    assert len(own) > 50


def prints(texts):
    return [syncmers.fingerprint(t, *found) for t, found in zip(texts, syncmers.anchors(texts))]


def plain_links(text):
    """(distance, hash, hash before) of every anchor of the definition."""
    found = brute([ord(c) for c in text])
    cut = [(p - q, h >> 44) for (p, h), (q, _) in zip(found, [(0, 0), *found])]
    return [(d, h, before) for (d, h), (_, before) in zip(cut, [(0, 0), *cut])]


def plain_like(a, b):
    """The chain by quadratic dynamic programming over the n-th occurrences."""
    def numbered(text):
        seen, out = {}, []
        for x in plain_links(text):
            seen[x] = seen.get(x, 0) + 1
            out.append((x, seen[x]))
        return out

    one, other = numbered(a), {x: i for i, x in enumerate(numbered(b))}
    places, best = [other[x] for x in one if x in other], []
    for i, p in enumerate(places):
        best.append(1 + max((n for n, q in zip(best, places) if q < p), default=0))
    chain = max(best, default=0)
    return chain / (len(one) + len(other) - chain)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é😀"])
def test_likeness_equals_the_plain_chain(alphabet):
    rng = random.Random(alphabet + "x")
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for _ in range(12):
        a, b, c = word(90), word(70), word(60)
        for x, y in ((a + b + c, c + a + b), (a + b, a + a + b), (a + b, b), (a + b, a + c), (a + b + a + b, b + a), (a + c + b, a + b[:40] + c)):
            p, q = prints([x, y])
            assert syncmers.matched(syncmers.links(p), syncmers.links(q)) == pytest.approx(plain_like(x, y))
            assert syncmers.links(p).tolist() == [(d << 20 | h) << 20 | before for d, h, before in plain_links(x)]


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc", "abcdefgh é😀"])
def test_distances_fit(alphabet):
    rng = random.Random(alphabet)
    for at, _ in syncmers.anchors(["".join(rng.choice(alphabet) for _ in range(3000)) for _ in range(5)]):
        assert np.diff(at, prepend=0).max() <= K - S and len(at) >= 300


def test_order_repetition_and_shared_passages_show():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    a, b, passage, long_one, long_other = word(3000), word(3000), word(200), word(40000), word(40000)
    like = lambda x, y: syncmers.matched(*map(syncmers.links, prints([x, y])))
    assert 0.3 < like(a + b, b + a) < 0.36 and 0.48 < like(a, a + a) < 0.52
    assert like(long_one, long_other) == 0 < like(long_one + passage, passage + long_other)
    assert like(a, a) == 1 and like(a, b) == 0
    assert like(a * 300, a * 300 + b) > 0.99  # 900,000 code points, every link 300 times


def test_longest_chain():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 9000):
        for p in (rng.permutation(n), np.arange(n), np.arange(n)[::-1], np.roll(np.arange(n), n // 3)):
            ends = []
            for x in p.tolist():
                i = int(np.searchsorted(ends, x))
                ends[i : i + 1] = [x]
            assert syncmers._longest_chain(p) == len(ends)


def test_short_and_empty_texts(spark, documents):
    texts = ["", "a", "b", "short", "x" * K, "y" * (K + 3), None]
    found = prints(texts)
    assert found[0] == found[-1] == "" and len(set(found[:-1])) == len(texts) - 1
    rows = documents([(i, t) for i, t in enumerate(texts)] + [(1, "a")], "fingerprint", "near")
    got = syncmers.with_fingerprints(rows, {"text": "fingerprint"}, {"near": ("text", "text")})
    assert sorted((r["doc_id"], r["fingerprint"], r["near"]) for r in got.collect()) == sorted([*((i, p, 1.0) for i, p in enumerate(found)), (1, found[1], 1.0)])
    pairs = got.alias("a").join(got.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select(
        F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), syncmers.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("like"))
    assert all(r["like"] == ((r["a"], r["b"]) == (0, 6)) for r in pairs.collect())
    assert syncmers.with_fingerprints(documents([]), {"text": "fingerprint"}, {"near": ("text", "text")}).count() == 0


ROWS = [(5, "first text, " * 20), (3, None), (9, ""), (3, "short"), (3, "short"), (None, "no id é😀" * 9), (7, "x" * 3000)]


@pytest.mark.parametrize("part_bytes", [1 << 30, 40])
def test_next_text(spark, documents, part_bytes):
    rng = random.Random(2)
    rows = ROWS + [(rng.randint(0, 60), "w" * rng.randint(0, 30) + str(i)) for i in range(150)]
    got = syncmers.with_next_text(documents(rows, "next_text", "part"), part_bytes=part_bytes).collect()
    assert len(got) == len(rows)
    hashes = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    line = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], hashes[r[1] or ""]), reverse=True)
    expected = sorted((str(a[0]), a[1] or "", b[1] or "") for a, b in zip(line, line[1:] + line[:1]))
    assert sorted((str(r["doc_id"]), r["text"] or "", r["next_text"]) for r in got) == expected


def test_empty(spark, documents):
    assert syncmers.with_next_text(documents([])).count() == 0
    assert syncmers.with_anchors(documents([])).count() == 0
    assert [r["anchors"] for r in syncmers.with_anchors(documents([(1, None)])).collect()] == [[]]


def test_query(spark, sf):
    texts = dict(queries.table(spark, sf, "documents").select("doc_id", "text").collect())
    ids = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in queries.op8_closed_syncmers(spark, sf).collect()}
    assert set(rows) == set(ids)
    own = dict(zip(texts.values(), prints(list(texts.values()))))
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, m, r = texts[i], len(texts[i]) // 3, rows[i]
        edited = t[: len(t) - m] + texts[after][:m]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own[t])
        assert r["edited_fingerprint"] == prints([edited])[0]
        like = lambda x: 1.0 if own[t] == x else syncmers.matched(*map(syncmers.links, (own[t], x)))
        assert (r["near_edited"], r["near_next"]) == (like(r["edited_fingerprint"]), like(own[texts[after]]))
    assert np.mean([r["near_edited"] for r in rows.values()]) > np.mean([r["near_next"] for r in rows.values()]) + 0.3
