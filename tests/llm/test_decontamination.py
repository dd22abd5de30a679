"""The FM-index and the contamination search against plain searches."""

import random
import re

import numpy as np
import pytest

from pageloom.llm import decontamination as dc


@pytest.mark.parametrize("seed", range(6))
def test_index(seed):
    rng = random.Random(seed)
    n_symbols = rng.choice([2, 3, 7, 40])
    unit = [rng.randrange(1, n_symbols) for _ in range(rng.choice([1, 3, 50]))]
    text = [rng.choice(unit) if seed % 2 else unit[i % len(unit)] for i in range(rng.choice([1, 20, 700]))]
    index = dc.FMIndex(np.array(text, np.int64), n_symbols, every=4)
    whole = [*text, 0]
    suffixes = sorted(range(len(whole)), key=lambda i: whole[i:])
    assert dc.suffix_array(np.array(whole)).tolist() == suffixes
    for length in (1, 2, 5):
        phrases = [[rng.randrange(1, n_symbols) for _ in range(length)] for _ in range(20)] + [text[k : k + length] for k in range(min(20, len(text) - length + 1))]
        phrases = np.array([p for p in phrases if len(p) == length])
        low, high = index.ranges(phrases, np.full(len(phrases), length))
        for p, a, b in zip(phrases.tolist(), low, high):
            found = [i for i in range(len(text)) if text[i : i + length] == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == found


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items, window=10):
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - window, 0) + 1) if w else ():
            phrases.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for p, ids in phrases.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= ids
        out.append((len(w), hit, sorted(found)))
    return out


ITEMS = [(1, " ".join(f"w{i}" for i in range(25))), (2, "Short item É"), (10, "short ITEM é"), (3, None), (4, " .. "), (5, "a a a a a a a a a a a a")]
TEXTS = [
    None, "", "nothing here", "W0, w1 w2-w3 w4 w5 w6 w7 w8 w9", "x " + " ".join(f"w{i}" for i in range(40)) + " short item é short item é",
    "a " * 30, "short item", "é", "a " * 9, " ".join(f"w{i}" for i in range(8)), "x" * 100000 + " short item é",
]


@pytest.mark.parametrize("shard,block", [(1 << 19, 200_000), (13, 3), (40, 7)])
def test_search(spark, documents, monkeypatch, shard, block):
    monkeypatch.setattr(dc, "SHARD_WORDS", shard)
    monkeypatch.setattr(dc, "BLOCK_PHRASES", block)
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4])]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = dc.find_contamination(documents(rows, "hit_items", "phrase"), items)
    got = found.collect()
    expected = dict(enumerate(brute(TEXTS, ITEMS)))
    assert len(got) == len(rows)
    for r in got:
        n, hit, ids = expected[r["doc_id"]]
        assert (r["n_words"], sorted(hit), ids) == (n, [k for s in r["hit_spans"] for k in range(s["first"], s["last"])], r["hit_items"])
    cleaned = {r["doc_id"]: r["text"] for r in dc.remove_spans(found).collect()}
    assert cleaned[4].split() == ["x"] + [f"w{i}" for i in range(25, 40)] and cleaned[2] == TEXTS[2] and cleaned[0] is None
    assert not any(hit for _, hit, _ in brute(cleaned.values(), ITEMS))


def test_no_items_or_rows(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["hit_items"] for r in dc.find_contamination(documents([(1, "a")]), none).collect()] == [[]]
    assert dc.find_contamination(documents([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
