"""The n-gram model against its definition over dictionaries."""

import math
import os
import random
import re
import resource
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pageloom.llm import kneser_ney as kn
from pageloom.llm import queries


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


def brute(train, score, order):
    counts = {order: Counter()}
    raw = Counter()
    for t in train:
        line = tokens(t)
        raw.update(line)
        line = ["<s>"] * (order - 1) + line
        counts[order].update(tuple(line[i - order + 1 : i + 1]) for i in range(order - 1, len(line)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, sums = {}, {}
    for k, c in counts.items():
        disc[k] = [0.0, *kn.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)])]
        sums[k] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            sums[k][g[:-1]][0] += v
            sums[k][g[:-1]][1] += disc[k][min(v, 3)]
    n, v = sum(raw.values()), len(raw)

    def p(k, gram):
        if k == 0:
            return 1 / (v + 1)
        lower = p(k - 1, gram[1:])
        total, freed = sums[k].get(gram[:-1], (0, 0))
        if not total:
            return lower
        c = counts[k].get(gram, 0)
        return (c - disc[k][min(c, 3)]) / total + freed / total * lower

    out = []
    for t in score:
        line = tokens(t)
        padded = ["<s>"] * (order - 1) + line
        out.append((
            len(line), sum(raw[w] > 0 for w in line), sum(math.log10((raw[w] + 0.5) / (n + 0.5 * (v + 1))) for w in line),
            sum(math.log10(p(order, tuple(padded[i : i + order]))) for i in range(len(line))),
        ))
    return n, out


def texts_of(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the", "É", "é😀", "a.b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return ["".join(rng.choice([" ", "\n", "\t ", " "]) + w for w in rng.choices(vocabulary, weights, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("order,part_bytes,flush", [(2, 10 << 20, 3 << 20), (2, 2000, 50), (3, 3000, 200), (4, 5000, 1000)])
def test_scores_match_the_definition(spark, documents, monkeypatch, order, part_bytes, flush):
    monkeypatch.setattr(kn, "PART_BYTES", part_bytes)
    monkeypatch.setattr(kn, "FLUSH_TOKENS", flush)
    monkeypatch.setattr(kn, "SCORE_TOKENS", flush)
    rng = random.Random(order)
    train = texts_of(rng, 150) + [None, "", "the the the", "the the the"]
    score = train[:40] + texts_of(rng, 20) + [None, "", "unknown words only", "x " * 3000]
    model = kn.train(documents(list(enumerate(train))), order=order)
    n, expected = brute(train, score, order)
    assert model.tokens == n and (part_bytes > 5000) == (model.layout.parts == 1)
    got = kn.with_scores(documents(list(enumerate(score)), "score", "word"), model).orderBy("doc_id").collect()
    for r, e in zip(got, expected):
        assert (r["n_tokens"], r["n_known"], r["word"]) == (e[0], e[1], "clash")
        assert np.isclose(r["base_score"], e[2], rtol=1e-9) and np.isclose(r["score"], e[3], rtol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_many_parts_need_few_open_files(spark, documents, monkeypatch, order):
    monkeypatch.setattr(kn, "PART_BYTES", 12)
    monkeypatch.setattr(kn, "SEGMENTS", 40)
    monkeypatch.setattr(kn, "OPEN_FILES", 20)
    rng = random.Random(order)
    train = texts_of(rng, 300) + ["the of the of the"] * 50
    model = kn.train(documents(list(enumerate(train))), order=order)
    files = os.listdir(model.folder)
    assert model.layout.parts > 2000 and model.layout.segments == 40 and 200 < len(files) <= 40 * (4 + 4 * (order - 1))
    assert all(0 < len(h) <= kn.HOT for h in model.hot.values()) and set(model.hot) == set(range(2, order + 1))
    _, expected = brute(train, train[:60], order)
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    scorer = kn.Scorer(model)
    resource.setrlimit(resource.RLIMIT_NOFILE, (min(len(os.listdir("/proc/self/fd")) + 40, hard), hard))
    try:
        got = scorer.score(list(kn.word_hashes(train[:60])))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert len(scorer.files) == 20
    assert np.allclose(got[3], [e[3] for e in expected], rtol=1e-9)


def test_wide_counts(spark, documents, monkeypatch):
    """Counts past 32 bits take 64: the same model, whatever the type."""
    train = texts_of(random.Random(9), 40)
    docs = documents(list(enumerate(train)))
    model = kn.train(docs)
    made = kn.Layout.__init__
    monkeypatch.setattr(kn.Layout, "__init__", lambda self, parts, order, hot, counts: made(self, parts, order, hot, "uint64"))
    wide = kn.train(docs)
    assert (model.layout.counts, wide.layout.counts) == ("uint32", "uint64")
    words = list(kn.word_hashes(train))
    assert np.allclose(kn.Scorer(model).score(words)[3], kn.Scorer(wide).score(words)[3], rtol=1e-12)


def test_blocks_come_back():
    rng = np.random.default_rng(1)
    for n, words, top in [(1, 1, 1), (500, 90, 200), (70000, 200, 70000), (90000, 70000, 1 << 31)]:
        table = rng.integers(0, 1 << 63, words).astype(np.uint64)
        columns, counts = table[rng.integers(0, words, (3, n))], rng.integers(1, top + 1, n)
        got = kn._unpack(kn._pack(columns, counts))
        assert (got[0] == columns).all() and (got[1] == counts).all()


def test_probabilities_sum_to_one(spark, documents):
    train = ["a b c a b", "b c a", "a a a b", "c"]
    model = kn.train(documents(list(enumerate(train))))
    for before in ("a", "b", "zz"):
        # P(w | before) = P(before w </s>) / ... is read from differences of texts: score the pair, take away the context's part
        rows = [(i, f"{before} {w}") for i, w in enumerate(["a", "b", "c", "unseen"])]
        scorer = kn.Scorer(model)
        words = list(kn.word_hashes([t for _, t in rows]))
        tokens_, found, counts = kn.histories(words, 2)
        total = 0.0
        for w in words:
            # the second token's probability: score(before w) - score(before) without the end marks
            own = scorer_p(scorer, w, 1)
            total += own
        end = scorer_p(scorer, words[0][:1], 1)
        assert np.isclose(total + end, 1.0)


def scorer_p(scorer, words, at):
    """Probability of the token at a place of one text (the end mark counts as a token)."""
    m = scorer.model
    tokens_, found, _ = kn.histories([words], 2)
    own = tokens_[at : at + 1]
    low = scorer.find(1, m.layout.of_word(own), kn.mix(own), "key", "count", 1)[:, 0]
    p = scorer._level(1, low, None, np.full(1, 1 / (m.types + 1)))
    history, last = found[0][at : at + 1], tokens_[at - 1 : at]
    stats = scorer.find(2, m.layout.of_history(history), kn.mix(history + np.uint64(1)), "history", "stats", 4)
    hot = m.hot.get(2, {}).get(int(history[0]))
    stats = np.array([hot]) if hot else stats
    n = scorer.find(2, m.layout.of_gram(2, history, last, own), kn.gram_hash(history, own), "key", "count", 1)[:, 0]
    return float(scorer._level(2, n, stats, p)[0])


def test_word_hashes_in_pieces():
    rng = random.Random(1)
    texts = texts_of(rng, 30) + ["x" * 700 + " y", None, " " * 500]
    whole = [w.tolist() for w in kn.word_hashes(texts)]
    assert [w.tolist() for w in kn.word_hashes(texts, chunk=100)] == whole
    assert [len(w) + 1 for w in whole] == [len(tokens(t)) for t in texts]
    by = {}
    for t, w in zip(texts, whole):
        for a, b in zip(tokens(t), w):
            assert by.setdefault(a, b) == b
    assert len(set(by.values())) == len(by)


def test_no_rows(spark, documents):
    model = kn.train(documents([]))
    got = kn.with_scores(documents([(1, "a b"), (2, None)]), model).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in got] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert kn.with_scores(documents([]), model).count() == 0


def test_query(spark, sf):
    rows = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows}
    n, expected = brute([r["text"] for r in rows if not held[r["doc_id"]]], [r["text"] for r in rows], 2)
    got = {r["doc_id"]: r for r in queries.op6_kneser_ney(spark, sf).collect()}
    better = []
    for r, e in zip(rows, expected):
        g = got[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[r["doc_id"]], e[0], e[1], n)
        assert np.isclose(g["base_score"], e[2], rtol=1e-9) and np.isclose(g["score"], e[3], rtol=1e-6)
        better.append(g["score"] - g["base_score"])
    assert sum(better) > 0
