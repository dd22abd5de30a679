"""Learned vectors against plain counts and numpy."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from pageloom.operators import learned


def corpus(seed, n=60):
    rng = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(8)] for k in range(3)]
    texts = [" ".join(rng.choice(rng.choice([topics[i % 3], ["the", "of"]])) for _ in range(rng.randint(0, 40))) for i in range(n)]
    return [*texts, texts[0], None, "", "the", "One, ONE one!"]


def plain_pairs(texts, known, window):
    found = collections.Counter()
    for t in texts:
        w = learned.re.findall("[a-z0-9]+", (t or "").lower())
        for i, a in enumerate(w):
            for b in w[i + 1 : i + 1 + window]:
                if a in known and b in known:
                    found[min(a, b), max(a, b)] += 1
    return found


def plain_matrix(pairs, terms):
    place = {t: i for i, t in enumerate(terms)}
    c = np.zeros((len(terms), len(terms)))
    for (a, b), n in pairs.items():
        c[place[a], place[b]] += n
        c[place[b], place[a]] += n
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.log(c * c.sum() / np.outer(c.sum(1), c.sum(0)))
    return np.where(c > 0, np.maximum(m, 0), 0)


def frame(spark, texts):
    return spark.createDataFrame([(t, "clash", 1) for t in texts], "text string, term string, n int")


def test_counts_and_vocabulary(spark):
    texts = corpus(1)
    docs = frame(spark, texts)
    counts = collections.Counter(w for t in texts for w in learned.re.findall("[a-z0-9]+", (t or "").lower()))
    order = sorted((t for t in counts if counts[t] >= 3), key=lambda t: (-counts[t], t))
    for most in (5, 1000):
        terms = learned.vocabulary(docs, max_terms=most)
        assert [tuple(r) for r in terms.collect()] == [(t, counts[t]) for t in order[:most]]
        for window in (1, 4):
            got = {(r["first"], r["second"]): r["n"] for r in learned.pair_counts(docs, terms, window=window).collect()}
            assert got == dict(plain_pairs(texts, set(order[:most]), window))


def test_decomposition_equals_numpy(spark):
    texts = corpus(2)
    docs = frame(spark, texts)
    terms = [r["term"] for r in learned.vocabulary(docs).collect()]
    numbers = spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, number int")
    entries = learned.information(learned.pair_counts(docs, numbers), numbers).repartition(3, "i").sortWithinPartitions("i", "j").persist()
    dense = plain_matrix(plain_pairs(texts, set(terms), learned.WINDOW), terms)
    got = np.zeros_like(dense)
    for r in entries.collect():
        got[r["i"], r["j"]] = r["value"]
    assert np.allclose(got, dense)
    tall = np.random.default_rng(1).standard_normal((len(terms), 7))
    assert np.allclose(learned.product(entries, tall), dense @ tall)
    dim = 5
    vectors, values = learned.decompose(entries, len(terms), dim, rounds=30)
    true, basis = np.linalg.eigh(dense)
    best = np.argsort(-np.abs(true))[:dim]
    assert np.allclose(values, true[best]) and np.allclose(dense @ vectors, vectors * values)
    assert np.allclose(np.abs((vectors * basis[:, best]).sum(0)), 1)
    again, _ = learned.decompose(entries.repartition(2, "i").sortWithinPartitions("i", "j").persist(), len(terms), dim, seed=9, rounds=30)
    assert np.allclose(again, vectors, atol=1e-6)  # the sign is fixed, whatever the start
    few, _ = learned.decompose(entries, len(terms), dim)
    same = few @ few.T @ vectors  # three rounds span nearly the same space
    assert np.linalg.norm(same - vectors) < 0.01 * np.linalg.norm(vectors)


def test_texts_of_a_topic_are_near(spark):
    docs = frame(spark, corpus(3, 240))
    model = learned.learn(docs, dim=8)
    assert np.allclose(np.linalg.norm(model.matrix, axis=1), 1, atol=1e-5) and model.matrix.shape == (len(model.terms), 8)
    a, b, c, none, empty = model.encoder()(["t0w1 the t0w2", "of t0w5 T0W6", "t1w1 t1w2 the", "unseen words", ""])
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert cos(a, b) > cos(a, c) + 0.3 and not none.any() and not empty.any()
    load = learned.loader(docs, model)
    from pageloom.operators.embedding import encoder_column

    got = docs.select("text", encoder_column(load)(F.col("text")).alias("v")).collect()
    assert all(np.allclose(r["v"], model.encoder()([r["text"] or ""])[0]) for r in got)


def test_nothing_to_learn(spark):
    for texts in ([], [None, ""], ["a b c"], ["a"] * 5):
        model = learned.learn(frame(spark, texts), dim=4)
        assert model.matrix.shape == (len(model.terms), 4) and np.isfinite(model.matrix).all()
        assert model.encoder()(["a b", ""]).shape == (2, 4)


def test_pairs_are_counted_in_pieces(spark, monkeypatch):
    texts = corpus(4, 90) * 3
    known = sorted({w for t in texts for w in (t or "").split()})
    terms = spark.createDataFrame([(t,) for t in [*known, None, known[0]]], "term string")
    for name, bound in (("PIECE_TERMS", 30), ("HELD_PAIRS", 20), ("SENT_PAIRS", 3)):
        monkeypatch.setattr(learned, name, bound)
    got = learned.pair_counts(frame(spark, texts).repartition(2), terms).collect()
    assert {(r["first"], r["second"]): r["n"] for r in got} == dict(plain_pairs(texts, set(known), learned.WINDOW))
    assert len({(r["first"], r["second"]) for r in got}) == len(got)


def test_no_term_is_cut_off(spark):
    texts = [" ".join(f"w{i + k}" for i in range(1000)) for k in range(0, 70_000, 1000)] * 3
    docs = frame(spark, [*texts, "once and again"])
    terms = learned.vocabulary(docs)
    assert terms.count() == 70_000
    got = {(r["first"], r["second"]): r["n"] for r in learned.pair_counts(docs, terms).collect()}
    assert got == dict(plain_pairs(texts, {f"w{i}" for i in range(70_000)}, learned.WINDOW))


def test_terms_that_are_not_shared_are_counted_by_name(spark, monkeypatch):
    texts = corpus(6, 90)
    docs = frame(spark, texts).repartition(3)
    counts = collections.Counter(w for t in texts for w in learned.re.findall("[a-z0-9]+", (t or "").lower()))
    known = {t for t in counts if counts[t] >= 3}
    for shared, piece in ((1, 1 << 18), (5, 30), (len(known), 30)):
        monkeypatch.setattr(learned, "SHARED_TERMS", shared)
        monkeypatch.setattr(learned, "PIECE_TERMS", piece)
        got = learned.pair_counts(docs, learned.vocabulary(docs)).collect()
        assert {(r["first"], r["second"]): r["n"] for r in got} == dict(plain_pairs(texts, known, learned.WINDOW))
        assert len({(r["first"], r["second"]) for r in got}) == len(got)


def test_entries_are_read_in_pieces_of_rows(spark):
    matrix = np.random.default_rng(5).standard_normal((40, 40))
    rows = [(i, j, float(matrix[i, j])) for i in range(40) for j in range(40) if i % 7]
    entries = spark.createDataFrame(rows, "i int, j int, value double").repartition(3, "i").sortWithinPartitions("i", "j")
    packed = learned._packed(entries)
    assert packed.count() < len(rows) / 20  # a piece holds a run of one row's entries
    tall = np.random.default_rng(6).standard_normal((40, 3))
    expected = np.where(np.arange(40)[:, None] % 7 > 0, matrix, 0) @ tall
    assert np.allclose(learned._packed_product(packed, tall), expected) and np.allclose(learned.product(entries, tall), expected)


def test_vectors_are_loaded_where_the_package_is_not(spark):
    import pickletools

    docs = frame(spark, ["a b"])
    shared = learned.loader(docs, learned.TermVectors(["a"], np.ones((1, 2), np.float32), np.ones(1, np.float32))).__closure__[0].cell_contents
    with open(shared._path, "rb") as f:
        assert not any("pageloom" in str(arg) for _, arg, _ in pickletools.genops(f.read()))
