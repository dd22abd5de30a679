"""Operators against brute force on small fixtures."""

import collections
import hashlib
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.functions import html as hx
from pageloom.functions import urls
from pageloom.operators import cells, chunking, crawl, embedding, knn, sampling, scores, summarize
from pageloom.operators import sentences as st
from pageloom.operators.collections import Collection, packed_id, with_dense_ids
from pageloom.operators.lookup import KeyedTable
from pageloom.registry import queries as registered
from pageloom.sources import results, tables


def walk(counts, size):
    """Chunk number per sentence, one by one."""
    numbers, held, chunk = [], 0, 0
    for n in counts:
        if held + n + 2 > size:
            chunk += held > 0
            held = 0
        held += n
        numbers.append(chunk)
    return numbers


def test_packing_example():
    assert walk([10, 20, 30, 60, 5, 5, 40], 50) == [0, 0, 1, 2, 3, 3, 4]
    assert chunking.pack(np.array([10, 20, 30, 60, 5, 5, 40]), 50)[0].tolist() == [0, 0, 1, 2, 3, 3, 4]


@pytest.mark.parametrize("size", [0, 2, 900, 1000])
def test_chunk_size_guard(spark, size):
    frame = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    with pytest.raises(ValueError):
        chunking.chunk_documents(frame, size, ["doc_id"])


def test_sentence_rows_equal_one_pass(spark):
    rng = random.Random(3)
    docs = {d: [rng.choice([0, 1, 3, 9, 20, 60]) for _ in range(rng.choice([1, 7, 40, 333]))] for d in range(12)}
    docs[99] = [60, 0, 0, 60]
    rows = [(d, i, n, f"s{i}") for d, ns in docs.items() for i, n in enumerate(ns)]
    frame = spark.createDataFrame(rows, "doc long, ord int, n int, s string")
    expected = {(d, i): c for d, ns in docs.items() for i, c in enumerate(walk(ns, 50))}
    for block_rows in (10, 50, 1000):
        done = chunking.chunk_sentence_rows(frame, 50, "doc", "ord", "n", block_rows).collect()
        assert {(r["doc"], r["ord"]): r["chunk_no"] for r in done} == expected
        assert len(done) == len(rows)


def test_document_chunks_keep_every_sentence(spark):
    texts = [(1, "One two. Three four five. Six? Seven eight nine ten."), (2, ""), (3, None), (4, "word " * 60 + ". End")]
    frame = spark.createDataFrame(texts, "doc_id int, text string")
    done = chunking.chunk_documents(frame, 8, ["doc_id"]).orderBy("doc_id", "chunk_no").collect()
    by_doc = collections.defaultdict(list)
    for r in done:
        by_doc[r["doc_id"]].append(r)
    assert [c["sentences"] for c in by_doc[1]] == [["One two.", "Three four five.", "Six?"], ["Seven eight nine ten."]]
    assert set(by_doc) == {1, 4}
    assert [c["n_tokens"] for c in by_doc[4]] == [61, 1]
    sized = chunking.chunk_documents_by_size(frame, [8, 20], ["doc_id"]).filter("chunk_size = 8").drop("chunk_size")
    assert sized.orderBy("doc_id", "chunk_no").collect() == done


def test_first_occurrences(spark):
    rows = [("k", 2, 0, "a"), ("k", 1, 5, "a"), ("k", 1, 2, "b"), ("m", 9, 9, "a")]
    frame = spark.createDataFrame(rows, "k string, page int, pos int, sentence string")
    done = st.first_occurrences(frame, ["k"], ["page", "pos"]).collect()
    assert {tuple(r) for r in done} == {("k", "a", 1, 5), ("k", "b", 1, 2), ("m", "a", 9, 9)}


def plain_crawl(seed, html, keywords=urls.LINK_KEYWORDS):
    """Depth-first walk in link order over {url: [dst]}; pages that are missing are leaves."""
    order, seen = [], set()

    def visit(url):
        seen.add(url)
        order.append(url)
        host, path = url.split("/")[2], "/" + "/".join(url.split("/")[3:])
        for dst in html.get(url, []):
            d_host, d_path = dst.split("/")[2], "/" + "/".join(dst.split("/")[3:])
            if any(k in dst for k in keywords) and d_host == host and d_path.startswith(path.rstrip("/")) and dst not in seen:
                visit(dst)

    visit(seed)
    return order


def test_traversal_order_equals_depth_first(spark):
    rng = random.Random(11)
    nodes = ["https://s.org/Model"]
    for i in range(1, 60):
        nodes.append(f"{rng.choice(nodes)}/{rng.choice(['Design', 'Results', 'x'])}{i}")
    graph = {}
    for url in nodes:
        below = [n for n in nodes if n.startswith(url)]
        links = [rng.choice(below) for _ in range(3)] + [rng.choice(nodes), "https://other.org/Model/Design1"]
        rng.shuffle(links)
        graph[url] = links
    missing = set(rng.sample(nodes[1:], 8))
    stored = [(i, u, "".join(f'<p>Page {i}.</p><a href="{d}#z">l</a>' for d in graph[u])) for i, u in enumerate(nodes) if u not in missing]
    pages = tables.keyed_pages(spark.createDataFrame(stored, "page_id long, url string, html string"))
    seeds = spark.createDataFrame([(n, "http://www." + u[8:] + "/") for n, u in enumerate(nodes[:20])], "seed int, url string")
    reached = crawl.reachable_pages(seeds, crawl.followed_links(crawl.page_links(pages))).collect()
    found = collections.defaultdict(list)
    for r in sorted(reached, key=lambda r: (r["seed"], list(r["route"]))):
        found[r["seed"]].append(r["page_url"])
    usable = {u: graph[u] for u in nodes if u not in missing}
    assert dict(found) == {n: plain_crawl(u, usable) for n, u in enumerate(nodes[:20])}


def test_traversal_of_a_cycle_ends(spark):
    rows = [(1, "https://Model.org", '<a href="/">a</a><a href="/Model">b</a>'), (2, "https://Model.org/", '<a href="">a</a><a href="/Design">c</a>')]
    pages = tables.keyed_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    seeds = spark.createDataFrame([("s", "https://Model.org")], "seed string, url string")
    links = crawl.followed_links(crawl.page_links(pages))
    reached = {tuple(r["route"]): r["page_url"] for r in crawl.reachable_pages(seeds, links).collect()}
    assert [reached[k] for k in sorted(reached)] == ["https://Model.org", "https://Model.org/", "https://Model.org/Design", "https://Model.org/Model"]
    with pytest.raises(RuntimeError):
        crawl.reachable_pages(seeds, links, max_rounds=1)


def test_crawled_text_drops_later_copies(spark):
    rows = [
        (1, "http://s.org/Model", '<p>Same one. First.</p><a href="/Model/Design">d</a><a href="/Model/gone">g</a>'),
        (2, "https://www.s.org/Model/Design/", "<p>Same one. Second é [1].</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("p", "https://s.org/Model/")], "seed string, url string")
    done = crawl.crawl_site_text(seeds, pages).collect()
    assert [tuple(r) for r in done] == [("p", "Same one. First. dg Second.")]


def brute(queries, vectors, k, keep=lambda q, v: True):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    score = np.round(unit(queries) @ unit(vectors).T, 9) + 0.0
    score[:, np.linalg.norm(vectors, axis=1) == 0] = -2
    out = {}
    for q in range(len(queries)):
        ids = [i for i in range(len(vectors)) if keep(q, i)]
        best = sorted(ids, key=lambda i: (-score[q, i], i))[:k]
        out[q] = [(i, None if score[q, i] == -2 else score[q, i]) for i in best]
    return out


@pytest.fixture(scope="module")
def vector_set():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    vectors[100:200] = vectors[7]  # a third of all rows are copies
    vectors[250] = 0
    return vectors


def frame_of(spark, vectors, name):
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, vector array<double>, part int")


def ranked(hits):
    out = collections.defaultdict(list)
    for r in sorted(hits.collect(), key=lambda r: (r["qid"], r["rank"])):
        out[r["qid"]].append((r["id"], r["score"]))
    return dict(out)


def same(found, expected):
    assert found.keys() == expected.keys()
    for q in expected:
        assert [i for i, _ in found[q]] == [i for i, _ in expected[q]]
        assert all(a == b or math.isclose(a, b, abs_tol=1e-8) for (_, a), (_, b) in zip(found[q], expected[q]) if b is not None)


@pytest.mark.parametrize("few", [4096, 5])
def test_nearest_equals_brute_force(spark, vector_set, few, monkeypatch):
    monkeypatch.setattr(knn, "MAX_BLOCK_ROWS", 48)
    queries = vector_set[:40]
    hits = knn.nearest(frame_of(spark, queries, "qid"), frame_of(spark, vector_set, "id").repartition(5), 8, 10, max_broadcast_queries=few)
    same(ranked(hits), brute(queries, vector_set, 10))


@pytest.mark.parametrize("few", [4096, 5])
def test_nearest_within_parts(spark, vector_set, few):
    queries = vector_set[:40]
    hits = knn.nearest(frame_of(spark, queries, "qid"), frame_of(spark, vector_set, "id"), 8, 4, "part", few)
    same(ranked(hits), brute(queries, vector_set, 4, lambda q, i: q % 3 == i % 3))


def test_zero_vectors_rank_last(spark):
    vectors = np.array([[0.0, 0], [1, 0], [-1, 0]])
    hits = ranked(knn.nearest(frame_of(spark, vectors[1:2], "qid"), frame_of(spark, vectors, "id"), 2, 3))
    assert hits == {0: [(1, 1.0), (2, -1.0), (0, None)]}


def test_cells(spark, vector_set):
    rows = frame_of(spark, vector_set, "id").select("id", "vector")
    centroids = cells.train_centroids(rows, 12)
    assigned = cells.assign_cells(rows, centroids).persist()
    queries = frame_of(spark, vector_set[:40], "qid")
    same(ranked(cells.search(queries, assigned, centroids, 8, 10, 12)), brute(vector_set[:40], vector_set, 10))
    few, more = (cells.quality(queries, assigned, centroids, 8, 10, n).first() for n in (2, 6))
    assert few["n_true"] == more["n_true"] == 400 and 0.2 < few["recall"] <= more["recall"] <= 1
    assert few["share"] < more["share"] < 1 and few["candidates"] == round(few["share"] * 40 * len(vector_set))


def test_cells_find_nine_in_ten(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the test tables")
    queries, rows = registered._self_search(spark, "/root/testdata/sf0.001")
    centroids = cells.train_centroids(rows, 16)
    assigned = cells.assign_cells(rows.select("id", "vector"), centroids).persist()
    made = cells.quality(queries, assigned, centroids, registered.DIM).first()
    assert made["recall"] >= 0.9 and made["share"] <= 0.7 and made["incomplete"] == 0


def test_blocks_are_square(spark):
    assert knn.block_rows(64) == 65536 and knn.block_rows(1536) == 2730 and knn.block_rows(10**9) == 1
    rng = np.random.default_rng(0)
    queries, rows = frame_of(spark, rng.random((50, 4)), "qid"), frame_of(spark, rng.random((100, 4)), "id")
    label = F.lit(None).cast("string").alias("part")
    plan = knn._blocks(queries.select(label, "qid", "vector"), rows.select(label, "id", "vector"), 3, 10)
    assert plan.count() == 50 * 3 * 10  # each of 5 x 10 pairs of blocks keeps 3 hits for each of its 10 queries, about


def test_pooling(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [9.0, 9.0], 0), (2, [5.0, 5.0], 0)]
    frame = spark.createDataFrame(rows, "chunk int, vec array<double>, mask int")
    done = {r["chunk"]: r["vector"] for r in embedding.pooled_vectors(frame, ["chunk"], "vec", "mask", 2).collect()}
    assert done == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_hashed_embedding(spark):
    import hashlib

    def plain(text, dim):
        terms, out = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split(), np.zeros(dim)
        for t in terms:
            h = hashlib.md5(t.encode()).hexdigest()
            out[int(h[:8], 16) % dim] += 1 if h[8] < "8" else -1
        return (out / max(1, len(terms))).astype(np.float32).tolist()

    texts = ["the cat, the dog", "", "A1 b2", "x " * 50]
    frame = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    done = frame.select("i", embedding.hashed_embedding(F.col("t"), 16).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in done] == [plain(t, 16) for t in [*texts, ""]]
    cut = frame.select(embedding.hashed_embedding(F.col("t"), 16, 1).alias("v")).first()["v"]
    assert cut == plain("the", 16)


def test_model_is_loaded_per_task(spark):
    frame = spark.createDataFrame([(1, "ab"), (2, "abcd")], "i int, t string")
    load = lambda: (lambda texts: np.array([[len(t), 1.0] for t in texts]))
    done = embedding.embed_with_model(frame, load, "t").orderBy("i").collect()
    assert [r["vector"] for r in done] == [[2.0, 1.0], [4.0, 1.0]]


def test_summaries(spark):
    rows = [
        (1, ["Alpha beta gamma.", "Alpha alpha alpha.", "Delta."]),
        (2, ["..."]), (3, []), (4, ["Only one sentence here."]),
    ]
    frame = spark.createDataFrame(rows, "id int, sentences array<string>")
    done = {r["id"]: r["summary"] for r in summarize.summarize_chunks(frame, ["id"]).collect()}
    assert done == {1: "Alpha alpha alpha.", 2: " ", 3: " ", 4: "Only one sentence here."}


def test_dense_ids(spark):
    frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    rows = with_dense_ids(frame.repartition(9), ["k"]).collect()
    assert sorted((r["id"], r["k"]) for r in rows) == [(i, i) for i in range(1000)]


def test_packed_ids(spark):
    frame = spark.createDataFrame([(5, 3)], "d long, c int")
    assert frame.select(packed_id(F.col("d"), F.col("c"))).first()[0] == 5 * 2**24 + 3
    with pytest.raises(Exception, match="out of range"):
        frame.select(packed_id(F.col("d") - 6, F.col("c"))).collect()


def points(spark, ids, text):
    rows = [(i, [float(i), 1.0], (f"{text}{i}",)) for i in ids]
    return spark.createDataFrame(rows, "id long, vector array<float>, payload struct<Wiki_content: string>")


def stored(collection):
    return {r["id"]: r["payload"]["Wiki_content"] for r in collection.points().collect()}


def test_collection_life(spark, tmp_path):
    made = Collection(spark, str(tmp_path), "c")
    assert not made.exists() and not made.is_populated()
    made.create(2)
    with pytest.raises(ValueError):
        made.create(2)
    assert made.exists() and not made.is_populated() and made.count() == 0
    made.upsert(points(spark, range(10), "old"))
    made.upsert(points(spark, [3, 4, 12], "new"))
    expected = {i: f"old{i}" for i in range(10)} | {i: f"new{i}" for i in (3, 4, 12)}
    assert stored(made) == expected and made.count() == 11 and made.is_populated()
    made.upsert(points(spark, [3, 4, 12], "new"))
    assert stored(made) == expected
    made.replace(points(spark, [1, 2], "last"), 2)
    assert stored(made) == {1: "last1", 2: "last2"}
    with pytest.raises(Exception, match="length 3"):
        made.replace(points(spark, [1], "x"), 3)


def test_upsert_takes_the_latest_version(spark, tmp_path):
    made = Collection(spark, str(tmp_path), "c")
    made.create(2)
    rows = points(spark, [1], "a").withColumn("at", F.lit(1)).union(points(spark, [1], "b").withColumn("at", F.lit(2)))
    made.upsert(rows, latest_by="at")
    assert stored(made) == {1: "b1"}


def test_repeated_ids_in_a_batch_are_stored_once(spark, tmp_path):
    made = Collection(spark, str(tmp_path), "c")
    made.create(2)
    rows = points(spark, [1, 2], "a").union(points(spark, [1, 1], "b"))
    made.upsert(rows)
    first = stored(made)
    assert made.count() == 2 and made.points().count() == 2
    made.upsert(rows)
    assert stored(made) == first


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    made = Collection(spark, str(tmp_path), "c")
    made.create(2)
    made.upsert(points(spark, range(5), "old"))
    before = stored(made)
    # the batch is written, its list is not; then the list is there in part
    points(spark, range(3), "lost").write.parquet(made._version(1))
    assert stored(made) == before
    (tmp_path / "published" / "collection=c" / "1" / "_temporary").mkdir(parents=True)
    assert stored(made) == before
    made.upsert(points(spark, [4, 9], "new"))
    assert stored(made) == before | {4: "new4", 9: "new9"} and made.versions() == [0, 1]


def test_compaction(spark, tmp_path):
    made = Collection(spark, str(tmp_path), "c")
    made.create(2)
    for n in range(5):
        made.upsert(points(spark, [n, n + 1], f"v{n}-"), compact_after=3)
    assert stored(made) == {i: f"v{i}-{i}" for i in range(5)} | {5: "v4-5"} and len(made.versions()) <= 3
    reader = made.points()
    made.compact()
    assert made.versions() == [made._changes()[-1]] and stored(made) == {r["id"]: r["payload"]["Wiki_content"] for r in reader.collect()}


def test_small_upserts_write_in_proportion_to_themselves(spark, tmp_path):
    made = Collection(spark, str(tmp_path), "c")
    made.create(2)
    made.upsert(points(spark, range(3000), "old"))
    expected, written = {i: f"old{i}" for i in range(3000)}, {}
    for n in range(14):
        ids = [n, n + 1, 5000 + n]
        made.upsert(points(spark, ids, f"v{n}-"), compact_after=2)
        expected |= {i: f"v{n}-{i}" for i in ids}
        written |= {t.version: t.n_rows for t in made.tiers()}
    del written[0]
    # each row is written once and then once per size class; the base lies where it lay
    assert sum(written.values()) <= 14 * 3 * 4 and made.versions()[0] == 0 and max(written.values()) <= 42
    assert len(made.tiers()) <= 1 + 2 * 3
    assert stored(made) == expected
    made.compact()
    assert stored(made) == expected and len(made.tiers()) == 1 and made.tiers()[0].n_rows == len(expected)


def test_newer_rows_are_told_by_ids_alone(spark, tmp_path):
    """No aggregation and no exchange sees a vector or a payload."""
    made = Collection(spark, str(tmp_path), "c")
    made.create(2)
    for n in range(4):
        made.upsert(points(spark, range(n, 50), f"v{n}-"))
    plan = made.points()._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("\n") if "Aggregate" in line or "Exchange" in line]
    assert len(made.tiers()) == 4 and lines and not any("payload" in line or "vector" in line for line in lines)


def test_a_replayed_batch_is_not_stored_again(spark, tmp_path):
    made = Collection(spark, str(tmp_path), "c")
    made.create(2)
    assert made.upsert(points(spark, [1, 2], "a"), batch=("stream", 0))
    assert made.upsert(points(spark, [2], "b"), batch=("stream", 1)) and made.upsert(points(spark, [7], "x"), batch=("other", 0))
    before = made._changes(), made.versions()
    assert not made.upsert(points(spark, [2], "again"), batch=("stream", 1)) and not made.upsert(points(spark, [1], "again"), batch=("stream", 0))
    assert (made._changes(), made.versions()) == before and stored(made) == {1: "a1", 2: "b2", 7: "x7"}
    made.compact()
    assert not made.upsert(points(spark, [2], "again"), batch=("stream", 1)) and made.upsert(points(spark, [2], "c"), batch=("stream", 2))
    assert stored(made) == {1: "a1", 2: "c2", 7: "x7"}


def test_a_declared_collection_reads_as_empty(spark, tmp_path):
    made = Collection(spark, str(tmp_path), "c")
    made.create(2)
    assert made.points().count() == 0 and "Wiki_content" in made.points().schema["payload"].dataType.names


def test_samples(spark):
    frame = spark.range(100).select("id", (F.col("id") % 4).alias("g"))
    one, two = ([r["id"] for r in sampling.sample_rows(frame.repartition(n), 7, "id", 1).collect()] for n in (2, 5))
    assert sorted(one) == sorted(two) and len(set(one)) == 7
    assert sampling.sample_rows(frame, 500, "id").count() == 100
    assert [r["count"] for r in sampling.sample_rows(frame, 3, "id", per=["g"]).groupBy("g").count().collect()] == [3] * 4


SCORED = "settings string, question string, test_settings string, eval_score int"


def config(name):
    return f"RAGConfig(dataset=d, chunk_size=200, embedding_model_name={name}"


def test_best_configuration(spark):
    rows = [("b", "q1", config("gan"), 5), ("b", "q2", config("gan"), 0), ("a", "q1", config("mini"), 5), ("a", "q2", config("mini"), 5), ("c", "q", config("x"), 1), ("d", "q", config("y"), None)]
    frame = spark.createDataFrame(rows, SCORED)
    assert [tuple(r) for r in scores.best_configuration(frame).collect()] == [("d", 200, "mini", 1.0)]
    assert [(r["settings"], r["avg_score"]) for r in scores.average_scores(frame).collect()] == [("c", 0.0), ("a", 1.0), ("b", 1.0), ("d", None)]


def test_no_configuration_gives_the_default(spark):
    none = spark.createDataFrame([], SCORED)
    ungraded = spark.createDataFrame([("a", "q", config("m"), 0)], SCORED)
    missing = spark.createDataFrame([("a", "q")], "settings string, question string")
    for frame in (none, ungraded, missing):
        assert scores.best_configuration(frame).count() == 0
        chosen = scores.chosen_configuration(scores.best_configuration(frame)).first()
        assert tuple(chosen) == (250, "sentence-transformers/all-MiniLM-L6-v2", True)


def test_score_intervals(spark):
    rng = random.Random(5)
    rows = [(f"s{k}", f"q{i}", rng.choice([None, 0, 1, 2, 3, 4, 5])) for k in range(3) for i in range(30) for _ in range(rng.randint(0, 2))]
    rows += [("s0", None, 4), ("none", "q1", 0), ("none", "q2", None)]
    n = 37

    def weight(unit, r):
        draw = int(hashlib.sha256(f"7#{r // 8}#{unit or ''}".encode()).hexdigest()[r % 8 * 8:][:8], 16)
        total, term, k = 0.0, math.exp(-1), 0  # the Poisson(1) quantile of the draw
        while draw / 16**8 >= (total := total + term):
            k += 1
            term /= k
        return k

    means, wins = {}, collections.Counter()
    for r in range(n):
        for name in ("s0", "s1", "s2"):
            scored = [(weight(u, r), (s - 1) / 4) for k, u, s in rows if k == name and s and u is not None]
            scored += [(weight(None, r), (s - 1) / 4) for k, u, s in rows if k == name and s and u is None]
            means.setdefault(name, []).append(sum(w * s for w, s in scored) / sum(w for w, _ in scored))
        wins[max(means, key=lambda k: (means[k][r], [-ord(c) for c in k]))] += 1
    frame = spark.createDataFrame(rows, "settings string, question string, eval_score int").withColumns({"weight": F.lit("clash"), "replicate": F.lit(1)})
    done = {r["settings"]: r for r in scores.score_intervals(frame, n_replicates=n, seed=7, level=0.8).collect()}
    assert set(done) == {"s0", "s1", "s2", "none"}
    assert (done["none"]["n_scored"], done["none"]["low"], done["none"]["win_share"]) == (0, None, 0.0)
    for k, m in means.items():
        assert np.allclose([done[k]["low"], done[k]["high"]], np.quantile(m, [0.1, 0.9]))
        assert done[k]["win_share"] == wins[k] / n and done[k]["low"] <= done[k]["avg_score"] <= done[k]["high"]
    again = {r["settings"]: r for r in scores.score_intervals(frame.repartition(3, "question"), n_replicates=n, seed=7, level=0.8).collect()}
    assert again == done
    assert scores.score_intervals(frame.limit(0)).count() == 0


def test_poisson_steps():
    total, term = 0.0, math.exp(-1)
    for k, step in enumerate(scores.POISSON_STEPS):
        total += term
        term /= k + 1
        assert step == math.ceil(total * 16**8)


def test_retrieval_quality(spark):
    rows = [("c", "x", ["x", "y"]), ("c", "y", ["x", "y"]), ("c", "z", ["x", "y"]), ("c", "w", None)]
    frame = spark.createDataFrame(rows, "config string, qa_context string, retrieved_texts array<string>")
    done = scores.retrieval_quality(frame, ["config"]).first()
    assert (done["n_questions"], done["hit_rate"], done["mrr"]) == (4, 0.5, 0.375)


def test_result_arrays(spark, tmp_path):
    folder = tmp_path / "chunk_size=200" / "embedding_model=hub%2Fm"
    folder.mkdir(parents=True)
    (folder / "part.json").write_text('[\n {"question": "q1", "eval_score": 4, "qa_meta": {"Year": 2019}, "qdrant_context": [{"Wiki_content": "c"}]},\n {"question": "q2"}\n]')
    rows = results.read_result_arrays(spark, str(tmp_path)).orderBy("question").collect()
    assert [(r["question"], r["eval_score"]) for r in rows] == [("q1", 4), ("q2", None)]
    assert rows[0]["retrieved"][0]["Wiki_content"] == "c"
    assert rows[0]["qa_meta"]["Year"] == 2019 and "chunk_size=200" in rows[0]["settings"]


def test_result_partitions_keep_model_names(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("q", 200, "hub/m:1"), ("q", 300, "hub/n")], "question string, chunk_size int, embedding_model string")
    results.write_results(rows, path)
    results.write_results(rows.filter("chunk_size = 300").withColumn("question", F.lit("z")), path)
    done = results.read_results(spark, path).orderBy("chunk_size").collect()
    assert [(r["question"], r["embedding_model"]) for r in done] == [("q", "hub/m:1"), ("z", "hub/n")]


def test_project_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Extra,Wiki,Year,Abstract\n1,http://a,2019,"two\nlines ""quoted"", yes"\n2,http://b,n/a,x\n3,http://c,2018,\n')
    rows = tables.read_projects(spark, str(tmp_path))
    assert [r["Year"] for r in rows.orderBy("Wiki").collect()] == [2019, None, 2018]
    kept = tables.of_year(rows).collect()
    assert [(r["Wiki"], r["Abstract"], r["Medal"]) for r in kept] == [("http://a", 'two\nlines "quoted", yes', None)]


def test_stage_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = spark.range(1).schema
    assert tables.read_or_empty(spark, path, schema).count() == 0
    assert tables.materialize_once(spark, path, lambda: spark.range(3)).count() == 3
    assert tables.materialize_once(spark, path, lambda: spark.range(9)).count() == 3
    assert tables.read_or_empty(spark, path, schema).count() == 3


def test_pages_of_one_url(spark):
    rows = [(4, "http://www.a.org/x/", "late"), (2, "https://a.org/x", "early"), (3, "https://a.org/y", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r["page_url"], r["html"]) for r in tables.keyed_pages(pages).collect()} == {("https://a.org/x", "early"), ("https://a.org/y", "y")}


def test_explode_computes_the_array_once(spark):
    frame = spark.createDataFrame([(1, "A b. C d.")], "i int, text string")
    plan = st.explode_sentences(frame, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    assert hx.html_text(F.col("text")) is not None


def test_copies_of_a_page_are_one(spark):
    from pageloom.sources.tables import keyed_pages

    rows = [(1, "https://s.org/a", "one"), (1, "http://www.s.org/a/", "one"), (1, "https://s.org/a", "other"), (2, "https://s.org/a", "two"), (3, "https://s.org/b", "b"), (3, "https://s.org/b", "b")]
    got = keyed_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_url"], r["page_id"]) for r in got) == [("https://s.org/a", 1), ("https://s.org/b", 3)]


def test_topk_equals_double_precision():
    """Copies, ties, vectors without direction and near ties, in several batches, as a plain search in double precision ranks them."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 16))
    base[::50] = 0
    near = np.concatenate([base, np.repeat(base[:40], 60, axis=0), base[:300] * 3 + rng.normal(size=(300, 16)) * 1e-8, np.ones((2500, 16))])
    ids, queries = rng.permutation(len(near)), near[rng.permutation(len(near))[:1100]]
    best = knn.TopK(np.arange(len(queries)), queries, 10)
    for part in np.array_split(np.arange(len(near)), 3):
        best.add(ids[part], near[part])
    found = best.hits(None).to_pydict()
    got = collections.defaultdict(list)
    for q, i, s in zip(found["qid"], found["id"], found["score"]):
        got[q].append((-2.0 if s is None else s, i))
    a, none = knn.unit_rows(queries)
    b, zero = knn.unit_rows(near)
    scores = np.round(a @ b.T, 9) + 0.0
    scores[:, zero], scores[none] = -2, -2
    for q in range(len(queries)):
        order = np.lexsort((ids, -scores[q]))[:10]
        listed = sorted(got[q], key=lambda r: (-r[0], r[1]))
        assert [i for _, i in listed] == ids[order].tolist() and np.allclose([s for s, _ in listed], scores[q, order], atol=2e-9)


def test_a_bound_changes_no_hit(spark, monkeypatch):
    """Copies, ties, vectors without direction, queries that come twice, and parts too small for a bound."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(500, 6)).round(1)
    base[::40] = 0
    near = np.concatenate([base, np.repeat(base[:6], 40, axis=0)])
    vectors = spark.createDataFrame([(i, v.tolist(), ["a", "b", None][i % 3] if i % 97 else "c") for i, v in enumerate(near)], "id long, vector array<double>, part string")
    queries = vectors.limit(150).select(F.col("id").alias("qid"), "vector", "part")
    queries = queries.unionByName(queries.filter("qid % 9 = 0").withColumn("vector", F.reverse("vector")))
    monkeypatch.setattr(knn, "MIN_BLOCK_ROWS", 20)
    plain = lambda: [sorted((str(r) for r in knn.nearest(queries, vectors, 6, 7, part, 10).collect())) for part in (None, "part")]
    expected = plain()
    monkeypatch.setattr(knn, "BOUNDED_PAIRS", 1)
    for share in (4, 30):
        monkeypatch.setattr(knn, "BOUND_SHARE", share)
        assert plain() == expected


def test_a_bound_keeps_what_is_below_it_out_of_the_blocks(spark, monkeypatch):
    rows = frame_of(spark, np.random.default_rng(2).normal(size=(3000, 8)), "id")
    label = F.lit(None).cast("string").alias("part")
    monkeypatch.setattr(knn, "MIN_BLOCK_ROWS", 100)
    sent = lambda: knn._blocks(rows.limit(400).select(label, F.col("id").alias("qid"), "vector"), rows.select(label, "id", "vector"), 10, 100).count()
    whole = sent()
    monkeypatch.setattr(knn, "BOUNDED_PAIRS", 1)
    monkeypatch.setattr(knn, "BOUND_SHARE", 4)
    assert whole == 400 * 10 * 30 and sent() < whole / 5


def test_blocks_follow_the_counts(spark, monkeypatch):
    """A part of two thousand on either side is more than one pair of blocks, and what makes either side runs once in the search."""
    monkeypatch.setattr(knn, "MIN_BLOCK_ROWS", 100)
    rows = frame_of(spark, np.random.default_rng(0).random((2000, 4)), "id")
    label = F.lit(None).cast("string").alias("part")
    queries = rows.select(label, F.col("id").alias("qid"), "vector")
    found = knn._blocks(queries, rows.select(label, "id", "vector"), 3, knn.block_rows(4))
    assert found.count() == 2000 * 3 * math.ceil(2000 / math.ceil(2000 / 16))


def test_attach_searches_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    hits = spark.range(20).select("id", F.col("id").alias("qid")).coalesce(1).mapInArrow(note, "id bigint, qid bigint")
    stored = KeyedTable(spark, str(tmp_path / "t")).write(spark.range(10).withColumn("text", F.lit("x")))
    assert stored.attach(hits, ["text"], max_listed=0, max_broadcast=0).count() == 10 and seen.value == 20


def test_cleaning_steps_apply_each_rule_once(spark, tmp_path):
    spark.createDataFrame([(1, "a 2.5 mg b"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    steps = registered.cleaning_steps(spark, str(tmp_path))
    assert steps._jdf.queryExecution().optimizedPlan().toString().count(r"\s*mg\b") == 1
    assert steps.filter("digest IS NULL").count() == steps.count() / 2 == len(registered.tx.CLEANING_RULES)


def test_evaluation_stores_no_metadata(spark, tmp_path):
    """Chunks and points name their rows of the dataset; an abstract is not stored with every chunk."""
    rows = [(i % 3, "lang", "source", " ".join(f"Sentence {i} {j} says some words." for j in range(200)), 9) for i in range(6)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    _, points, _, dataset = registered._grid(spark, str(tmp_path))
    assert points.schema["payload"].dataType.names == ["Wiki_content", "row"]
    assert dataset.count() == 6 and points.select("payload.row").distinct().count() == 6


def test_pooling_is_bounded(monkeypatch):
    digests = ["0123456789abcdef01"[:9 * (i % 3)] for i in range(10)] + ["89abcdef0" * 40, "", "00000001f"]
    batch = pa.array(digests).slice(1)
    whole = embedding._pooled_batch(batch, 8).to_pylist()
    seen, pooled = [], embedding._pooled
    monkeypatch.setattr(embedding, "POOLED_TERMS", 4)
    monkeypatch.setattr(embedding, "_pooled", lambda text, sizes, dim: seen.append(sizes.tolist()) or pooled(text, sizes, dim))
    assert embedding._pooled_batch(batch, 8).to_pylist() == whole and len(whole) == 12
    assert all(sum(sizes) <= 4 or len(sizes) == 1 for sizes in seen) and sum(map(len, seen)) == 12


def test_stream_files_are_bounded(spark, tmp_path, monkeypatch):
    """Whatever the number of documents, a file of the stream is bounded, and three batches take them all."""
    rows = [(i, "en", "s", f"Some words of document {i}. And more.", 9) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(registered, "ROWS_PER_FILE", 6)
    read, wanted = registered.jobs.read_files, []
    monkeypatch.setattr(registered.jobs, "read_files", lambda *a, **k: wanted.append((a[1], k["files_per_batch"])) or read(*a, **k))
    assert registered.stream_ingest(spark, str(tmp_path)).count() == 60
    assert wanted[0][1] == 4 and len([f for f in os.listdir(wanted[0][0]) if f.endswith(".parquet")]) == 12


def test_spread_points_are_the_same(spark):
    from pageloom.plans import index
    from pageloom.schemas import METADATA_FIELDS

    long = " ".join(f"Sentence {i} says words {i % 7} and more." for i in range(300))
    row = lambda i, text: {c: f"{c}{i}" for c in METADATA_FIELDS} | {"pid": i, "Wiki_content": text}
    rows = [row(0, long), row(1, "One. Two."), row(1, "One. Two."), row(2, None), row(3, "")]
    frame = spark.createDataFrame(rows, ", ".join([*[f"{c} string" for c in METADATA_FIELDS], "pid long", "Wiki_content string"]))
    made = [index.build_points(frame, "pid", 30, index.hashed_model(dim=8), packed_id, spread=s) for s in (False, True)]
    assert sorted(made[0].collect()) == sorted(made[1].collect())
    # a long text's chunks are in several tasks
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        places = made[1].withColumn("p", F.spark_partition_id()).agg(F.countDistinct("p")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert places > 1
