"""Whole jobs: dataset, index, answers, evaluation, streams."""

from pyspark.sql import functions as F

from pageloom.operators.collections import Collection, packed_id
from pageloom.plans import answer, dataset, evaluation, index, report
from pageloom.schemas import METADATA, METADATA_FIELDS
from pageloom.streaming import jobs
from pageloom.streaming import questions as seen


def projects(spark):
    values = [
        (1, 2019, "Team A", "http://www.s.org/Model/", "Abs [1]."),
        (2, 2019, "Team B", "http://gone.org/", None),
        (3, 2018, "Team C", "http://www.s.org/Model/", "Old."),
        (4, 2019, "Team D", None, "No site."),
    ]
    frame = spark.createDataFrame(values, "pid long, Year int, Team_Name string, Wiki string, Abstract string")
    rest = [F.lit(None).cast("string").alias(f) for f in METADATA_FIELDS if f not in frame.columns]
    return frame.select("*", *rest)


def pages(spark):
    rows = [
        (1, "https://s.org/Model", "<p>Enzymes degrade plastic. They are fast.</p><a href='Model/Results'>r</a>"),
        (2, "https://s.org/Model/Results", "<p>Yeast glows green. They are fast.</p>"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_prepared_dataset(spark):
    rows = {r["pid"]: r for r in dataset.prepare_dataset(projects(spark), pages(spark)).collect()}
    assert set(rows) == {1, 2, 4}
    assert rows[1]["Abstract"] == "Abs."
    assert rows[1]["Wiki_content"].startswith("Enzymes degrade plastic. They are fast.") and "Yeast glows green." in rows[1]["Wiki_content"]
    assert rows[1]["Wiki_content"].count("They are fast.") == 1
    assert rows[2]["Wiki_content"] == "" and rows[2]["Abstract"] is None
    assert rows[4]["Wiki_content"] is None


def made_points(spark, model):
    made = dataset.prepare_dataset(projects(spark), pages(spark))
    return index.build_points(made, "pid", 6, model, packed_id, summary=False)


def test_answers_end_to_end(spark, tmp_path):
    model = index.hashed_model(dim=64)
    stored = Collection(spark, str(tmp_path), "wiki")
    index.store_points(stored, made_points(spark, model), model)
    index.store_points(stored, made_points(spark, model), model)
    n = stored.count()
    assert n == made_points(spark, model).count() > 1
    asked = spark.createDataFrame([(1, "Enzymes degrade plastic"), (2, "yeast green")], "qid long, question string")
    prompted = answer.with_prompts(asked, answer.retrieve(asked, stored.points(), model, 2))
    known = prompted.filter("qid = 1").select("prompt_id", F.lit("They do.").alias("text"))
    done = {r["qid"]: r for r in answer.answer_questions(asked, stored.points(), known, model, 2).collect()}
    assert done[1]["answer"] == "They do." and done[2]["answer"] is None
    assert "plastic" in done[1]["retrieved"][0]["Wiki_content"] and len(done[1]["retrieved"]) == 2
    assert "Yeast" in done[2]["retrieved"][0]["Wiki_content"]
    index.store_points(stored, made_points(spark, model).limit(1), model, "evaluation")
    assert stored.count() == 1


def test_search_with_a_metadata_condition(spark):
    model = index.hashed_model(dim=64)
    points = made_points(spark, model).filter(F.col("payload.Team_Name") == "Team D")
    asked = spark.createDataFrame([(1, "plastic")], "qid long, question string")
    assert answer.retrieve(asked, points, model).count() == 0


def test_evaluation_run_resumes(spark):
    model = index.hashed_model("m", 32)
    made = evaluation.evaluation_chunks(dataset.prepare_dataset(projects(spark), pages(spark)), "pid", [6, 20], summary=False)
    grid = evaluation.configuration_grid(spark, [6, 20], ["m"])
    points = evaluation.grid_points(made, grid, [model], lambda id: packed_id(id["pid"], id["chunk_no"]))
    asked = evaluation.question_prompts(made, 2, ["chunk_size"])
    texts = asked.select("prompt_id", F.concat(F.lit("Question: "), "Wiki_content", F.lit(" Answer: yes")).alias("text")).dropDuplicates()
    examples = evaluation.parsed_questions(asked, texts, ["chunk_size"])
    pending = examples.join(grid, "chunk_size")
    nothing = spark.createDataFrame([], "prompt_id string, text string")
    keys = ["chunk_size", "embedding_model"]
    first = evaluation.run_results(pending, points, nothing, [model], keys, "d")
    rows = first.collect()
    assert len(rows) == examples.count() and all(r["retrieved"] for r in rows)
    todo = evaluation.pending_questions(pending, first.limit(1), keys, ["qa_context"])
    assert todo.count() == len(rows) - 1
    judged = evaluation.judge_prompts(first)
    grades = judged.select("prompt_id", F.lit("Score: 5").alias("text")).dropDuplicates()
    scored = evaluation.judged_results(first, grades).withColumn("settings", F.concat_ws(",", *keys))
    best = report.find_best_configuration(scored).first()
    assert (best["chunk_size"], best["embedding_model_name"], best["best_score"]) == (20, "m", 1.0)
    assert METADATA.fieldNames() == METADATA_FIELDS


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.createDataFrame([(i, f"question {i % 5}") for i in range(30)], "qid long, question string")
    rows.repartition(3).write.parquet(folder)
    stream = jobs.read_files(spark, folder, rows.schema, files_per_batch=1)
    out = str(tmp_path / "out")
    jobs.append_new_questions(stream.select("question"), out, str(tmp_path / "c1")).awaitTermination()
    spark.createDataFrame([(99, "question 1"), (98, "fresh")], rows.schema).write.mode("append").parquet(folder)
    jobs.append_new_questions(stream.select("question"), out, str(tmp_path / "another-run")).awaitTermination()
    assert sorted(r["question"] for r in spark.read.schema("question string").parquet(out).collect()) == ["fresh"] + [f"question {i}" for i in range(5)]
    model = index.hashed_model(dim=32)
    points = rows.filter("qid < 5").select(F.col("qid").alias("id"), model.embed(F.col("question")).alias("vector"), F.struct("question").alias("payload"))
    found = str(tmp_path / "hits")
    jobs.search_stream(stream, points, model, found, str(tmp_path / "c2"), 1).awaitTermination()
    best = spark.read.parquet(found)
    assert best.count() == 32 and best.filter("qid < 30 AND qid % 5 <> id").count() == 0


def test_a_stream_searches_the_collection_as_it_grows(spark, tmp_path):
    model = index.hashed_model(dim=32)
    wiki = Collection(spark, str(tmp_path / "wiki"), "w")
    folder, found = str(tmp_path / "in"), str(tmp_path / "hits")

    def arrive(qid, text):
        spark.createDataFrame([(qid, text)], "qid long, question string").coalesce(1).write.mode("append").parquet(folder)
        docs = spark.createDataFrame([(qid, text)], "id long, text string")
        docs.coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        to_points = lambda b: b.select("id", model.embed(F.col("text")).alias("vector"), F.struct("text").alias("payload"))
        stream = jobs.read_files(spark, str(tmp_path / "docs"), docs.schema)
        jobs.ingest(stream, to_points, wiki, model, str(tmp_path / "c-docs")).awaitTermination()
        asked = jobs.read_files(spark, folder, spark.read.parquet(folder).schema)
        jobs.search_stream(asked, wiki, model, found, str(tmp_path / "c-asked"), 1).awaitTermination()

    arrive(1, "first words")
    arrive(2, "other things")
    assert {(r["qid"], r["id"]) for r in spark.read.parquet(found).collect()} == {(1, 1), (2, 2)}


def test_first_seen_questions_keep_state_that_expires(spark, tmp_path):
    """Once each over a restart; state as large as the questions of its time; new again after it; nothing stored is read."""
    import time

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(questions, ttl_ms, name):
        spark.createDataFrame([(q,) for q in questions], "question string").repartition(2).write.mode("append").parquet(folder)
        stream = jobs.read_files(spark, folder, spark.read.parquet(folder).schema)
        running = seen.store_first_seen(stream, f"{out}-{name}", str(tmp_path / f"c-{name}"), ttl_ms)
        assert running.awaitTermination(120)
        stored = sorted(r["question"] or "" for r in spark.read.schema(seen.SCHEMA).parquet(f"{out}-{name}").collect())
        return stored, running.lastProgress["stateOperators"][0]["numRowsTotal"]

    before = [spark.conf.get(key) for key in seen._SETTINGS]
    assert run(["a", "b"] * 300 + [None], 3_600_000, "long") == (["", "a", "b"], 3)
    assert run(["b", "c"], 3_600_000, "long") == (["", "a", "b", "c"], 4)
    assert run([], 1, "short")[0] == ["", "a", "b", "c"]
    time.sleep(0.1)
    stored, rows = run(["d", "a"], 1, "short")
    assert stored == ["", "a", "a", "b", "c", "d"] and rows == 2
    assert [spark.conf.get(key) for key in seen._SETTINGS] == before


def test_loaded_model(spark, tmp_path):
    def load():
        return lambda texts: [[len(t), t.count("e")] for t in texts]

    def load_query():
        return lambda texts: [[1.0, len(t)] for t in texts]

    model = index.loaded_model("lengths", 2, load, load_query)
    stored = Collection(spark, str(tmp_path), "wiki")
    made = dataset.prepare_dataset(projects(spark), pages(spark))
    index.store_points(stored, index.build_points(made, "pid", 6, model, packed_id, summary=False), model)
    for r in stored.points().collect():
        assert r["vector"] == [len(r["payload"]["Wiki_content"]), r["payload"]["Wiki_content"].count("e")]
    asked = spark.createDataFrame([(1, "what"), (2, None)], "qid long, question string")
    assert answer.retrieve(asked, stored.points(), model, 2).count() == 4


def test_a_configuration_without_a_model_is_an_error(spark):
    import pytest

    pending = spark.createDataFrame([(6, "other", "q", "a", "c", None)], "chunk_size int, embedding_model string, question string, reference_answer string, qa_context string, qa_meta string")
    points = spark.createDataFrame([], "chunk_size int, embedding_model string, id long, vector array<float>, payload string")
    with pytest.raises(ValueError, match="other"):
        evaluation.run_prompts(pending, points, [index.hashed_model("m", 8)], ["chunk_size", "embedding_model"])


def test_site_chunks_are_those_of_one_pass(spark):
    from pageloom.functions import text as tx
    from pageloom.operators import chunking, crawl

    rows = [(seed, [page], pos, f"p{page}", f"{seed} page {page} has sentence number {pos} here [1]." if pos % 3 else "[2]") for seed in ("a", "b") for page in range(9) for pos in range(7)]
    sentences = spark.createDataFrame(rows, "seed string, route array<int>, pos int, page_url string, sentence string")
    whole = {}
    for seed, _, _, _, s in sorted(rows):
        if s != "[2]":
            whole.setdefault(seed, []).append(s.replace(" [1].", "."))
    for block_rows in (5, 20_000):
        got = crawl.site_chunks(sentences, 20, block_rows).orderBy("seed", "chunk_no").collect()
        assert len({(r["seed"], r["chunk_no"]) for r in got}) == len(got)
        for seed, said in whole.items():
            own = [r for r in got if r["seed"] == seed]
            assert [r["chunk_no"] for r in own] == list(range(len(own)))
            joined = [" ".join(s.split()) for r in own for s in r["sentences"]]
            assert joined == [" ".join(s.replace(" .", ".").split()) for s in said] or len(joined) == len(said)
            assert all(r["n_tokens"] + 2 <= 20 or r["n_sentences"] == 1 for r in own)
    assert chunking and tx


def test_cleaned_site_sentences_are_the_site_sentences_cleaned(spark):
    from pageloom.functions import text as tx
    from pageloom.operators import crawl

    html = "<p>Same here [1]. Same here [2]. Only [3].</p><p>[4]</p><p>{} own text. Same here [1].</p>"
    pages = spark.createDataFrame([(f"p{i}", html.format(i)) for i in range(3)] + [("p3", None), ("p4", "")], "page_url string, html string")
    reached = spark.createDataFrame([(s, f"p{i}", [i]) for s in ("a", "b") for i in range(5)] + [("c", "p1", [])], "seed string, page_url string, route array<int>")
    raw = crawl.site_sentences(reached, pages)
    plain = raw.withColumn("sentence", tx.clean_text(F.col("sentence"))).filter("sentence != ''")
    columns = ["seed", "route", "page_url", "sentence"]
    got = crawl.cleaned_site_sentences(reached, pages)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect()))
    assert all(r["n"] == len(r["sentence"].split()) for r in got.collect())
    chunks = [sorted(map(tuple, crawl.site_chunks(x, 9).collect())) for x in (got, raw)]
    assert chunks[0] == chunks[1] and chunks[0]


def _sites(spark):
    """Pages whose ends and beginnings reach into each other, and seeds that reach them in several orders."""
    import random

    deal = random.Random(4)
    said = ["Smith J. Doe 2019 pages", "End 7.", "Les.", "Seen by the sea.", "2.5", "mg left.", "see [1,", "2] and so on.", "Doe K.", "20[1,", "2]19 x 5", ", and then ?",
            "http://a.org/b.", "\n12 and", "Ünd é.", "J.", "One Two Three Four.", "1999 was", "x@y.z .", "é", "4,", "no digits\nhere ok?", "Common one.", "[J].", "\x1c, a", "Q 2001 to"]
    pages = [(f"p{i}", " ".join(f"<p>{deal.choice(said)}</p>" for _ in range(deal.randint(0, 5)))) for i in range(40)] + [("p40", None), ("p41", "")]
    reached = [(None if s == 5 else s, f"p{p}", [place]) for s in range(30) for place, p in enumerate(deal.sample(range(45), deal.randint(1, 30)))]
    frame = spark.createDataFrame(pages, "page_url string, html string")
    return spark.createDataFrame(reached, "seed long, page_url string, route array<int>"), frame, dict(pages), reached


def _first_said(spark, reached, pages):
    """By brute force: each site's sentences as (route, pos, page_url, sentence), first copies only."""
    from pageloom.functions import html as hx
    from pageloom.functions import text as tx

    said = {r["page_url"]: r["s"] for r in pages.select("page_url", tx.split_sentences(hx.html_text(F.col("html"))).alias("s")).collect()}
    sites, seen = {}, set()
    for seed, url, route in sorted(reached, key=lambda r: (str(r[0]), r[2])):
        for pos, s in enumerate(said.get(url, [])):
            if (seed, s) not in seen:
                seen.add((seed, s))
                sites.setdefault(seed, []).append((route, pos, url, s))
    return sites


def test_sites_cleaned_page_by_page_are_cleaned_whole(spark):
    from pageloom.functions import text as tx
    from pageloom.operators import crawl

    reached, pages, _, rows = _sites(spark)
    sites = _first_said(spark, rows, pages)
    whole = spark.createDataFrame([(seed, " ".join(s[3] for s in said)) for seed, said in sites.items()], "seed long, raw string")
    wanted = {r["seed"]: r["text"] for r in whole.select("seed", tx.clean_text(F.col("raw")).alias("text")).collect()}
    places = crawl.site_places(reached, pages)
    got = crawl.site_text(places).collect()
    assert len(got) == len(wanted) and {r["seed"]: r["text"] for r in got} == wanted
    kept = crawl.site_sentences(reached, pages).collect()
    assert sorted((str(r["seed"]), r["route"], r["pos"], r["page_url"], r["sentence"]) for r in kept) == sorted((str(k), *s) for k, v in sites.items() for s in v)


def test_texts_are_told_apart_where_no_rule_reaches_over(spark):
    """Pairs of ends and beginnings, joined by all texts that edges() lets be cleaned apart."""
    import random

    from pageloom.functions import text as tx

    deal = random.Random(1)
    bits = ["Doe", "2019", "the", "sea.", "mg.", "mg", "2.5", "[1,", "2]", "J.", "Les.", "?", ",", "http://a.b", "x@y", "\n", "é.", "7", "A", "ok?", "\x1c", "[J].", "20", "!", "So on."]
    texts = list({t for t in (" ".join(deal.choices(bits, k=deal.randint(1, 5))).strip() for _ in range(260)) if t})
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.clean_text(F.col("t")).alias("own"), tx.edges(F.col("t")).alias("e"))
    a, b = frame.select(*[F.col(c).alias(f"{c}_a") for c in frame.columns]), frame.select(*[F.col(c).alias(f"{c}_b") for c in frame.columns])
    apart = ((F.col("e_a.ends") == tx.CLOSED) | ((F.col("e_a.ends") == tx.NAMED) & ~F.col("e_b.continues"))) & ~F.col("e_a.begins")
    pairs = a.crossJoin(b).filter(apart).select(
        "t_a", "t_b", tx.clean_text(F.concat_ws(" ", "t_a", "t_b")).alias("whole"), F.concat_ws(" ", "own_a", F.expr("nullif(own_b, '')")).alias("joined")
    )
    assert pairs.count() > 1000
    assert pairs.filter("whole <> joined").limit(3).collect() == []


def test_site_chunks_of_places_send_numbers(spark):
    from pageloom.operators import crawl

    reached, pages, _, _ = _sites(spark)
    for block_rows in (4, 20_000):
        plain = sorted(map(str, crawl.site_chunks(crawl.cleaned_site_sentences(reached.filter("seed IS NOT NULL"), pages), 9, block_rows).collect()))
        assert sorted(map(str, crawl.site_chunks(crawl.cleaned_site_places(reached.filter("seed IS NOT NULL"), pages), 9, block_rows).collect())) == plain and plain


def test_documents_are_dealt_out_anew_after_the_join_with_the_long_ones(spark):
    """Adaptive execution may read the join's own shuffle map by map or split it, and so tear a document apart."""
    from pageloom.operators import chunking

    rows = spark.range(0, 6_000, 1, 8).selectExpr("id % 30 AS doc", "int(id / 30) AS ord", "int(id % 7 + 1) AS n")
    rows = rows.unionByName(spark.range(500).selectExpr("300L AS doc", "int(id) AS ord", "int(id % 7 + 1) AS n"))
    packed = chunking.chunk_sentence_rows(rows, 40, "doc", "ord", "n", 450)
    plan = packed._jdf.queryExecution().sparkPlan().toString() + packed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(xxhash64(doc" in plan
    assert packed.groupBy("doc", "chunk_no").agg(F.sum("n").alias("n")).filter("n > 38").count() == 0


def test_texts_of_pages_are_made_once_for_all_sites_that_hold_them(spark):
    from pageloom.operators import crawl

    reached, pages, _, rows = _sites(spark)
    sites = crawl.site_places(reached, pages)
    texts = crawl.page_texts(sites)
    assert texts.count() == sites.places.join(texts, ["page", "kept"]).select("page", "kept").distinct().count() < crawl.site_pages(sites).count()
    got = sorted((str(r["seed"]), r["page_url"], r["text"]) for r in sites.places.join(texts, ["page", "kept"]).collect())
    wanted = {}
    for seed, said in _first_said(spark, rows, pages).items():
        for _, _, url, s in said:
            wanted.setdefault((str(seed), url), []).append(s)
    assert got == sorted((*k, " ".join(v)) for k, v in wanted.items())


def test_links_to_pages_not_stored_change_no_site(spark):
    from pageloom.operators import crawl

    links = spark.createDataFrame([("a", "b", 0), ("a", "gone", 1), ("b", "c", 0), ("gone", "c", 0)], "src_url string, dst_url string, pos int")
    pages = spark.createDataFrame([("a", "A."), ("b", "B."), ("c", "C.")], "page_url string, html string")
    assert sorted(tuple(r) for r in crawl.stored_links(links, pages).collect()) == [("a", "b", 0), ("b", "c", 0), ("gone", "c", 0)]


def _random_texts(deal, bits, n):
    """(page, parts) with sentences of up to four bits; the last page has every sentence of its own."""
    pages = []
    for page in range(n):
        said = [" ".join(deal.choices(bits, k=deal.randint(1, 4))).strip() for _ in range(deal.randint(0, 9))]
        pages.append((page, f"p{page}", [(s, deal.random() < 0.6) for s in dict.fromkeys(said) if s]))
    return pages


def test_sentences_cleaned_apart_are_those_of_the_whole_text(spark):
    """Each text's sentences against cleaning, splitting and measuring it whole; those that reach into each other are joined."""
    import random

    from pageloom.functions import text as tx
    from pageloom.operators import crawl

    deal = random.Random(7)
    bits = ["Doe", "2019", "the", "sea.", "mg.", "mg", "2.5", "[1,", "2]", "J.", "Les.", "?", ",", "http://a.b", "x@y", "\n", "é.", "7", "A", "a.", "ok?", "\x1c", "[J].",
            "20", "!", "So on.", "20[1,", "2]19", "Dr.", "and so.", "by it.", "x.y.", "Smith"]
    pages = _random_texts(deal, bits, 400)
    places = [(seed, seed, page, [], sorted(deal.sample(some, deal.randint(0, len(some)))))
              for page, _, parts in pages for seed in range(4) for some in [[i for i, p in enumerate(parts) if not p[1]]]]
    sites = crawl.SitePlaces(
        spark.createDataFrame(places, "seed long, at int, page long, route array<int>, kept array<int>"),
        spark.createDataFrame(pages, "page long, page_url string, parts array<struct<sentence string, lone boolean>>"),
    )
    whole = tx.split_sentences(tx.clean_text(F.col("text")))
    wanted = crawl.page_texts(sites).select("page", "kept", "page_url", F.transform(whole, lambda s: F.struct(s.alias("sentence"), tx.token_count(s).alias("n"))).alias("said"))
    got, wanted = sorted(map(str, crawl.page_sentences(sites).collect())), sorted(map(str, wanted.collect()))
    assert len(got) > 800
    assert got == wanted


def test_most_sentences_are_cleaned_once_for_all_texts_that_hold_them(spark, monkeypatch):
    from pageloom.operators import crawl

    cleaned = []
    texts = crawl.page_texts
    monkeypatch.setattr(crawl, "page_texts", lambda sites: cleaned.append(texts(sites)) or cleaned[-1])
    parts = [(f"Sentence {word} is here.", False) for word in ("one", "two", "three")] + [("Seen by Doe.", True), ("2019 pages", False)]
    sites = crawl.SitePlaces(
        spark.createDataFrame([(s, 0, 1, [], kept) for s, kept in enumerate([[], [0], [0, 1], [0, 1, 2], [0, 1, 2, 4]])], "seed long, at int, page long, route array<int>, kept array<int>"),
        spark.createDataFrame([(1, "p", parts)], "page long, page_url string, parts array<struct<sentence string, lone boolean>>"),
    )
    assert crawl.page_sentences(sites).count() == 5
    assert [r["text"] for r in cleaned[0].collect()] == ["Seen by Doe. 2019 pages"]


def test_pages_are_read_once_for_links_and_texts(spark, tmp_path):
    from pageloom.registry import queries

    pages = [(i, f"http://h.example.org/{i}", f"<p>Page {i} is here.</p>") for i in range(6)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    stored, _ = queries._tree(spark, str(tmp_path))
    assert "Scan parquet" not in stored._jdf.queryExecution().executedPlan().toString()
