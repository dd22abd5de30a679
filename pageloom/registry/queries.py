"""Registered queries: (spark, sf_dir) -> DataFrame. Each one runs over its whole input tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import html as hx
from pageloom.functions import parsing as px
from pageloom.functions import prompts
from pageloom.functions import sql
from pageloom.functions import text as tx
from pageloom.functions import urls
from pageloom.functions import vectors as vx
from pageloom.functions.binding import let
from pageloom.operators import cells, chunking, crawl, embedding, knn, learned, quantised, sampling, scores, summarize
from pageloom.operators import sentences as st
from pageloom.operators.collections import Collection, flat_payload, metadata_struct, packed_id, with_dense_ids
from pageloom.operators.lookup import KeyedTable
from pageloom.operators.rows import unnest
from pageloom.plans import answer, dataset, evaluation, index, report
from pageloom.registry import data
from pageloom.registry.data import CHUNK_SIZE, DIM, table
from pageloom.schemas import METADATA_FIELDS
from pageloom.session import checkpointed, scratch_path
from pageloom.sources import results, tables
from pageloom.streaming import jobs
from pageloom.streaming import questions as seen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def components(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """One row per vector component, rounded: (keys, pos, value)."""
    rows = unnest(df, keys, F.col("vector"), "pos", "value")
    return rows.withColumn("value", F.round(F.col("value").cast("double"), digits) + F.lit(0.0))


# --- text, URLs, HTML -------------------------------------------------------------------------


@query
def clean_text(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", tx.clean_text(data.marked_text()).alias("cleaned"))


@query
def cleaning_steps(spark, sf):
    """The text after each rule in turn."""
    # never empty; the outer form, since the inner one computes the array twice
    rows = table(spark, sf, "documents").select("doc_id", F.explode_outer(_step_digests(data.marked_text())).alias("s"))
    return rows.select("doc_id", "s.step", "s.digest")


def _step_digests(text: Column, step: int = 0) -> Column:
    """(step, digest) of the text after each rule; each rule is applied once, to the text that the one before left."""
    if step == len(tx.CLEANING_RULES):
        return F.array().cast("array<struct<step: int, digest: string>>")
    own = lambda t: F.array(F.struct(F.lit(step).alias("step"), F.md5(t.cast("binary")).alias("digest")))
    return let(tx.cleaning_step(text, step), lambda t: F.concat(own(t), _step_digests(t, step + 1)))


@query
def sentences(spark, sf):
    rows = table(spark, sf, "documents")
    return st.explode_sentences(rows, ["doc_id"])


@query
def token_counts(spark, sf):
    rows = st.explode_sentences(table(spark, sf, "documents"), ["doc_id"])
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"), F.sum(tx.token_count(F.col("sentence"))).alias("n_tokens")
    )


@query
def stripped_text(spark, sf):
    padded = F.concat(F.lit(" \t\n"), "text", F.lit("\r\n  "))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.strip(padded).alias("stripped"))


@query
def canonical_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", hx.html_text(F.col("html")).alias("text"))


@query
def anchors(spark, sf):
    return unnest(table(spark, sf, "pages"), ["page_id"], hx.anchor_hrefs(F.col("html")), "pos", "href")


@query
def resolved_links(spark, sf):
    rows = unnest(data.page_tree(spark, sf), ["page_id", "url"], hx.anchor_hrefs(F.col("html")), "pos", "href")
    return rows.select("page_id", "pos", urls.resolve_url(urls.canonical_url(F.col("url")), F.col("href")).alias("link"))


@query
def link_predicates(spark, sf):
    pages = data.page_tree(spark, sf).withColumn("page_url", urls.page_key(F.col("url")))
    links = crawl.page_links(pages)
    src, dst = F.col("src_url"), F.col("dst_url")
    return links.select(
        "src_url", "pos", "dst_url", urls.has_keyword(dst).alias("has_keyword"),
        urls.same_host(src, dst).alias("is_same_host"), urls.below_path(src, dst).alias("is_below"),
    )


# --- sources and sinks ------------------------------------------------------------------------


@query
def project_csv(spark, sf):
    """Write the projects as CSV, scan them back, keep one year."""
    path = scratch_path(spark, "projects-csv")
    tables.write_projects(data.projects(spark, sf).drop("doc_id"), path)
    return tables.of_year(tables.read_projects(spark, path), 2019)


@query
def stage_table(spark, sf):
    """Write a stage table twice under the build-once switch, and scan it."""
    path = scratch_path(spark, "stage")
    clean = data.clean_documents(spark, sf)
    tables.materialize_once(spark, path, lambda: clean)
    kept = tables.materialize_once(spark, path, lambda: clean.limit(0))
    return kept.select("doc_id", F.length("text").alias("n_chars"))


@query
def fetched_pages(spark, sf):
    """Wanted URLs in another spelling, and as many that have no stored page."""
    pages = table(spark, sf, "pages")
    spelled = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/#again"))
    wanted = pages.select(F.col("page_id").alias("want_id"), F.explode(F.array(spelled, F.concat(spelled, F.lit("/none")))).alias("url"))
    wanted = wanted.withColumn("url", F.regexp_replace("url", "#again/none$", "none"))
    return tables.fetch_pages(wanted, pages).select("want_id", "page_url", "page_id", F.length("html").alias("n_chars"))


@query
def result_files(spark, sf):
    """Result rows written as one folder of JSON per configuration, scanned with their settings."""
    path = scratch_path(spark, "results")
    rows = data.run_results(spark, sf).withColumn("test_settings", F.lit("x"))
    rows.write.partitionBy("chunk_size", "embedding_model").json(path)
    back = results.read_result_lines(spark, path)
    folder = F.url_decode(F.col("settings"))
    return back.select(
        "question", "eval_score",
        F.regexp_extract(folder, "chunk_size=([^/]*)", 1).alias("chunk_size"),
        F.url_decode(F.regexp_extract(folder, "embedding_model=([^/]*)", 1)).alias("embedding_model"),
    )


@query
def result_arrays(spark, sf):
    """Result rows written as files that hold one JSON array each, scanned with their settings."""
    path = scratch_path(spark, "result-arrays")
    rows = data.run_results(spark, sf).select("question", "chunk_size", "eval_score").withColumn("file", F.pmod(F.xxhash64("question"), F.lit(5)))
    record = F.to_json(F.struct("question", "eval_score"))
    arrays = rows.groupBy("chunk_size", "file").agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
    # one array per file: the cap on records does it, whatever partition the arrays fall into
    arrays.drop("file").write.option("maxRecordsPerFile", 1).partitionBy("chunk_size").text(path)
    back = results.read_result_arrays(spark, path)
    return back.select("question", "eval_score", F.regexp_extract("settings", "chunk_size=([^/]*)", 1).alias("chunk_size"))


@query
def result_array_ranges(spark, sf):
    """Result arrays whose files are each read by many tasks, cut wherever a byte range ends."""
    path = scratch_path(spark, "result-ranges")
    rows = data.run_results(spark, sf).select("question", "chunk_size", "eval_score")
    files = 1 + rows.count() // 20_000  # what one file holds is bounded
    record = F.to_json(F.struct("question", "eval_score"))
    rows = rows.withColumn("file", F.pmod(F.monotonically_increasing_id(), F.lit(files)))  # copies of a question spread as well
    arrays = rows.groupBy("chunk_size", "file").agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    arrays.drop("file").write.option("maxRecordsPerFile", 1).partitionBy("chunk_size").text(path)
    back = results.read_large_arrays(spark, path, range_bytes=256 << 10)
    return back.select("question", "eval_score", F.regexp_extract("settings", "chunk_size=([^/]*)", 1).alias("chunk_size"))


@query
def result_partitions(spark, sf):
    """Write all configurations, rewrite one with higher scores, read all."""
    path = scratch_path(spark, "result-parts")
    rows = data.run_results(spark, sf)
    results.write_results(rows, path)
    again = rows.filter((F.col("chunk_size") == 300) & (F.col("embedding_model") == "hub/click"))
    results.write_results(again.withColumn("eval_score", F.col("eval_score") + 10), path)
    back = results.read_results(spark, path)
    return back.groupBy(results.partition_settings().alias("settings")).agg(
        F.count("*").alias("n"), F.sum("eval_score").alias("total")
    )


@query
def concatenated_results(spark, sf):
    rows = data.run_results(spark, sf).select("question", "chunk_size", "embedding_model", "eval_score")
    ungraded = rows.filter(F.col("eval_score") == 0).drop("eval_score")
    return results.concat_results(rows.filter(F.col("eval_score") > 0), ungraded)


def _points(spark, sf) -> DataFrame:
    rows = data.chunk_vectors(spark, sf)
    return rows.select("id", "vector", F.struct(F.col("content").alias("Wiki_content"), "lang").alias("payload"))


def _stored(rows: DataFrame) -> DataFrame:
    return rows.select("id", "payload.Wiki_content", "payload.lang", F.size("vector").alias("dim"))


@query
def collection_upsert(spark, sf):
    """Keep mode: store everything in two versions, upsert the first chunk of every document with new text, compact."""
    points = tables.materialize_once(spark, scratch_path(spark, "points"), lambda: _points(spark, sf))
    kept = Collection(spark, scratch_path(spark, "collections"), "kept")
    kept.create(DIM)
    stale = points.withColumn("payload", F.col("payload").withField("Wiki_content", F.lit("stale")))
    both = stale.withColumn("seen", F.lit(0)).unionByName(points.withColumn("seen", F.lit(1)))
    kept.upsert(both, "seen")
    first = points.filter(F.col("id") % (1 << 24) == 0)
    changed = first.withColumn("payload", F.col("payload").withField("Wiki_content", F.lit("changed")))
    kept.upsert(changed)
    kept.compact()
    return _stored(kept.points())


@query
def collection_replace(spark, sf):
    """Replace mode: only the second load remains. Two collections share the root; one is scanned."""
    points = _points(spark, sf)
    root = scratch_path(spark, "collections")
    other, scanned = Collection(spark, root, "other"), Collection(spark, root, "scanned")
    other.replace(points, DIM)
    scanned.replace(points, DIM)
    scanned.replace(other.points().filter(F.col("payload.lang") == "en"), DIM)
    return _stored(scanned.points())


@query
def collection_counts(spark, sf):
    """Stored count and populated check before and after the load."""
    made = Collection(spark, scratch_path(spark, "collections"), "made")
    made.create(DIM)
    before = made.is_populated()
    made.upsert(_points(spark, sf))
    stored = made.points().agg(F.count("*").alias("n_points"))
    return stored.select("n_points", F.lit(before).alias("was_populated"), F.lit(made.is_populated()).alias("is_populated"))


# --- sentences, chunks, summaries, vectors ------------------------------------------------------


@query
def first_sentences(spark, sf):
    """Distinct sentences per language over all documents, first occurrence kept."""
    rows = st.explode_sentences(table(spark, sf, "documents"), ["lang", "doc_id"])
    return st.first_occurrences(rows, ["lang"], ["doc_id", "pos"])


@query
def joined_conversations(spark, sf):
    return st.join_ordered(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text")


@query
def chunks(spark, sf):
    rows = data.document_chunks(spark, sf)
    return rows.select("doc_id", "chunk_no", "n_sentences", "n_tokens", chunking.chunk_text().alias("content"))


@query
def chunk_numbers(spark, sf):
    """The sentence-table form, on raw sentences; long documents go through block packing."""
    rows = st.explode_sentences(table(spark, sf, "documents"), ["doc_id"])
    counted = rows.select("doc_id", "pos", tx.token_count(F.col("sentence")).alias("n"))
    return chunking.chunk_sentence_rows(counted, CHUNK_SIZE, "doc_id", "pos", "n", block_rows=300)


@query
def sql_clean_text(spark, sf):
    """Cleaning as a user of SQL asks for it."""
    sql.register(spark)
    docs = table(spark, sf, "documents").select("doc_id", data.marked_text().alias("text"))
    return spark.sql("SELECT doc_id, clean_text(text) AS cleaned FROM {docs}", docs=docs)


@query
def sql_chunk_numbers(spark, sf):
    """Chunk numbers of the raw sentences by a table function in SQL."""
    sql.register(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spark.sql(
        "SELECT doc_id, p.* FROM (SELECT doc_id, sentence_tokens(text) AS counts FROM {docs}), LATERAL packed_chunks(counts, {size}) p",
        docs=docs, size=CHUNK_SIZE,
    )


@query
def chunk_summaries(spark, sf):
    rows = data.document_chunks(spark, sf)
    return summarize.summarize_chunks(rows, ["id"])


@query
def pooled_vectors(spark, sf):
    """Embeddings as token vectors: grouped by label, every third one masked."""
    rows = data.vectors(spark, sf).withColumn("mask", (F.col("id") % 3 != 0).cast("int"))
    return components(embedding.pooled_vectors(rows, ["label"], "vector", "mask", DIM), ["label"])


@query
def chunk_embeddings(spark, sf):
    return components(data.chunk_vectors(spark, sf), ["id"])


@query
def question_embeddings(spark, sf):
    """Query embeddings, truncated to twenty terms."""
    rows = data.questions(spark, sf)
    vector = embedding.hashed_embedding(F.col("question"), DIM, 20).alias("vector")
    return components(rows.select("qid", vector), ["qid"])


LETTERS = "abcdefgh"


@query
def encoded_points(spark, sf):
    """Points of all turns by a model that is loaded in the tasks: the shares of eight letters."""
    def load():
        return lambda texts: [[t.count(c) / max(len(t), 1) for c in LETTERS] for t in texts]

    model = index.loaded_model("letters", len(LETTERS), load)
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), model.embed(F.col("text")).alias("vector"))
    return components(rows, ["id"])


@query
def unit_vectors(spark, sf):
    return components(data.vectors(spark, sf).select("id", vx.unit(F.col("vector")).alias("vector")), ["id"])


@query
def dense_ids(spark, sf):
    rows = data.document_chunks(spark, sf).select("doc_id", "chunk_no")
    return with_dense_ids(rows, ["doc_id", "chunk_no"])


@query
def payloads(spark, sf):
    """Metadata struct of every project, flattened beside its text."""
    rows = data.projects(spark, sf).select("doc_id", F.col("Abstract").alias("content"), metadata_struct())
    return rows.select("doc_id", flat_payload("content").alias("payload")).select("doc_id", "payload.*")


# --- search -------------------------------------------------------------------------------------


def _self_search(spark, sf):
    rows = data.vectors(spark, sf)
    return rows.select(F.col("id").alias("qid"), "vector"), rows


@query
def nearest_neighbours(spark, sf):
    queries, rows = _self_search(spark, sf)
    return knn.nearest(queries, rows, DIM)


@query
def nearest_by_blocks(spark, sf):
    """The form for many queries."""
    queries, rows = _self_search(spark, sf)
    return knn.nearest(queries, rows, DIM, max_broadcast_queries=16)


@query
def nearest_by_label(spark, sf):
    """Several collections at once: each query searches the vectors of its own label."""
    rows = data.vectors(spark, sf)
    queries = rows.select(F.col("id").alias("qid"), "vector", "label")
    found = knn.nearest(queries, rows, DIM, part="label")
    return found.select(F.col("label").cast("int").alias("label"), "qid", "id", "score", "rank")


@query
def filtered_search(spark, sf):
    """Similarity under a condition on metadata, applied before the search."""
    queries, rows = _self_search(spark, sf)
    return knn.nearest(queries, rows.filter(F.col("label").isin(1, 3, 5)), DIM)


@query
def cell_search_exact(spark, sf):
    """All cells probed: the hits of the plain scan."""
    queries, rows = _self_search(spark, sf)
    centroids = cells.train_centroids(rows, 16)
    assigned = cells.assign_cells(rows.select("id", "vector"), centroids).persist()
    return cells.search(queries, assigned, centroids, DIM, n_probe=16)


@query
def cell_search_recall(spark, sf):
    """The approximate search against the exact one: at seven tenths of the pairs or less, nine hits in ten are found."""
    queries, rows = _self_search(spark, sf)
    centroids = cells.train_centroids(rows, 16)
    assigned = cells.assign_cells(rows.select("id", "vector"), centroids).persist()
    made = cells.quality(queries, assigned, centroids, DIM)
    return made.select(
        "n_true", (F.col("incomplete") == 0).alias("is_complete"), (F.col("recall") >= 0.9).alias("finds_most"), (F.col("share") <= 0.7).alias("skips_much")
    )


@query
def quantised_recall(spark, sf):
    """The search over compressed codes against the exact one, at few cells and at many: nine hits in ten for a quarter of the exact cosines or less."""
    queries, rows = _self_search(spark, sf)
    made, truth = [], checkpointed(quantised.true_hits(queries, rows, DIM))
    for n_cells in (16, 256):
        built = quantised.build(spark, rows, scratch_path(spark, "codes"), n_cells)
        made.append(quantised.quality(built, queries, truth=truth).select(
            F.lit(n_cells).alias("n_cells"), "n_true", (F.col("incomplete") == 0).alias("is_complete"), (F.col("recall") >= 0.9).alias("finds_most"),
            (F.col("share") <= 0.25).alias("scores_few"), F.col("code_bytes").cast("long").alias("code_bytes"),
        ))
    return made[0].unionByName(made[1])


@query
def quantised_first_hits(spark, sf):
    """The nearest vector of each, found among compressed codes and scored exactly."""
    queries, rows = _self_search(spark, sf)
    built = quantised.build(spark, rows, scratch_path(spark, "codes"), 16)
    return quantised.search(built, queries).filter("rank = 1").select("qid", "id", "score")


@query
def payload_lookup(spark, sf):
    """Payloads of all hits from a table bucketed by id, which stays where it is; only keys are exchanged."""
    queries, rows = _self_search(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    stored = KeyedTable(spark, scratch_path(spark, "payloads")).write(docs, buckets=4)
    found = stored.attach(knn.nearest(queries, rows, DIM), ["lang", "text"], max_listed=0, max_broadcast=0)
    return found.select("qid", "rank", "id", "lang", F.length("text").alias("n_chars"))


@query
def hits_with_payload(spark, sf):
    queries, rows = _self_search(spark, sf)
    hits = knn.nearest(queries, rows, DIM)
    return knn.attach_payload(hits, table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), ["lang", "text"]).select(
        "qid", "rank", "id", "lang", F.length("text").alias("n_chars")
    )


# --- prompts and completions --------------------------------------------------------------------


def _completions(spark, sf) -> DataFrame:
    """Every conversation turn as a completion, in the shapes a model may return."""
    turn = F.col("turn") % 5
    text = (
        F.when(turn == 0, F.concat(F.lit("Question: "), "text", F.lit("\nAnswer: "), F.reverse("text"), F.lit(" \n")))
        .when(turn == 1, F.concat(F.lit("Score: "), (F.length("text") % 6).cast("string"), F.lit(" as asked")))
        .when(turn == 2, F.concat(F.lit("Score: 4/5 "), "text"))
        .when(turn == 3, F.concat("text", F.lit(" Score:\n3. Score: 2")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alias("completion"))


@query
def parsed_completions(spark, sf):
    completion = F.col("completion")
    return _completions(spark, sf).select(
        "conv_id", "turn", px.parsed_question(completion).alias("question"),
        px.parsed_answer(completion).alias("answer"), px.parsed_score(completion).alias("score"),
    )


@query
def settings_strings(spark, sf):
    """Names and encoded configurations of all configurations, written and read back."""
    grid = data.run_results(spark, sf).select("chunk_size", "embedding_model").distinct()
    size, model = F.col("chunk_size"), F.col("embedding_model")
    named = grid.select(
        px.settings_name(size, model).alias("name"), px.results_file_name(size, model).alias("file"),
        px.encode_config(F.lit("data/table.parquet"), size, model).alias("config"),
    )
    return named.select(
        "name", "file", "config", px.short_settings(F.col("file")).alias("short"),
        px.decode_config(F.col("config")).alias("c"),
    ).select("name", "file", "config", "short", "c.*")


def _retrieved(spark, sf) -> DataFrame:
    """Ranked hits of every question in the chunk collection, with full payloads."""
    stored = scratch_path(spark, "chunk-vectors")
    chunks = tables.materialize_once(spark, stored, lambda: data.chunk_vectors(spark, sf).select("id", "doc_id", "content", "vector"))
    model = index.hashed_model(dim=DIM)
    asked = data.questions(spark, sf)
    queries = asked.select("qid", model.embed_query(F.col("question")).alias("vector"))
    hits = knn.nearest(queries, chunks.select("id", "vector"), DIM)
    # texts and metadata are joined to the hits, never to all chunks
    found = knn.attach_payload(hits, chunks, ["doc_id", "content"])
    met = found.join(data.projects(spark, sf).select("doc_id", metadata_struct()), "doc_id")
    return met.select("id", "qid", "score", "rank", flat_payload("content").alias("payload"))


@query
def question_hits(spark, sf):
    """Documents to ranked hits: clean, split, deduplicate, chunk, embed, search."""
    model = index.hashed_model(dim=DIM)
    points = data.chunk_vectors(spark, sf).select("id", "vector")
    queries = data.questions(spark, sf).select("qid", model.embed_query(F.col("question")).alias("vector"))
    return knn.nearest(queries, points, DIM)


@query
def hit_blocks(spark, sf):
    return _retrieved(spark, sf).select("qid", "rank", prompts.hit_block(F.col("payload")).alias("block"))


@query
def answer_prompts(spark, sf):
    """The whole chain from documents to prompts."""
    asked = data.questions(spark, sf)
    return answer.with_prompts(asked, _retrieved(spark, sf)).select(
        "qid", F.size("messages").alias("n_messages"), F.element_at("messages", 1)["content"].alias("first"),
        F.md5(F.element_at("messages", -1)["content"].cast("binary")).alias("last_digest"),
    )


@query
def fallback_prompts(spark, sf):
    """Questions with no hit at all."""
    asked = data.questions(spark, sf)
    none = asked.select("qid", F.lit(1).alias("rank"), F.struct(*[F.lit("").alias(f) for f in prompts.BLOCK_FIELDS]).alias("payload"))
    return answer.with_prompts(asked, none.filter(F.col("rank") > 1)).select(
        "qid", F.size("messages").alias("n_messages"), F.element_at("messages", 1)["role"].alias("role"),
        F.element_at("messages", 1)["content"].alias("content"),
    )


@query
def batch_answers(spark, sf):
    """Questions to answers through a completions table that lacks every seventh question."""
    asked, hits = data.questions(spark, sf), _retrieved(spark, sf)
    teams = F.array_join(F.transform("retrieved", lambda p: p["Team_Name"]), ",").alias("teams")
    # read twice, and so written: without the hits' texts, which the prompts' ids stand for
    prompted = checkpointed(answer.with_prompts(asked, hits).select("qid", "question", "prompt_id", teams))
    known = prompted.filter(F.col("qid") % 7 != 0).select("prompt_id", "question").groupBy("prompt_id").agg(
        F.concat(F.lit("On: "), F.max("question")).alias("text")
    )
    return answer.with_completions(prompted, known, "answer").select("qid", "question", "answer", "teams")


# --- traversal ----------------------------------------------------------------------------------


def _tree(spark, sf, missing: bool = False):
    """The stored pages and what every page reaches of them, with ``missing`` also pages that are not stored."""
    pages = tables.keyed_pages(data.page_tree(spark, sf))
    if not missing:
        pages = checkpointed(pages)  # read for the links and for the texts
    seeds = data.page_tree(spark, sf).select(F.col("page_id").alias("seed"), "url")
    links = crawl.followed_links(crawl.page_links(pages))
    return pages, crawl.reachable_pages(seeds, links if missing else crawl.stored_links(links, pages))


@query
def reached_pages(spark, sf):
    """Every page as a seed: the pages it reaches, missing ones included, numbered in visiting order."""
    _, reached = _tree(spark, sf, missing=True)
    return reached.select("seed", "page_url", F.array_join("route", "/").alias("route"))


@query
def site_texts(spark, sf):
    """Every page as a seed: the cleaned text of its site."""
    pages, reached = _tree(spark, sf)
    return crawl.site_text(crawl.site_places(reached, pages)).select("seed", "text")


@query
def site_chunks(spark, sf):
    """Every page as a seed: its site chunked from sentence rows, without a text per site."""
    pages, reached = _tree(spark, sf)
    rows = crawl.site_chunks(crawl.cleaned_site_places(reached, pages), CHUNK_SIZE, block_rows=300)
    return rows.select("seed", "chunk_no", "n_sentences", "n_tokens", chunking.chunk_text().alias("content"))


@query
def page_sources(spark, sf):
    """Chunks of each reached page's own text, with the page they come from."""
    pages, reached = _tree(spark, sf)
    sites = crawl.site_places(reached, pages)
    cleaned = crawl.page_sentences(sites)
    rows = chunking.chunk_documents(cleaned, CHUNK_SIZE, ["page", "kept", "page_url"], "said", lambda s: s["n"], lambda said: said)
    return sites.places.join(rows, ["page", "kept"]).select("seed", "page_url", "chunk_no", "n_sentences", "n_tokens")


@query
def prepared_projects(spark, sf):
    """Dataset preparation: year filter, cleaned abstracts, site text."""
    made = dataset.prepare_dataset(data.projects(spark, sf), data.page_tree(spark, sf))
    return made.select("doc_id", "Year", "Wiki", "Abstract", "Wiki_content")


# --- evaluation ---------------------------------------------------------------------------------


@query
def sampled_chunks(spark, sf):
    rows = data.document_chunks(spark, sf, keep=["lang"])
    return sampling.sample_rows(rows, 30, "id", seed=7, per=["lang"]).select("lang", "id", "n_tokens")


@query
def sampled_documents(spark, sf):
    return sampling.sample_rows(table(spark, sf, "documents").select("doc_id", "lang"), 30, "doc_id", seed=3)


@query
def evaluation_chunk_counts(spark, sf):
    """One chunk table for several sizes, and the configurations that use each of them."""
    made = _evaluation_chunks(spark, sf)
    models = data.run_results(spark, sf).select("chunk_size", "embedding_model").distinct()
    by_size = evaluation.configurations_by_chunk_size(models)
    counts = made.groupBy("chunk_size").agg(F.count("*").alias("n_chunks"))
    return counts.join(by_size, "chunk_size").select(
        "chunk_size", "n_chunks", F.array_join("embedding_models", ",").alias("models")
    )


def _evaluation_chunks(spark, sf) -> DataFrame:
    rows = data.projects(spark, sf).withColumn("Wiki_content", tx.clean_text(F.col("Abstract")))
    return evaluation.evaluation_chunks(rows, "doc_id", evaluation.CHUNK_SIZES)


def _stored_chunks(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The chunk table of an evaluation and its dataset, each written once and read by every step.

    The chunks are written by chunk size, and name their rows of the dataset.
    """
    path, whole = scratch_path(spark, "evaluation-chunks"), scratch_path(spark, "evaluation-dataset")
    # numbers are fixed by writing them; document ids may repeat
    tables.write_table(data.projects(spark, sf).withColumn("row", F.monotonically_increasing_id()), whole)
    dataset = tables.read_table(spark, whole)
    rows = dataset.select("doc_id", "row", tx.clean_text(F.col("Abstract")).alias("Wiki_content"))
    made = evaluation.evaluation_chunks(rows, "doc_id", evaluation.CHUNK_SIZES, row="row")
    tables.write_table(made, path, partition_by=["chunk_size"])
    return tables.read_table(spark, path), dataset


def _examples(made: DataFrame, dataset: DataFrame) -> DataFrame:
    """QA examples per chunk size, through a completions table that fails for some prompts."""
    asked = evaluation.question_prompts(made, evaluation.GENERATIONS, ["chunk_size"], seed=5)
    asked = checkpointed(evaluation.with_metadata(asked, dataset, "row"))
    context = F.col("Wiki_content")
    done = asked.filter(F.length(context) % 5 != 0).select(
        "prompt_id",
        F.concat(F.lit("Question: what of "), F.split_part(context, F.lit(" "), F.lit(1)),
                 F.lit("?\nAnswer: "), F.substring(context, 1, 40), F.lit("\n")).alias("text"),
    ).dropDuplicates(["prompt_id"])
    return evaluation.parsed_questions(asked, done, ["chunk_size", "id"])


@query
def question_answer_pairs(spark, sf):
    """Sample, ask, parse; failed generations drop out."""
    return _examples(*_stored_chunks(spark, sf)).select(
        "chunk_size", "id.doc_id", "id.chunk_no", "qa_context", "question", "reference_answer", "qa_meta.Team_Name"
    )


@query
def pending_questions(spark, sf):
    """First example per question that an earlier run has not answered."""
    rows = data.run_results(spark, sf).withColumn("question", F.col("props"))
    done = rows.filter(F.col("eval_score") == 5).select("chunk_size", "question")
    todo = evaluation.pending_questions(
        rows.select("chunk_size", "question", "embedding_model", F.lit(0).alias("o")), done, ["chunk_size"], ["embedding_model"]
    )
    return todo.select("chunk_size", "question", "embedding_model")


_CONFIG = ["chunk_size", "embedding_model"]


def _grid(spark, sf) -> tuple[DataFrame, DataFrame, list, DataFrame]:
    """(pending questions, points, models, dataset) of the whole grid: four chunk sizes and three models."""
    made, dataset = _stored_chunks(spark, sf)
    models = [index.hashed_model(name, dim) for name, dim in zip(evaluation.MODEL_NAMES, (64, 32, 16))]
    grid = evaluation.configuration_grid(spark, evaluation.CHUNK_SIZES, [m.name for m in models])
    path = scratch_path(spark, "grid-points")
    points = evaluation.grid_points(made, grid, models, lambda id: packed_id(id["doc_id"], id["chunk_no"]), row="row")
    tables.write_table(points, path, partition_by=_CONFIG)
    examples = evaluation.first_questions(_examples(made, dataset), ["chunk_size"], ["id"]).drop("id")
    return examples.join(grid, "chunk_size"), tables.read_table(spark, path), models, dataset


def _answered(spark, pending: DataFrame, points: DataFrame, models: list, dataset: DataFrame) -> DataFrame:
    """A run over the pending questions, whose completions lack every seventh length of question."""
    path = scratch_path(spark, "prompts")
    tables.write_table(evaluation.run_prompts(pending, points, models, _CONFIG, dataset=dataset), path)
    prompted = tables.read_table(spark, path)
    known = prompted.filter(F.length("question") % 7 != 0).groupBy("prompt_id").agg(F.concat(F.lit("On: "), F.max("question")).alias("text"))
    return evaluation.answered_results(prompted, known, _CONFIG, "data/table")


@query
def grid_run(spark, sf):
    """All configurations in one job: each question searches its own configuration's points."""
    return _answered(spark, *_grid(spark, sf)).select(
        "chunk_size", "embedding_model", "question", "test_settings", "answer",
        F.array_join(F.transform("retrieved", lambda p: p["Team_Name"]), ",").alias("teams"),
    )


@query
def retrieval_quality(spark, sf):
    """Hit rate and mean reciprocal rank of each configuration of the grid."""
    pending, points, models, dataset = _grid(spark, sf)
    rows = evaluation.run_prompts(pending, points, models, _CONFIG, dataset=dataset).withColumn("retrieved_texts", F.transform("retrieved", lambda p: p["Wiki_content"]))
    made = scores.retrieval_quality(rows, _CONFIG)
    return made.select("chunk_size", "embedding_model", "n_questions", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


def _evaluated(spark, sf) -> DataFrame:
    """The whole evaluation: half of the questions answered and stored, the run resumed, all results graded."""
    pending, points, models, dataset = _grid(spark, sf)
    path = scratch_path(spark, "run")
    results.write_results(_answered(spark, pending.filter(F.length("question") % 2 == 0), points, models, dataset), path)
    done = results.read_results(spark, path)
    todo = evaluation.pending_questions(pending, done, _CONFIG, ["qa_context"])
    whole = scratch_path(spark, "run")
    results.write_results(evaluation.resume_run(done, _answered(spark, todo, points, models, dataset)), whole)
    stored = results.read_results(spark, whole)
    grade = F.concat(F.lit("Score: "), (F.length("question") % 6).cast("string"))
    grades = evaluation.judge_prompts(stored).groupBy("prompt_id").agg(F.max(grade).alias("text"))
    return evaluation.judged_results(stored, grades).withColumn("settings", px.results_file_name(F.col("chunk_size"), F.col("embedding_model")))


@query
def evaluation_scores(spark, sf):
    """Examples to answers to grades: the report over what the evaluation itself stored."""
    made = report.score_report(_evaluated(spark, sf))
    return made.select("settings_name", F.round("avg_score", 9).alias("avg_score"))


@query
def evaluation_choice(spark, sf):
    """The configuration that the evaluation chooses."""
    return report.choose_configuration(_evaluated(spark, sf))


@query
def judged_answers(spark, sf):
    """Judge prompts for all turns and the grades parsed from stored completions."""
    turns = _completions(spark, sf)
    answers = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("role").alias("question"), F.col("text").alias("answer"), F.col("role").alias("reference_answer")
    )
    keyed = evaluation.judge_prompts(answers)
    grades = keyed.join(turns, ["conv_id", "turn"]).groupBy("prompt_id").agg(F.min("completion").alias("text"))
    return evaluation.judged_results(answers, grades).select("conv_id", "turn", "eval_score")


@query
def judge_prompts(spark, sf):
    answers = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("role").alias("question"), F.col("text").alias("answer"), F.lit("none").alias("reference_answer")
    )
    return evaluation.judge_prompts(answers).select("conv_id", "turn", F.element_at("messages", 2)["content"].alias("content"))


@query
def resumed_run(spark, sf):
    """A stored run, resumed: earlier results stay, new ones join them, none twice."""
    path = scratch_path(spark, "run")
    rows = data.run_results(spark, sf).withColumn("question", F.col("props")).select("chunk_size", "question", "eval_score")
    empty = tables.read_or_empty(spark, path, rows.schema)
    first = evaluation.pending_questions(rows.filter(F.col("eval_score") > 2), empty, ["chunk_size"], ["eval_score"])
    tables.write_table(first.select(rows.columns), path)
    done = tables.read_or_empty(spark, path, rows.schema)
    fresh = evaluation.pending_questions(rows, done, ["chunk_size"], ["eval_score"])
    return evaluation.resume_run(done, fresh)


def _scored(spark, sf) -> DataFrame:
    """Graded rows as a scan of result files would give them."""
    size, model = F.col("chunk_size"), F.col("embedding_model")
    return data.run_results(spark, sf).select(
        "question", "eval_score", F.concat(F.lit("out/"), px.results_file_name(size, model)).alias("settings"),
        px.encode_config(F.lit("data/table"), size, model).alias("test_settings"),
    )


@query
def score_report(spark, sf):
    made = report.score_report(_scored(spark, sf))
    return made.select("settings_name", F.round("avg_score", 9).alias("avg_score"))


@query
def best_configuration(spark, sf):
    made = report.find_best_configuration(_scored(spark, sf))
    return made.withColumn("best_score", F.round("best_score", 9))


@query
def chosen_configuration(spark, sf):
    """The best configuration where scores exist, and the default where none do."""
    rows = _scored(spark, sf)
    ungraded = rows.withColumn("eval_score", F.lit(0))
    return report.choose_configuration(rows).unionByName(report.choose_configuration(ungraded))


@query
def term_pairs(spark, sf):
    """How often terms stand close to each other, over all chunks."""
    chunks = data.document_chunks(spark, sf).select(chunking.chunk_text().alias("text"))
    path = scratch_path(spark, "pair-chunks")
    tables.write_table(chunks, path)
    stored = tables.read_table(spark, path)
    return learned.pair_counts(stored, learned.vocabulary(stored))


@query
def learned_retrieval(spark, sf):
    """Each document's first chunk, asked for by its last sentence: vectors learned from the chunks beat hashed ones."""
    path = scratch_path(spark, "asked-chunks")
    last = F.element_at("sentences", -1)
    tables.write_table(data.document_chunks(spark, sf).select("id", "chunk_no", chunking.chunk_text().alias("text"), last.alias("question")), path)
    chunks = tables.read_table(spark, path)
    models = [index.hashed_model("hashed", DIM), index.loaded_model("learned", DIM, learned.loader(chunks, learned.learn(chunks, dim=DIM)))]
    quality = []
    for m in models:
        asked = chunks.filter("chunk_no = 0").select(F.col("id").alias("qid"), m.embed_query(F.col("question")).alias("vector"))
        hits = knn.nearest(asked, chunks.select("id", m.embed(F.col("text")).alias("vector")), DIM)
        place = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id")))["id"].alias("retrieved"))
        quality.append(scores.retrieval_quality(place, [], "qid", "retrieved").select("n_questions", F.col("mrr").alias(m.name)))
    both = quality[0].join(quality[1], "n_questions")
    return both.select("n_questions", (F.col("learned") > F.col("hashed")).alias("finds_more"))


@query
def score_intervals(spark, sf):
    """Bounds of every configuration's mean score, and how often it wins, over resampled questions."""
    asked = F.floor(F.split_part("question", F.lit(" "), F.lit(2)).cast("long") / 20)  # twenty events grade one question
    made = scores.score_intervals(_scored(spark, sf).withColumn("question", asked))
    return made.select("settings", "n_scored", *[F.round(c, 9).alias(c) for c in ("avg_score", "low", "high", "win_share")])


# --- index --------------------------------------------------------------------------------------


@query
def built_index(spark, sf):
    """Projects to a stored collection: chunk, summarise, embed, upsert; then read it."""
    rows = data.projects(spark, sf).withColumn("Wiki_content", tx.clean_text(F.col("Abstract")))
    model = index.hashed_model(dim=DIM)
    points = index.build_points(rows, "doc_id", 250, model, packed_id)
    stored = Collection(spark, scratch_path(spark, "collections"), "projects")
    index.store_points(stored, points, model)
    rows = stored.points().select("id", "payload.Wiki_content", "payload.Team_Name", "vector")
    return components(rows, ["id", "Wiki_content", "Team_Name"])


@query
def production_run(spark, sf):
    """The production chain: CSV, year, site text, summarised chunks, vectors, collection, answers."""
    csv, prepared = scratch_path(spark, "projects-csv"), scratch_path(spark, "prepared")
    rows = data.projects(spark, sf)
    tables.write_projects(rows.withColumn("Location", F.col("doc_id").cast("string")).drop("doc_id"), csv)
    made = dataset.prepared_dataset(spark, csv, data.page_tree(spark, sf), prepared).withColumn("pid", F.col("Location").cast("long"))
    model = index.hashed_model(dim=DIM)
    wiki = Collection(spark, scratch_path(spark, "collections"), "wiki")
    index.store_points(wiki, index.build_points(made, "pid", 250, model, packed_id, spread=True), model)
    asked, stored = data.questions(spark, sf), wiki.points()
    path = scratch_path(spark, "prompts")
    tables.write_table(answer.with_prompts(asked, answer.retrieve(asked, stored, model)), path)
    prompted = tables.read_table(spark, path)
    known = prompted.filter(F.col("qid") % 7 != 0).groupBy("prompt_id").agg(F.concat(F.lit("On: "), F.max("question")).alias("text"))
    return answer.with_completions(prompted, known, "answer").select(
        "qid", "answer", F.array_join(F.transform("retrieved", lambda p: p["Team_Name"]), ",").alias("teams"),
        F.md5(F.array_join(F.transform("retrieved", lambda p: p["Wiki_content"]), "|").cast("binary")).alias("contents"),
    )


# --- streaming ----------------------------------------------------------------------------------


ROWS_PER_FILE = 100_000


def _files_per_batch(df: DataFrame, batches: int) -> int:
    """Files of bounded size that make up each of some batches."""
    return max(1, math.ceil(df.count() / (batches * ROWS_PER_FILE)))


def _as_files(spark, df: DataFrame, name: str, files: int = 3, *by: str) -> str:
    path = scratch_path(spark, name)
    df.repartition(files, *by).write.parquet(path)
    return path


@query
def stream_ingest(spark, sf):
    """Documents arriving in files become points of a collection, batch by batch."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("edition"))
    earlier = docs.filter("doc_id % 5 = 0").withColumn("text", F.reverse("text")).withColumn("edition", F.lit(0))
    both = docs.unionByName(earlier)  # every fifth document comes in two editions, in one batch
    share = _files_per_batch(both, 3)
    stream = jobs.read_files(spark, _as_files(spark, both, "docs", 3 * share, "doc_id"), both.schema, files_per_batch=share)

    def to_points(batch: DataFrame) -> DataFrame:
        newest = batch.groupBy("doc_id").agg(F.max_by("text", "edition").alias("text"), F.max("edition").alias("edition"))
        clean = newest.select("doc_id", "edition", tx.clean_text(F.col("text")).alias("text"))
        chunked = chunking.chunk_documents(clean, CHUNK_SIZE, ["doc_id", "edition"], sentences=tx.distinct_sentences)
        content = chunking.chunk_text()
        return chunked.select(
            packed_id(F.col("doc_id"), F.col("chunk_no")).alias("id"),
            embedding.hashed_embedding(content, DIM).alias("vector"),
            F.struct(content.alias("Wiki_content")).alias("payload"), "edition",
        )

    made = Collection(spark, scratch_path(spark, "collections"), "stream")
    jobs.ingest(stream, to_points, made, index.hashed_model(dim=DIM), scratch_path(spark, "ckpt"), "edition").awaitTermination()
    return made.points().select("id", "payload.Wiki_content", F.size("vector").alias("dim"))


@query
def stream_questions(spark, sf):
    """Each distinct question once, over several batches."""
    rows = table(spark, sf, "events").select(F.col("props").alias("question"))
    stream = jobs.read_files(spark, _as_files(spark, rows, "questions"), rows.schema, files_per_batch=1)
    out = scratch_path(spark, "distinct")
    jobs.append_new_questions(stream, out, scratch_path(spark, "ckpt")).awaitTermination()
    return spark.read.schema("question string, batch long").parquet(out).select("question")


@query
def stream_first_questions(spark, sf):
    """Each distinct question once, by keyed state with a time to live, over a restart of the stream."""
    rows = table(spark, sf, "events").select(F.col("props").alias("question"))
    folder = _as_files(spark, rows.filter("hash(question) % 2 = 0"), "questions", 2)
    stream = jobs.read_files(spark, folder, rows.schema, files_per_batch=2)
    out, checkpoint = scratch_path(spark, "first-seen"), scratch_path(spark, "ckpt")
    seen.store_first_seen(stream, out, checkpoint, ttl_ms=24 * 3600 * 1000).awaitTermination()
    rows.repartition(2).write.mode("append").parquet(folder)
    seen.store_first_seen(stream, out, checkpoint, ttl_ms=24 * 3600 * 1000).awaitTermination()
    return spark.read.schema(seen.SCHEMA).parquet(out)


@query
def stream_search(spark, sf):
    """Arriving questions searched in a stored collection."""
    points = tables.materialize_once(spark, scratch_path(spark, "points"), lambda: _points(spark, sf))
    rows = data.questions(spark, sf)
    stream = jobs.read_files(spark, _as_files(spark, rows, "asked"), rows.schema, files_per_batch=1)
    out = scratch_path(spark, "hits")
    jobs.search_stream(stream, points, index.hashed_model(dim=DIM), out, scratch_path(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(out).select("qid", "rank", "id", "score")
