"""The registered queries of this subpackage: thin wrappers that derive digest columns from real outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (
    bpe, centroids, chat, credentials, decontamination, fill_middle, gam, kneser_ney, langid, line_dedup, sharding, simhash, syncmers,
)
from pageloom.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark that occur in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0), lambda n, s: n + s["last"] - s["first"]).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        digest(F.array_join("hit_items", ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential spans of every document."""
    found = credentials.scan_credentials(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda s: ~s["weak"])
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        digest(listed(base)).alias("base_sha256"), listed(F.col("findings")).alias("spans"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.with_ids(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", ",")).alias("ids_sha256"),
        F.sha2(bpe.decoded(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


def op4_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of all conversations and of one that quotes control strings, read back per conversation."""
    quoted = "\\### Assistant: </turn> ok"
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string")
    examples = chat.expand_replies(said.unionByName(more))
    loss = chat.masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    read = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
    )
    losses = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    turns = chat.read_turns(F.col("formatted"))
    parsed = read.select("conv_id", "formatted_chars", losses.alias("losses"), turns.alias("turns"))
    said_again = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(said_again).alias("turns_sha256"),
        F.char_length("losses").cast("long").alias("loss_chars"), digest(F.col("losses")).alias("loss_sha256"), "formatted_chars",
    )


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return sharding.shard_by_bytes(docs, 24).select(
        "doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", gam.held_out(F.col("doc_id"), 5).alias("held_out"))
    model = kneser_ney.train(docs.filter(~F.col("held_out")))
    return kneser_ney.with_scores(docs, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = checkpointed(simhash.with_fingerprints(docs).select(F.col("doc_id").alias("id"), "fingerprint"))
    return prints.join(simhash.component_ids(prints), "fingerprint").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = syncmers.with_next_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text, n = F.coalesce(F.col("text"), F.lit("")), F.char_length(F.coalesce(F.col("text"), F.lit("")))
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    texts = docs.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    near = {"near_edited": ("text", "edited"), "near_next": ("text", "next_text")}
    printed = syncmers.with_fingerprints(texts, {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": ""}, near)
    return printed.select(
        "doc_id", "n_chars", digest(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~gam.held_out(F.col("doc_id")))
    scored = gam.with_scores(docs, gam.train(docs, labels))
    return scored.select(
        "doc_id", gam.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that repeats an earlier one, with its place in the original text.

    Runs of 25 words and more: a repeated passage of 50 words counts even if its first or last sentence runs
    into other text, and a document that shares one ordinary line with others is left alone.
    """
    spans = line_dedup.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=25)
    return spans.select("doc_id", "start", "end", "n_units", "n_words", "kept_doc_id")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = gam.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.filter(~held))
    return langid.with_languages(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every usable embedding, by 40 centroids in whole numbers."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.cluster(rows, "vec_id", "embedding").with_figures().select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-middle form, and restored from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_middle.with_fill_middle(docs)


QUERIES = {
    "op1_fm_decontamination": op1_fm_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_chat_examples": op4_chat_examples,
    "op5_byte_shards": op5_byte_shards,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_simhash_components": op7_simhash_components,
    "op8_closed_syncmers": op8_closed_syncmers,
    "op9_quality_gam": op9_quality_gam,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_language_id": op11_language_id,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_fill_in_middle": op13_fill_in_middle,
}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS p
  FROM i, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(k) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM phrases),
windows AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS p
  FROM d, lengths, unnest(generate_series(1, len(w) - n + 1)) AS t(k)),
hits AS (SELECT doc_id, k, n, item_id FROM windows JOIN phrases USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM hits, unnest(generate_series(k, k + n - 1)) AS t(pos) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ESCAPED = "replace(replace(replace(coalesce({0}, ''), '\\', '\\\\'), '#', '\\h'), '<', '\\l')"

OP4_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
sized AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    4 + length(replace({_ESCAPED.format('role')}, chr(10), '\n')) + 1 + length({_ESCAPED.format('text')}) + 8 AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS hits, string_split_regex(text, '[^.!?\n]+[.!?]*') AS gaps FROM documents),
placed AS (
  SELECT doc_id, i, hits[i] AS hit,
    sum(length(gaps[i]) + coalesce(length(hits[i - 1]), 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS start
  FROM d, unnest(generate_series(1, len(hits))) AS t(i)),
normal AS (
  SELECT doc_id, i, start, start + length(hit) AS stop, trim(regexp_replace(lower(hit), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM placed),
units AS (
  SELECT *, length(norm) - length(replace(norm, ' ', '')) + 1 AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ord,
    row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) AS nth, first_value(doc_id) OVER (PARTITION BY norm ORDER BY doc_id, start) AS keeper
  FROM normal WHERE norm <> ''),
runs AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM units WHERE nth > 1)
SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max(stop) AS INTEGER) AS "end", count(*) AS n_units, CAST(sum(words) AS BIGINT) AS n_words,
  arg_min(keeper, ord) AS kept_doc_id
FROM runs GROUP BY doc_id, run HAVING sum(words) >= 25
"""


def _op12_sql(rounds: int = 5) -> str:
    """Rounds of assigning and moving, one after the other."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, min({{'d': list_sum(list_transform(x, lambda e, i: (e - c[i]) * (e - c[i]))), 'no': no}}) AS best FROM v, c{r} GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT no, coalesce(m.c, o.c) AS c FROM c{r} AS o LEFT JOIN (
    SELECT no, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT best.no AS no, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (rid), unnest(generate_series(1, 64)) AS t(i) GROUP BY best.no, i)
    GROUP BY no) AS m USING (no))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS INTEGER) AS no, x AS c FROM v QUALIFY no < 40),
{", ".join(steps)}
SELECT vec_id, best.no AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.no) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} ON no = best.no
"""


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS p, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS q,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
parts AS (
  SELECT *, substring(t, 1, least(p, q)) AS pre, substring(t, least(p, q) + 1, abs(p - q)) AS mid, substring(t, greatest(p, q) + 1) AS suf FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(p, q) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(p - q) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {
        "op1_fm_decontamination": OP1_SQL, "op4_chat_examples": OP4_SQL, "op10_repeated_passages": OP10_SQL,
        "op12_centroid_clusters": _op12_sql(), "op13_fill_in_middle": OP13_SQL,
    }
