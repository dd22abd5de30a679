"""Queries at size: what they keep in memory and what leaves a task, on rows built here."""

from pageloom.registry.queries import QUERIES


def tables(spark, folder, docs=30, asked=8):
    texts = [f"Word{i} alpha beta{i % 3}. Gamma delta word{i}. And so on {'very ' * i}long." for i in range(docs)]
    rows = [(i, t, ["en", "de"][i % 2], "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    turns = [(c, t, ["user", "assistant"][t], texts[c][:20] if c % 2 else "alpha beta1") for c in range(asked) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_answers_keep_no_texts_of_hits_in_memory(spark, tmp_path):
    sf = tables(spark, tmp_path / "in")
    spark.catalog.clearCache()
    rows = QUERIES["batch_answers"](spark, sf).collect()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    hits = {}
    for r in QUERIES["question_hits"](spark, sf).collect():
        hits.setdefault(r["qid"], []).append((r["rank"], r["id"] >> 24))
    assert len(rows) == 8 and {r["qid"]: r["teams"] for r in rows} == {q: ",".join(f"Team {d}" for _, d in sorted(found)) for q, found in hits.items()}
    # equal questions have one prompt, whose completion is stored unless every seventh question alone asks it
    assert all(r["answer"] == f"On: {r['question']}" for r in rows if r["qid"] % 7)
