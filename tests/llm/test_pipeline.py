"""The corpus pipeline against the same stages on plain values."""

import os
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from pageloom.llm import bpe, gam, queries, simhash
from tests_llm_brute import base_spans_masked, cut_windows, roots_of  # noqa: I001


def brute(spark, sf):
    docs = queries.table(spark, sf, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = queries.table(spark, sf, "labels")
    model = gam.train(docs, labels.filter(~gam.held_out(labels["doc_id"])))
    good = {i: r["text"] for i, r in rows.items() if model.score(gam._matrix([r["text"]]))[0] >= 0.5}
    prints = {i: simhash.fingerprint(t) for i, t in good.items()}
    roots = roots_of(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    kept, seen = {}, set()
    for i in sorted(good):
        if roots[prints[i]] not in seen:
            seen.add(roots[prints[i]])
            kept[i] = good[i]
    items = [r["text"] for r in queries.table(spark, sf, "benchmark").collect()]
    kept = cut_windows(kept, items)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    return rows, kept, library


def test_run(spark, sf):
    rows, kept, library = brute(spark, sf)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(kept)
    assert 0 < len(got) < len(rows)
    for i, text in kept.items():
        found = library.decode(got[i]["ids"])
        assert found == base_spans_masked(text) or "[REDACTED]" in found
        assert got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["n_chars"] == len(found)
        assert got[i]["ids"] == library.encode_ordinary(found)
        assert not re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", found)


ROWS = [
    (4, "A clean text about rivers and hills. It has some words."), (2, "A clean text about rivers and hills. It has some words."),
    (2, "A clean text about rivers and hills. It has some words."), (7, None), (6, ""), (None, "no id but a text of its own kind"),
    (9, "secret=abcdefghijklmnop in an otherwise plain text of nine words"), (None, None), (8, "long " * 30000),
]


def test_cases(spark, documents, sf):
    names = ["score", "fingerprint", "root", "findings", "ids", "n_words", "hit_spans", "hit_items", "component_id", "id", "x", "_text", "n_tokens"]
    docs = documents(ROWS, *names)
    assert docs.count() == len(ROWS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        empty = stage(spark, docs.limit(0), sf)
        assert empty.collect() == []
        got = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert all(r[n] == "clash" for r in got for n in names) and all((r["lang"], r["source"]) == ("en", "s") for r in got)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
        if name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in got) == ["2", "6", "8", "9", "None"]
        elif name != "quality":
            assert len(got) == len(ROWS)
        if name == "secrets":
            assert [r["text"] for r in got if r["doc_id"] == 9] == ["[REDACTED] in an otherwise plain text of nine words"]


def test_stages_are_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    assert os.path.exists(corpus_pipeline.VOCABULARY) and pytest
