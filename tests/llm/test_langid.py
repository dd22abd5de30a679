"""Language identification against a plain dictionary version, and on held-out rows."""

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import langid, queries

MASK = (1 << 64) - 1
MIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]


def plain_buckets(text, bits):
    out, blank = [], False
    for c in f" {(text or '').lower()} ":
        if unicodedata.category(c)[0] in "LM":
            out.append(ord(c))
            blank = False
        elif not blank:
            out.append(32)
            blank = True
    found = []
    for n in langid.SIZES:
        for at in range(len(out) - n + 1):
            value = 0
            for k in range(1, n + 1):
                value = ((value ^ out[at + k - 1]) * MIX[k % 4]) & MASK
                value ^= value >> 29
            found.append(((value * MIX[0]) & MASK) >> (64 - bits))
    return found


def plain_predictions(rows, texts, bits):
    """rows: (text, lang). Counters, logarithms rounded to 2 ** -16, sums."""
    counts, said = {}, Counter(lang for _, lang in rows if lang is not None)
    for text, lang in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(plain_buckets(text, bits))
    unit, out = 1 << 16, []
    for text in texts:
        if not said or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out.append(("und", 0.0))
            continue
        sums = {}
        for lang in sorted(said):
            total = sum(counts[lang].values()) + langid.ADDED * (1 << bits)
            sums[lang] = round(math.log(said[lang] / sum(said.values())) * unit) + sum(
                round(math.log((counts[lang][b] + langid.ADDED) / total) * unit) for b in plain_buckets(text, bits)
            )
        best = max(sums, key=lambda name: sums[name])
        out.append((best, 1 / sum(math.exp((s - sums[best]) / unit) for s in sums.values())))
    return out


ROWS = [
    ("Der schnelle Fuchs springt über den Zaun", "de"), ("the quick brown fox jumps over the fence", "en"), ("le renard brun saute", "fr"),
    ("the dog", "en"), (None, "en"), ("", "de"), ("123 !!", "xx"), ("хорошо на улице", "ru"), ("no language", None), ("blank name", ""),
    ("the dog", "en"), ("हिन्दी में", "hi"), ("aİb 😀 ΣΑΣ".encode("utf-16", "surrogatepass").decode("utf-16"), "tr"),
]
ASKED = [t for t, _ in ROWS] + ["fox", "Fuchs", "x" * 50, "42", "́", "the the the " * 300, "ab " * 9 + "\n\t--" * 40 + "über"]


@pytest.mark.parametrize("piece", [16, 1 << 17])
def test_equals_plain_version(spark, monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "BITS", 10)
    model = langid.train(spark.createDataFrame(ROWS, "text string, lang string").repartition(3))
    wanted = plain_predictions(ROWS, ASKED, 10)
    asked = spark.createDataFrame(list(enumerate(ASKED)), "doc_id long, text string")
    made = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.with_languages(asked, model).collect()}
    for i, (lang, score) in enumerate(wanted):
        assert made[i][0] == lang, ASKED[i]
        assert made[i][1] == pytest.approx(score, abs=1e-9)


def test_counts_leave_a_task_when_many_languages_are_held(spark, monkeypatch):
    monkeypatch.setattr(langid, "BITS", 10)
    monkeypatch.setattr(langid, "HELD_CELLS", 2 << 10)
    docs = spark.createDataFrame(ROWS * 3, "text string, lang string").coalesce(1)
    few = langid.train(docs)
    monkeypatch.setattr(langid, "HELD_CELLS", 1 << 24)
    many = langid.train(docs)
    assert few.languages == many.languages and (few.logs == many.logs).all() and (few.prior == many.prior).all()


def test_buckets_halve_as_languages_double(spark, monkeypatch):
    monkeypatch.setattr(langid, "MATRIX_CELLS", 1 << 12)
    docs = spark.createDataFrame([(f"word{chr(97 + i)}", f"l{i:02d}") for i in range(16)], "text string, lang string")
    assert langid.train(docs).bits == 8
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 10)
    with pytest.raises(ValueError):
        langid.train(docs)


def test_cases(spark, documents):
    docs = documents([(1, "hello there"), (1, "hello there"), (2, None), (3, ""), (None, "über"), (4, "1 2 3")], "lang_pred", "score", "block", "counts")
    made = langid.with_languages(docs, langid.train(docs))
    assert set(made.columns) == set(docs.columns)
    rows = made.collect()
    assert len(rows) == 6
    assert {(r["doc_id"], r["lang_pred"]) for r in rows} == {(1, "en"), (2, "und"), (3, "und"), (None, "en"), (4, "und")}
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in rows) and all(r["block"] == "clash" for r in rows)


def test_empty_tables(spark, documents):
    none = documents([])
    model = langid.train(none)
    assert langid.with_languages(none, model).collect() == []
    made = langid.with_languages(documents([(1, "words")]), model).first()
    assert (made["lang_pred"], made["score"]) == ("und", 0.0)


def test_a_very_long_text(spark, documents):
    long = "the quick brown fox " * 100_000
    docs = documents([(1, long), (2, "the fox")])
    made = langid.with_languages(docs, langid.train(docs)).collect()
    assert [r["lang_pred"] for r in made] == ["en", "en"]


def test_ties_take_the_first_language():
    model = langid.model_of(["aa", "bb"], np.ones(2), np.ones((2, 16), np.int64), 4, langid.character_kinds())
    assert model.predict(["words"], langid.kind_table(model.runs)) == (["aa"], pytest.approx([0.5]))


def test_held_out_rows(spark, sf):
    made = queries.op11_language_id(spark, sf)
    assert made.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = made.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_nothing_held_out_is_learned(spark, sf, tmp_path):
    """Other labels and texts in the held-out fold leave every other prediction as it was."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    changed = docs.withColumns({"lang": F.when(held, "zz").otherwise(F.col("lang")), "text": F.when(held, F.reverse("text")).otherwise(F.col("text"))})
    changed.write.parquet(f"{tmp_path}/documents.parquet")
    read = lambda path: {(r["doc_id"], r["lang_pred"], r["score"]) for r in queries.op11_language_id(spark, path).filter("NOT held_out").collect()}
    assert read(str(tmp_path)) == read(sf)
