"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pageloom.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = [
    None, "", " ", "a", "I'll don't 'S 12 34", "  x 　　 y\u0085​ z", "é😀 日本語 ñandú ½ ²", "  \n\n\t x  ", "x" * 3000,
    "ab" * 30000, "\n" * 5000 + "end", "!?" * 700, "<|endoftext|>", "\x00\x1c\x1f \x7f", " ".join(f"word{i % 7}" for i in range(5000)),
]


def ids_of(text):
    return LIBRARY.encode_ordinary(text or "")


@pytest.mark.parametrize("hot", [1 << 19, 3, 0])
def test_ids_match_the_library(spark, documents, hot):
    rng = random.Random(1)
    alphabet = "abcdefgh étßñ 日12'.,\n\t" + chr(0x10400)
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(3, "a")]
    encoded = bpe.with_ids(documents(rows, "ids", "word"), RANKS, public_tokenizers.PATTERN, hot_words=hot)
    got = encoded.select("doc_id", "text", "ids", "word", bpe.decoded(F.col("ids"), RANKS).alias("bytes")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == ids_of(r["text"]), repr(r["text"])[:80]
        assert bytes(r["bytes"]) == (r["text"] or "").encode() and r["word"] == "clash"


def test_long_merge_is_the_fold(spark):
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choice(b"abe th\xc3\xa9") for _ in range(rng.randint(1, 60)))
        assert bpe.merge_long(data, RANKS) == bpe.merge_one(data, RANKS) == LIBRARY._encode_single_piece(data)


def test_fold_is_the_library(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abe thé日") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = frame.select("word", bpe.with_table(RANKS, lambda t: bpe.fold_merges(F.col("word"), t)).alias("ids")).collect()
    for r in got:
        assert r["ids"] == LIBRARY._encode_single_piece(r["word"].encode())


def test_rank_map_is_a_literal(spark, documents):
    frame = documents([(1, "a")]).select(bpe.with_table(RANKS, lambda t: bpe.fold_merges(F.col("text"), t)).alias("ids"))
    assert "from_json" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_empty_table(spark, documents):
    assert bpe.with_ids(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf):
    texts = dict(queries.table(spark, sf, "documents").select("doc_id", "text").collect())
    got = queries.op3_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ids_of(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
