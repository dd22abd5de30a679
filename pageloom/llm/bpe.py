r"""Byte-level BPE: distinct words are encoded by a fold of ranked merges, decoding concatenates pieces.

A text is cut into words by the vocabulary's pattern. Words are counted over all documents, and the
most frequent ones (at most ``hot_words``, whatever the corpus) are encoded once each: Spark's
higher-order functions fold merges over the array of a word's bytes, always taking the leftmost pair
of the lowest rank, with the ranked merges in a literal map. The literal leads from a pair of ids to the
id of the merged piece, which is its rank; it is kept in many small buckets, since Spark searches
arrays linearly. The encoded words are broadcast, and each document looks its words up. A word that
is not among them is merged where it stands, in the Arrow step: a fold in the row costs about 60
microseconds for each, five times as much, and a word of over ``LONG_WORD`` bytes, such as a page of
unbroken letters, needs a heap. So no document is shuffled, and nothing that is broadcast grows with
the corpus.

Cases: a NULL or empty text has no ids and decodes to no bytes; decoding gives the text's UTF-8 bytes
back; repeated rows are encoded each; an empty table gives no rows. Other columns pass through, and
columns this module adds replace theirs. Character classes are those of the JVM's Unicode version.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.binding import let
from pageloom.llm import batches as bt
from pageloom.session import checkpointed

HOT_WORDS = 1 << 19
HOT_LENGTH = 64
LONG_WORD = 256
# Ids are below _WIDE - 1; a prime number of buckets spreads the pair keys.
_WIDE, _BUCKETS = 1 << 20, 32749
# Fixed value: Unicode white space, which \s means to the vocabulary's own library.
_BLANK = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a base64 piece and its rank per line. Read on the driver, shipped with the plan."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, lines))}


def java_pattern(pattern: str) -> str:
    r"""The pattern with Unicode white space for \s and \S, which are ASCII in Java."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(_BLANK if inside else f"[{_BLANK}]")
        elif two == r"\S":
            out.append(f"[^{_BLANK}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            at -= 1
        at += 2
    return "".join(out)


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def byte_chars(word: Column) -> Column:
    """The UTF-8 bytes as a string of one character each."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def pair_table(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal (constant folding makes it of the JSON text): which two ids merge into which.

    struct<first, keys, ids>: the id of each byte, and buckets of pair keys beside the ids they merge into.
    """
    keys: list[list[int]] = [[] for _ in range(_BUCKETS)]
    ids: list[list[int]] = [[] for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                key = left * _WIDE + right
                keys[key % _BUCKETS].append(key)
                ids[key % _BUCKETS].append(rank)
    table = {"first": [ranks[bytes([b])] for b in range(256)], "keys": keys, "ids": ids}
    return F.from_json(F.lit(json.dumps(table)), "struct<first:array<int>,keys:array<array<bigint>>,ids:array<array<int>>>")


def with_table(ranks: dict[bytes, int], body) -> Column:
    """``body(table)`` with one copy of the literal, bound to names for the folds inside."""
    return let(pair_table(ranks), body)


def fold_merges(word: Column, table: Column) -> Column:
    """Ids of one word, as an array; ``table`` comes from :func:`with_table`.

    The state is the ids of the pieces, between two ids that merge with nothing, and for each pair of
    neighbours the id it would merge into. An id is a rank, so the least entry is both the pair
    to merge and the new piece; the two pairs it then takes part in are looked up anew.
    """
    # slice and concat copy an array several times over; filter and transform walk it once
    edge = F.lit(_WIDE - 1)

    def merge_of(left: Column, right: Column) -> Column:
        key = left.cast("bigint") * _WIDE + right
        return let(key, lambda k: let(
            (k % _BUCKETS).cast("int"), lambda b: F.get(F.get(table["ids"], b), F.array_position(F.get(table["keys"], b), k).cast("int") - 1)
        ))

    def merged(state: Column) -> Column:
        ids, pairs = state["ids"], state["pairs"]

        def at(x: Column) -> Column:  # the new id, and the place of its pair; an edge is on either side
            new, p = x["new"], x["p"]
            return F.struct(
                F.transform(F.filter(ids, lambda _, i: i != p + 1), lambda v, i: F.when(i == p, new).otherwise(v)).alias("ids"),
                F.transform(
                    F.filter(pairs, lambda _, i: i != p),
                    lambda v, i: F.when(i == p - 1, merge_of(F.get(ids, p - 1), new)).when(i == p, merge_of(new, F.get(ids, p + 2))).otherwise(v),
                ).alias("pairs"),
            )

        return let(F.array_min(pairs), lambda new: F.when(new.isNull(), state).otherwise(
            let(F.struct(new.alias("new"), (F.array_position(pairs, new) - 1).cast("int").alias("p")), at)
        ))

    def folded(ids: Column) -> Column:
        pairs = F.transform(ids, lambda x, i: merge_of(x, F.coalesce(F.get(ids, i + 1), edge)))
        start = F.struct(ids.alias("ids"), pairs.alias("pairs"))
        done = F.aggregate(F.sequence(F.lit(3), F.size(ids)), start, lambda s, _: merged(s))["ids"]
        return F.filter(done, lambda x: x != edge)

    def bytes_of(chars: Column) -> Column:
        n = F.char_length(chars)
        return F.transform(F.sequence(F.lit(0), n + 1), lambda i: F.when((i == 0) | (i > n), edge).otherwise(F.get(table["first"], F.ascii(F.substring(chars, i, F.lit(1))))))

    return let(let(byte_chars(word), bytes_of), folded)


def merge_long(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one very long word: neighbours in linked lists, pairs in a heap."""
    n = len(data)
    ends, following, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int):
        j = following[i]
        return ranks.get(data[i : ends[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, end = heapq.heappop(heap)
        if not alive[i] or following[i] >= n or ends[following[i]] != end:
            continue
        j = following[i]
        alive[j] = False
        ends[i], following[i] = ends[j], following[j]
        if following[i] < n:
            before[following[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, ends[following[k]]))
    return [ranks[data[i : ends[i]]] for i in range(n) if alive[i]]


def merge_one(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one rare word."""
    if data in ranks:
        return [ranks[data]]
    if len(data) > LONG_WORD:
        return merge_long(data, ranks)
    pieces = [data[i : i + 1] for i in range(len(data))]
    pairs = [ranks.get(a + b, _WIDE) for a, b in zip(pieces, pieces[1:])]
    while pairs and (least := min(pairs)) < _WIDE:
        i = pairs.index(least)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(pieces[i] + pieces[i + 1], _WIDE)
        if i:
            pairs[i - 1] = ranks.get(pieces[i - 1] + pieces[i], _WIDE)
    return [ranks[p] for p in pieces]


def count_words(docs: DataFrame, text: str, pattern: str) -> DataFrame:
    """(word, n) over all documents; counted in the tasks before the shuffle."""
    return docs.select(F.explode(words_of(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def hot_vocabulary(counts: DataFrame, ranks: dict[bytes, int], most: int = HOT_WORDS) -> pa.Table:
    """(word, ids) of the most frequent words, at most ``most`` of them and none long.

    The least count comes from a histogram of counts, so nothing is sorted.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    short = counts.filter(F.char_length("word") <= HOT_LENGTH)
    histogram = sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, held = None, 0
    for row in histogram:
        held += row["count"]
        if held > most:
            break
        least = row["step"]
    chosen = short.filter(step >= least) if least is not None else short.limit(0)
    ids = with_table(ranks, lambda t: fold_merges(F.col("word"), t))
    return chosen.select("word", ids.alias("ids")).toArrow()


def with_ids(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", into: str = "ids", hot_words: int = HOT_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the ids of each text as array<int>. ``keep``: the columns to carry along, all by default."""
    counts = checkpointed(count_words(docs, text, pattern))
    vocabulary = hot_vocabulary(counts, ranks, hot_words)
    context = docs.sparkSession.sparkContext
    ids = vocabulary["ids"].combine_chunks()
    tables = context.broadcast((
        vocabulary["word"].combine_chunks().cast(pa.string()),
        ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32),
        np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64),
    ))
    shared_ranks = context.broadcast(ranks)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (into, "_words")]
    cut = docs.select(*kept, words_of(F.col(text), pattern).alias("_words"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema][:-1], f"`{into}` array<int>"])

    def look_up(batches):
        words, table, bounds = tables.value
        for batch in bt.by_rows(batches):
            column = batch.column(batch.num_columns - 1)
            flat, ends = column.flatten(), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            place = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False)
            missed = np.flatnonzero(place < 0)
            own_table, own_bounds = table, bounds
            if len(missed):
                rare = flat.take(pa.array(missed)).dictionary_encode()
                found = [merge_one(w.encode("utf-8", "surrogatepass"), shared_ranks.value) for w in rare.dictionary.to_pylist()]
                place = place.copy()
                place[missed] = len(bounds) - 1 + rare.indices.to_numpy(zero_copy_only=False)
                own_table = np.concatenate([table, *[np.array(f, np.int32) for f in found]])
                own_bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([len(f) for f in found])])
            # the ids of some rows at a time, as they are many more than the words
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                stops = ends[at : at + 64]
                start = ends[at - 1] if at else 0
                own = place[start : stops[-1]]
                sizes = own_bounds[own + 1] - own_bounds[own]
                before = np.concatenate([[0], np.cumsum(sizes)])
                ids = own_table[np.repeat(own_bounds[own] - before[:-1], sizes) + np.arange(before[-1])]
                offsets = before[np.concatenate([[0], stops - start]).astype(np.int64)]
                made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], made], names=[*kept, into])
            del column, flat, place, batch
            pa.default_memory_pool().release_unused()

    return bt.bounded(cut).mapInArrow(look_up, schema)


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of a sequence of ids."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1")
