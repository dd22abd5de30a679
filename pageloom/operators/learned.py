"""Text vectors learned from a corpus: co-occurrence counts, positive PMI, randomised decomposition.

Terms that stand close to each other are counted over all texts; the counts become positive pointwise mutual
information, and a blocked randomised decomposition of that symmetric matrix gives each term a vector. Only the
counting grows with the corpus, and its shuffle carries about one row per pair of vocabulary terms and map
task. :func:`vocabulary` and :func:`pair_counts` take any number of terms. What :func:`learn` learns from is bounded by
``max_terms``; its matrix stays in Spark, partitioned by rows, and what passes the driver are tall matrices of
``max_terms`` × (``dim`` + ``EXTRA``) numbers, 40 MB at the defaults.

Cases: a NULL or empty text has no terms and a zero vector, as has a text without a known term; a corpus
without a pair gives terms zero vectors; of equally frequent terms the first by name are kept; repeated
texts count as often as they stand. Vectors are deterministic: of a sign's two choices the one that makes a
column's largest number positive is taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.operators.embedding import Encoder
from pageloom.session import checkpointed

MAX_TERMS = 65_536
# terms that pairs are counted of by number; the others go by name
SHARED_TERMS = 65_536
WINDOW = 4
# columns of the random start beyond ``dim``, and products with the matrix between start and result
EXTRA, ROUNDS = 16, 3
# a term of this share of all terms weighs half
HALF_WEIGHT = 1e-3
# terms whose pairs a task counts at a time, distinct pairs it holds, and pairs it sends at a time
PIECE_TERMS, HELD_PAIRS, SENT_PAIRS = 1 << 18, 1 << 22, 1 << 17


def vocabulary(texts: DataFrame, text: str = "text", min_count: int = 3, max_terms: int | None = None) -> DataFrame:
    """(term, n): the terms that stand ``min_count`` times or more, commonest first; with ``max_terms`` that many at most."""
    terms = texts.select(F.explode_outer(tx.words(F.col(text))).alias("term")).filter("term IS NOT NULL")
    counts = terms.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).orderBy(F.desc("n"), "term")
    return counts if max_terms is None else counts.limit(max_terms)


def pair_counts(texts: DataFrame, terms: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(first, second, n): how often two vocabulary terms stand at most ``window`` places apart, first <= second.

    ``terms`` is (term, …) of any size. ``SHARED_TERMS`` of them, the commonest if there is a count ``n``, are broadcast, so that their
    pairs are numbered and summed on the map side. Pairs with another term, which is a rare one then, are summed by name and
    meet the vocabulary in joins by that term alone.
    """
    every = terms.filter("term IS NOT NULL").groupBy("term").agg(F.max("n" if "n" in terms.columns else F.lit(0)).alias("n"))
    every = checkpointed(every)  # taken from and joined
    # words are ASCII, so this is Spark's order as well
    known = sorted(r["term"] for r in every.orderBy(F.desc("n"), "term").limit(SHARED_TERMS).collect())
    named = texts.sparkSession.createDataFrame(list(enumerate(known)), "number int, term string")
    side = lambda number, name: F.broadcast(named.select(F.col("number").alias(number), F.col("term").alias(name)))
    pairs = _numbered_pairs(texts, known, text, window)
    shared = pairs.join(side("i", "first"), "i").join(side("j", "second"), "j").select("first", "second", "n")
    if len(known) < SHARED_TERMS or every.count() == len(known):
        return shared
    met = _named_pairs(texts, known, text, window)
    for rare in ("rare", "other"):
        met = met.join(every.select(F.col("term").alias(rare)), rare, "left_semi")
    return shared.unionByName(met.select("first", "second", "n"))


def _named_pairs(texts: DataFrame, shared: list[str], text: str, window: int) -> DataFrame:
    """(first, second, n, rare, other): pairs that are not of two ``shared`` terms, known or not.

    ``rare`` is the first of its terms that is not shared and ``other`` the last, so neither is a common term.
    """
    held = texts.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = set(held.value)
        for batch in batches:
            for words in _pieces(batch.column(0)):
                codes = words.flatten().dictionary_encode()
                # numbers in the order of the names, so that the lesser number is the first term
                found = np.array(codes.dictionary.to_pylist(), dtype=object)
                names, place = np.unique(found, return_inverse=True) if len(found) else (found, np.zeros(0, np.int64))
                numbers = place[np.asarray(codes.indices)]
                is_rare = np.array([t not in common for t in names], dtype=bool)
                row = np.repeat(np.arange(len(words)), np.asarray(words.value_lengths().fill_null(0)))
                keys = []
                for d in range(1, window + 1):
                    a, b = numbers[:-d], numbers[d:]
                    both = row[:-d] == row[d:]
                    a, b = a[both], b[both]
                    wanted = is_rare[a] | is_rare[b]
                    keys.append(np.minimum(a, b)[wanted] * len(names) + np.maximum(a, b)[wanted])
                keys, counts = np.unique(np.concatenate(keys), return_counts=True)
                terms = pa.array(names.tolist(), pa.string())
                for at in range(0, len(keys), SENT_PAIRS):
                    first, second = np.divmod(keys[at:at + SENT_PAIRS], len(names))
                    columns = [first, second, np.where(is_rare[first], first, second), np.where(is_rare[second], second, first)]
                    columns = [terms.take(pa.array(c)) for c in columns]
                    columns.insert(2, pa.array(counts[at:at + SENT_PAIRS], pa.int64()))
                    yield pa.RecordBatch.from_arrays(columns, names=["first", "second", "n", "rare", "other"])

    found = texts.select(tx.words(F.col(text)).alias("w")).mapInArrow(run, "first string, second string, n long, rare string, other string")
    return found.groupBy("first", "second").agg(F.sum("n").alias("n"), F.first("rare").alias("rare"), F.first("other").alias("other"))


def _numbered_pairs(texts: DataFrame, terms: list[str], text: str, window: int) -> DataFrame:
    """(i, j, n): :func:`pair_counts` by the places of the terms in a list of bounded size, i <= j.

    A task numbers the distinct terms of an Arrow batch and counts pairs of numbers; it holds a bounded number of
    them and sends each pair about once.
    """
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, many = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        every, many = every[order], many[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        return every[starts], np.add.reduceat(many, starts)

    def rows(keys: np.ndarray, counts: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), SENT_PAIRS):
            i, j = np.divmod(keys[at:at + SENT_PAIRS], n)
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(counts[at:at + SENT_PAIRS], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {t: i for i, t in enumerate(shared.value)}
        n, held, pending = len(places), ([], []), 0
        for batch in batches:
            for words in _pieces(batch.column(0)):
                codes = words.flatten().dictionary_encode()
                numbers = np.array([places.get(t, -1) for t in codes.dictionary.to_pylist()] or [-1])[np.asarray(codes.indices)]
                row = np.repeat(np.arange(len(words)), np.asarray(words.value_lengths().fill_null(0)))
                found = []
                for d in range(1, window + 1):
                    a, b = numbers[:-d], numbers[d:]
                    both = (row[:-d] == row[d:]) & (a >= 0) & (b >= 0)
                    a, b = a[both], b[both]
                    found.append(np.minimum(a, b) * n + np.maximum(a, b))
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                if len(keys):
                    held[0].append(keys)
                    held[1].append(counts)
                    pending += len(keys)
                if pending > HELD_PAIRS:
                    keys, counts = counted(*held)
                    held, pending = ([keys], [counts]), len(keys)
                    if pending > HELD_PAIRS // 2:
                        yield from rows(keys, counts, n)
                        held, pending = ([], []), 0
        if pending:
            yield from rows(*counted(*held), n)

    found = texts.select(tx.words(F.col(text)).alias("w")).mapInArrow(run, "i int, j int, n long")
    return found.groupBy("i", "j").agg(F.sum("n").alias("n"))


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of a bounded number of terms, or one text."""
    ends, at = np.cumsum(np.asarray(texts.value_lengths().fill_null(0), dtype=np.int64)), 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + PIECE_TERMS, side="right")))
        yield texts.slice(at, upto - at)
        at = upto


def information(counts: DataFrame, numbers: DataFrame) -> DataFrame:
    """(i, j, value): the positive entries of the symmetric PMI matrix, both halves, by term number.

    ``counts`` is (first, second, n), ``numbers`` (term, number) of bounded size. A pair of equal terms counts twice,
    once for either of its two.
    """
    named = counts.join(F.broadcast(numbers.select(F.col("term").alias("first"), F.col("number").alias("i"))), "first")
    named = named.join(F.broadcast(numbers.select(F.col("term").alias("second"), F.col("number").alias("j"))), "second")
    return _information(named.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("n").alias("n")))


def _information(pairs: DataFrame) -> DataFrame:
    """:func:`information` of counts by number, (i, j, n) with i <= j, one row a pair."""
    pairs = checkpointed(pairs.select("i", "j", (F.col("n") * F.when(F.col("i") == F.col("j"), 2).otherwise(1)).alias("n")))
    both = lambda *more: F.explode_outer(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", *more))).otherwise(
        F.array(F.struct("i", "j", *more), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *more))
    ))
    # a row per term
    sums = checkpointed(pairs.select(both("n").alias("c")).groupBy("c.i").agg(F.sum("c.n").alias("row")))
    total = sums.agg(F.sum("row")).first()[0] or 0
    known = pairs.join(F.broadcast(sums), "i").join(F.broadcast(sums.select(F.col("i").alias("j"), F.col("row").alias("column"))), "j")
    # products of counts pass 64 bits, so the logarithms are added
    value = F.log(F.col("n").cast("double")) + F.log(F.lit(float(max(total, 1)))) - F.log(F.col("row").cast("double")) - F.log(F.col("column").cast("double"))
    return known.select("i", "j", value.alias("value")).filter("value > 0").select(both("value").alias("c")).select("c.*")


def product(entries: DataFrame, tall: np.ndarray) -> np.ndarray:
    """The sparse matrix times a tall one. ``entries`` are sorted by row in each partition and no row is in two."""
    return _packed_product(_packed(entries), tall)


def _packed(entries: DataFrame) -> DataFrame:
    """(i, j, value): pieces of matrix rows, their columns and values as bytes, so that reading them again costs no row an entry."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j, value = (batch.column(c).to_numpy().astype(t) for c, t in enumerate((np.int32, np.int32, np.float64)))
            starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            runs = list(zip(starts.tolist(), [*starts[1:].tolist(), len(i)]))
            pieces = [pa.array([c[at:end].tobytes() for at, end in runs], pa.binary()) for c in (j, value)]
            yield pa.RecordBatch.from_arrays([pa.array(i[starts]), *pieces], names=["i", "j", "value"])

    return entries.select("i", "j", "value").mapInArrow(pack, "i int, j binary, value binary")


def _packed_product(packed: DataFrame, tall: np.ndarray) -> np.ndarray:
    n, width = tall.shape
    shared = packed.sparkSession.sparkContext.broadcast(tall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, j, value in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(value) @ shared.value[np.frombuffer(j, np.int32)]
                found[row] = found[row] + part if row in found else part  # a row may go on in the next piece
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["i", "row"])

    out = np.zeros((n, width))
    rows = packed.mapInArrow(run, "i int, row binary").toArrow()  # at most a row per term
    out[rows["i"].to_numpy()] = np.frombuffer(b"".join(rows["row"].to_pylist())).reshape(-1, width)
    shared.unpersist()
    return out


def decompose(entries: DataFrame, n: int, dim: int, seed: int = 0, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, values): the eigenvectors of the greatest absolute eigenvalues of a symmetric sparse matrix.

    ``entries`` are as for :func:`product`; they are packed and written once.
    """
    packed = checkpointed(_packed(entries))
    width = min(n, dim + EXTRA)
    tall = np.random.default_rng(seed).standard_normal((n, width))
    for _ in range(rounds):
        tall = np.linalg.qr(_packed_product(packed, tall))[0]
    small = tall.T @ _packed_product(packed, tall)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:dim]
    vectors = tall @ turned[:, order]
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1, signs), values[order]


@dataclass(frozen=True)
class TermVectors:
    """The learned vectors: a matrix row and a weight for each term."""

    terms: list[str]
    matrix: np.ndarray
    weights: np.ndarray

    def encoder(self) -> Encoder:
        """Texts to the weighted means of their known terms."""
        places = {t: i for i, t in enumerate(self.terms)}
        matrix, weights = self.matrix, self.weights

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), matrix.shape[1]), np.float32)
            for n, t in enumerate(texts):
                found = [places[w] for w in re.findall("[a-z0-9]+", t.lower()) if w in places]
                if found:
                    out[n] = weights[found] @ matrix[found] / len(found)
            return out

        return encode


def learn(texts: DataFrame, text: str = "text", dim: int = 64, window: int = WINDOW, min_count: int = 3, max_terms: int = MAX_TERMS, seed: int = 0) -> TermVectors:
    """Term vectors of a corpus: eigenvectors without their values, a unit vector per term.

    A common term weighs less: a / (a + its share), with a = ``HALF_WEIGHT``.
    """
    kept = [(r["term"], r["n"]) for r in vocabulary(texts, text, min_count, max_terms).collect()]  # max_terms rows at most
    if not kept:
        return TermVectors([], np.zeros((0, dim), np.float32), np.zeros(0, np.float32))
    entries = _information(_numbered_pairs(texts, [t for t, _ in kept], text, window))
    vectors, values = decompose(entries.repartition("i").sortWithinPartitions("i", "j"), len(kept), dim, seed)
    matrix = np.zeros((len(kept), dim))
    matrix[:, : len(values)] = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    share = np.array([n for _, n in kept]) / sum(n for _, n in kept)
    weights = HALF_WEIGHT / (HALF_WEIGHT + share)
    return TermVectors([t for t, _ in kept], matrix.astype(np.float32), weights.astype(np.float32))


def loader(texts: DataFrame, vectors: TermVectors) -> Callable[[], Encoder]:
    """The ``load`` of :func:`pageloom.plans.index.loaded_model`: the vectors are broadcast once, 17 MB at the defaults."""
    # plain values, as executors do not know the class
    shared = texts.sparkSession.sparkContext.broadcast((vectors.terms, vectors.matrix, vectors.weights))
    return lambda: TermVectors(*shared.value).encoder()
