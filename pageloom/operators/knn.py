"""Exact nearest neighbours by cosine, as a distributed top-k.

Both forms compare blocks of vectors with blocks of queries by matrix product inside Arrow tasks
and let only the best k per query leave a task; pairs are never rows.

* Few queries (checked): they are broadcast and the collection is scanned where it lies, unshuffled.
* Many queries: queries and vectors are spread over bounded blocks, and each pair of blocks is one
  task, so a part holding a third of all vectors is simply more blocks. Of very many pairs, a share of the vectors is searched first:
  its k-th best cosine is a bound for all blocks, which then list little and compare nearly all pairs by the product alone.

Scores are cosines rounded to nine decimals, so that equal vectors tie exactly and the id decides
whichever block they fall into. A zero vector has no cosine: its score is NULL and it ranks last.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.session import checkpointed

DEFAULT_K = 10
MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# a block of either side, so that a vector and a query are copied about equally often
BLOCK_BYTES = 32 * 1024 * 1024
MAX_BLOCK_ROWS = 65536
# pairs of blocks that one search is cut into at least, for each core and in all, while blocks are no smaller than this
PAIRS_PER_CORE, MIN_PAIRS, MIN_BLOCK_ROWS = 8, 256, 1024
# pairs from which every so many-th vector is searched first, for a bound
BOUNDED_PAIRS, BOUND_SHARE = 1 << 32, 32
# scores computed at a time, and parts whose block counts may be broadcast
PRODUCT_CELLS = 4_000_000
MAX_BROADCAST_PARTS = 100_000
# queries and vectors of a tile of scores, the share of a tile from which it is computed again whole, and the pairs a query may
# have found before they are compared
TILE_QUERIES, TILE_VECTORS, DENSE_TILE, WAITING = 512, 2048, 8, 16

HITS = T.StructType([
    T.StructField("part", T.StringType()),
    T.StructField("qid", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])
_HITS_ARROW = pa.schema([("part", pa.string()), ("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def unit_rows(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one, and which rows are all zeros."""
    lengths = np.linalg.norm(vectors, axis=1)
    zero = ~(lengths > 0)
    return vectors / np.where(zero, 1.0, lengths)[:, None], zero


def best_pairs(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best (score down, id up) of every row number."""
    order = np.lexsort((ids, -scores, rows))
    ranked = rows[order]
    starts = np.flatnonzero(np.diff(ranked, prepend=-1))
    place = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    return order[place < k]


class TopK:
    """Running best k per query of the vectors seen so far.

    Tiles of cosines are computed in single precision first. Only pairs that may reach a query's list, by the
    greatest error that such a cosine can have, are computed again in double precision and rounded; so the list is that of
    a plain search in double precision. A tile in which very many pairs may, as copies do, is computed again whole.
    """

    def __init__(self, qids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        """``least`` is a rounded cosine for each query, or NaN, that k vectors of the whole search are known to reach; worse ones are not listed."""
        self.qids, self.k = qids, k
        self.queries, self.zero_query = unit_rows(queries)
        # queries that are compared; one without direction takes the least ids
        self.asked = np.flatnonzero(~self.zero_query & np.isfinite(self.queries).all(axis=1))
        self.close = self.queries[self.asked].astype(np.float32)
        self.margin = (self.queries.shape[1] + 8) * 2.0**-24 + 1e-9
        # k places per compared query, best first; an empty one has the score before the least, or -inf
        self.empty = np.full(len(self.asked), -np.inf) if least is None else np.nan_to_num(least[self.asked] - 1e-9, nan=-np.inf)
        self.scores = np.repeat(self.empty[:, None], k, axis=1)
        self.ids = np.full((len(self.asked), k), np.iinfo(np.int64).max)
        self.least = np.empty(0, dtype=np.int64)
        self.least_zero = np.empty(0, dtype=np.int64)
        self.greatest = np.iinfo(np.int64).min

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        unit, zero = unit_rows(vectors)
        order = np.argsort(ids, kind="stable")  # of equal scores the first found is the least id
        ids, unit, zero = ids[order], unit[order], zero[order]
        finite = np.isfinite(unit).all(axis=1)
        self.least = np.sort(np.concatenate((self.least, ids[zero | finite][:self.k])))[:self.k]
        self.least_zero = np.sort(np.concatenate((self.least_zero, ids[zero][:self.k])))[:self.k]
        ids, unit = ids[~zero & finite], unit[~zero & finite]
        close = unit.astype(np.float32)
        if len(ids):
            # in order of ids behind all that came before, an equal score is worse the later it is found
            in_order, self.greatest = ids[0] > self.greatest, max(self.greatest, int(ids[-1]))
            for start in range(0, len(self.asked), TILE_QUERIES):
                self._add_strip(slice(start, start + TILE_QUERIES), ids, unit, close, in_order)

    def _add_strip(self, rows: slice, ids: np.ndarray, unit: np.ndarray, close: np.ndarray, in_order: bool) -> None:
        """Some queries against all vectors, by tiles; pairs that may reach a list are gathered over tiles before they are compared."""
        queries, pending, waiting = self.close[rows], [], 0
        room, bound = np.empty((len(queries), TILE_VECTORS), np.float32), self._bound(self.scores[rows, -1])
        for at in range(0, len(ids), TILE_VECTORS):
            tile = close[at:at + TILE_VECTORS]
            scores = np.matmul(queries, tile.T, out=room if len(tile) == TILE_VECTORS else None)
            if len(tile) > self.k and not waiting and np.isneginf(bound).any():
                bound = np.maximum(bound, self._bound(_kth(scores, self.k) - self.margin))
            near = np.flatnonzero(scores.max(axis=1) >= bound)
            if not len(near):
                continue
            reach = (scores if len(near) == len(scores) else scores[near]) >= bound[near, None]
            found = np.flatnonzero(reach)
            if len(found) > scores.size // DENSE_TILE:
                if waiting:
                    self._take(rows, pending, ids, unit, in_order)
                    pending, waiting = [], 0
                self._take_tile(rows, at, ids, unit, in_order)
                bound = self._bound(self.scores[rows, -1])
                continue
            own, other = np.divmod(found, len(tile))
            pending.append((near[own], other + at))
            waiting += len(found)
            if waiting > WAITING * len(queries):
                self._take(rows, pending, ids, unit, in_order)
                pending, waiting, bound = [], 0, self._bound(self.scores[rows, -1])
        if waiting:
            self._take(rows, pending, ids, unit, in_order)

    def _bound(self, worst: np.ndarray) -> np.ndarray:
        """What a cosine in single precision must reach; it must not be rounded up."""
        return np.nextafter((worst - self.margin).astype(np.float32), np.float32(-np.inf))

    def _take_tile(self, rows: slice, at: int, ids: np.ndarray, unit: np.ndarray, in_order: bool) -> None:
        """All pairs of a tile in double precision."""
        worst, worst_id, tile = self.scores[rows, -1], self.ids[rows, -1], slice(at, at + TILE_VECTORS)
        exact = np.round(self.queries[self.asked[rows]] @ unit[tile].T, 9) + 0.0
        floor = np.maximum(worst, _kth(exact, self.k)) if exact.shape[1] > self.k else worst
        found = np.flatnonzero((exact > worst[:, None]) | ((exact == worst[:, None]) & (ids[tile] < worst_id[:, None])))
        found = found[exact.ravel()[found] >= floor[found // exact.shape[1]]]
        own, other = np.divmod(found, exact.shape[1])
        self._merge(rows, own, ids[other + at], exact.ravel()[found], in_order)

    def _take(self, rows: slice, pending: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, unit: np.ndarray, in_order: bool) -> None:
        """Pairs (query of the strip, vector) in double precision."""
        own, other = (np.concatenate(c) for c in zip(*pending))
        worst, worst_id = self.scores[rows, -1], self.ids[rows, -1]
        exact = self._exact(self.asked[rows][own], unit, other)
        better = (exact > worst[own]) | ((exact == worst[own]) & (ids[other] < worst_id[own]))
        self._merge(rows, own[better], ids[other[better]], exact[better], in_order)

    def _merge(self, rows: slice, own: np.ndarray, ids: np.ndarray, scores: np.ndarray, in_order: bool) -> None:
        """The places of the touched queries and what was found, sorted together."""
        if not len(own):
            return
        counts = np.bincount(own)
        touched = np.flatnonzero(counts)
        place = touched + rows.start
        names = np.concatenate((np.repeat(touched, self.k), own))
        ids = np.concatenate((self.ids[place].ravel(), ids))
        scores = np.concatenate((self.scores[place].ravel(), scores))
        # a rounded cosine is a whole number of billionths; an empty place is behind all
        billionths = np.where(np.isneginf(scores), -(1 << 31) + 1, np.rint(np.maximum(scores, -2) * 1e9)).astype(np.int64)
        key = (names << 33) - billionths
        order = np.argsort(key, kind="stable") if in_order else np.lexsort((ids, key))
        held = counts[touched] + self.k
        keep = order[(np.cumsum(held) - held)[:, None] + np.arange(self.k)]
        self.ids[place], self.scores[place] = ids[keep], scores[keep]

    def _exact(self, rows: np.ndarray, unit: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Cosines of pairs, a bounded number at a time."""
        step, made = max(1, PRODUCT_CELLS // max(1, unit.shape[1])), np.empty(len(rows))
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            made[part] = np.einsum("ij,ij->i", self.queries[rows[part]], unit[columns[part]])
        return np.round(made, 9) + 0.0

    def _filled(self, rows: np.ndarray, ids: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``ids`` for each row, up to its room."""
        times = np.minimum(room, len(ids))
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(rows, times), ids[place]

    def hits(self, part: str | None) -> pa.RecordBatch:
        held = self.scores > (self.empty + 5e-10)[:, None]
        rows, ids, scores = np.repeat(self.asked, held.sum(axis=1)), self.ids[held], self.scores[held]
        # vectors without direction fill what is left, and all vectors are alike to a query without
        short, rest = self._filled(self.asked, self.least_zero, np.where(np.isneginf(self.empty), self.k - held.sum(axis=1), 0))
        lost = np.flatnonzero(self.zero_query)
        lost, least = self._filled(lost, self.least, np.full(len(lost), self.k))
        rows, ids = np.concatenate((rows, short, lost)), np.concatenate((ids, rest, least))
        scores = pa.concat_arrays([pa.array(scores, type=pa.float64()), pa.nulls(len(short) + len(lost), pa.float64())])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(ids), type=pa.string()),
                pa.array(self.qids[rows], type=pa.int64()),
                pa.array(ids, type=pa.int64()),
                scores,
            ],
            names=HITS.names,
        )


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of every row."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def to_matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists as a float64 matrix."""
    if isinstance(vectors, pa.ChunkedArray):  # several chunks, or none
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    sizes = np.asarray(vectors.value_lengths())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of one part must have one length")
    return flat.reshape(len(sizes), -1)


def _per_part(parts: pa.Array) -> Iterator[tuple[str | None, np.ndarray]]:
    """Each part with the positions of its rows."""
    encoded = parts.dictionary_encode(null_encoding="encode")
    codes = np.asarray(encoded.indices)
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(encoded.dictionary) + 1))
    for code, name in enumerate(encoded.dictionary.to_pylist()):
        yield name, order[cuts[code]:cuts[code + 1]]


def rank_hits(hits: DataFrame, k: int, within: list[str] | None = None) -> DataFrame:
    """Keep the k best hits per query, with ``rank`` from 1; ``within`` names further key columns."""
    order = Window.partitionBy(*(within or []), "qid").orderBy(F.desc_nulls_last("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def local_topk(
    queries: DataFrame,
    vectors: DataFrame,
    dim: int,
    k: int,
    part: str | None = None,
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Up to k hits per query and task: (part, qid, id, score), a superset of the final top k.

    With ``part`` a query meets only the vectors of its own part; a query may be listed under
    several parts. ``dim`` is the largest vector length, for the size check of the broadcast.
    """
    label = F.col(part).cast("string") if part else F.lit(None).cast("string")
    # aliases keep the two sides apart when both come from one table
    vector = F.col("vector").alias("vector")
    queries = queries.select(label.alias("part"), F.col("qid").cast("long").alias("qid"), vector)
    vectors = vectors.select(label.alias("part"), F.col("id").cast("long").alias("id"), vector)
    queries = queries.filter(F.col("vector").isNotNull())
    vectors = vectors.filter(F.col("vector").isNotNull())
    bound = min(max_broadcast_queries, MAX_BROADCAST_BYTES // (8 * dim))
    few = queries.limit(bound + 1).toArrow()
    if few.num_rows <= bound:
        return _scan(few, vectors, k)
    # both sides are counted and read; whatever made them runs once
    return _blocks(checkpointed(queries), checkpointed(vectors), k, block_rows(dim))


def _scan(few: pa.Table, vectors: DataFrame, k: int) -> DataFrame:
    few = few.combine_chunks()
    by_part = {}
    if few.num_rows:
        qids = few["qid"].to_numpy()
        for name, rows in _per_part(few["part"].combine_chunks()):
            by_part[name] = (qids[rows], to_matrix(few["vector"].combine_chunks().take(pa.array(rows))))
    shared = vectors.sparkSession.sparkContext.broadcast(by_part)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {name: TopK(*query, k) for name, query in shared.value.items()}
        for batch in batches:
            ids, column = batch.column(1).to_numpy(), batch.column(2)
            for name, rows in _per_part(batch.column(0)):
                if name in best:
                    best[name].add(ids[rows], to_matrix(column.take(pa.array(rows))))
        for name, found in best.items():
            yield found.hits(name)

    return vectors.mapInArrow(search, HITS)


def block_rows(dim: int) -> int:
    """Rows of a block, of queries or of vectors."""
    return max(1, min(MAX_BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))


def _block_pairs(spark: SparkSession) -> int:
    return max(MIN_PAIRS, PAIRS_PER_CORE * spark.sparkContext.defaultParallelism)


def _compared(k: int, bounded: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of queries against a block of vectors: the k best of each query; ``bounded`` ones come as (vector, least)."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, least = left["vector"].combine_chunks(), None
        if bounded:
            asked, least = asked.field("vector"), np.asarray(asked.field("least").to_numpy(zero_copy_only=False), dtype=np.float64)
        best = TopK(left["key"].to_numpy(), to_matrix(asked), k, least)
        best.add(right["key"].to_numpy(), to_matrix(right["vector"].combine_chunks()))
        return pa.Table.from_batches([best.hits(left["part"][0].as_py())])

    return search


def meet_in_blocks(queries: DataFrame, vectors: DataFrame, rows: int, compare: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Every vector block of a part meets every query block of it once; block numbers follow counts.

    Blocks have at most ``rows`` rows, and fewer while there would be too few pairs of blocks for the cores.

    ``queries`` is (part, qid, vector) and ``vectors`` (part, id, vector), where ``vector`` is whatever ``compare``
    takes on its sides; it sees tables (part, qb, vb, key, vector) and returns rows of HITS.

    A vector is sent once per query block and a query once per vector block. Blocks are square, so
    with n queries and m vectors the copies are n m / rows in all, on either side.
    """
    counts = queries.groupBy("part").agg(F.count("*").alias("n_queries")).alias("q").join(
        vectors.groupBy("part").agg(F.count("*").alias("n_vectors")).alias("v"),
        F.col("q.part").eqNullSafe(F.col("v.part")),
    ).select(F.col("q.part").alias("name"), "n_queries", "n_vectors")
    # one small row per part; broadcast when so few, a large part is not sent to one task to be split
    counts = checkpointed(counts)
    sums = counts.agg(F.count("*").alias("n"), F.sum(F.col("n_queries").cast("double") * F.col("n_vectors")).alias("pairs")).first()
    rows = min(rows, max(MIN_BLOCK_ROWS, math.ceil(math.sqrt((sums["pairs"] or 0) / _block_pairs(queries.sparkSession)))))
    blocks = lambda n: F.ceil(F.col(n) / rows).cast("long")
    parts = counts.select("name", blocks("n_queries").alias("q_blocks"), blocks("n_vectors").alias("v_blocks"))
    if sums["n"] <= MAX_BROADCAST_PARTS:
        parts = F.broadcast(parts)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    same = F.col("part").eqNullSafe(F.col("name"))
    fresh = [F.col(c).alias(c) for c in ("part", "qb", "vb", "key", "vector")]
    q_rows = queries.join(parts, same).select(
        "part", F.pmod(F.xxhash64("qid"), "q_blocks").alias("qb"), each("v_blocks").alias("vb"),
        F.col("qid").alias("key"), "vector",
    ).select(*fresh)
    v_rows = vectors.join(parts, same).select(
        "part", each("q_blocks").alias("qb"), F.pmod(F.xxhash64("id"), "v_blocks").alias("vb"),
        F.col("id").alias("key"), "vector",
    ).select(*fresh)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        return compare(left, right) if left.num_rows and right.num_rows else pa.Table.from_batches([], schema=_HITS_ARROW)

    keys = ["part", "qb", "vb"]
    return q_rows.groupBy(*keys).cogroup(v_rows.groupBy(*keys)).applyInArrow(search, HITS)


def _blocks(queries: DataFrame, vectors: DataFrame, k: int, rows: int) -> DataFrame:
    if queries.count() * vectors.count() >= BOUNDED_PAIRS:
        return meet_in_blocks(_bounded(queries, vectors, k, rows), vectors, rows, _compared(k, True))
    return meet_in_blocks(queries, vectors, rows, _compared(k))


def _bounded(queries: DataFrame, vectors: DataFrame, k: int, rows: int) -> DataFrame:
    """``queries`` with (vector, least) as their vectors, where k of every ``BOUND_SHARE``-th vector reach the cosine ``least``.

    So k of all vectors do, and whatever is below it is in no list: a block need not find its own k best first.
    """
    some = vectors.filter(F.pmod(F.xxhash64("id", F.lit("bound")), F.lit(BOUND_SHARE)) == 0)
    found = rank_hits(meet_in_blocks(queries, some, rows, _compared(k)), k, ["part"]).filter(F.col("rank") == k)
    least = found.select(F.col("part").alias("name"), F.col("qid").alias("asked"), F.col("score").alias("least"))
    met = queries.join(least, F.col("part").eqNullSafe(F.col("name")) & (F.col("qid") == F.col("asked")), "left")
    return checkpointed(met.select("part", "qid", F.struct("vector", "least").alias("vector")))


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    dim: int,
    k: int = DEFAULT_K,
    part: str | None = None,
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """The k nearest vectors of every query: (qid, id, score, rank), preceded by ``part`` if given.

    ``queries`` is (qid BIGINT, vector), ``vectors`` (id BIGINT, vector); both carry ``part`` when
    several collections are searched at once, each by its own queries. NULL vectors are left out.
    Filter ``vectors`` first to combine the search with conditions on metadata.
    """
    hits = local_topk(queries, vectors, dim, k, part, max_broadcast_queries)
    if part is None:
        return rank_hits(hits.drop("part"), k)
    return rank_hits(hits.withColumnRenamed("part", part), k, [part])


def attach_payload(hits: DataFrame, payloads: DataFrame, columns: list[str]) -> DataFrame:
    """Join the payload of each hit by id, after the top-k, so only hits carry payloads."""
    return hits.join(payloads.select("id", *columns), "id")
