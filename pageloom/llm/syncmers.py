"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if its least inner s-mer, by hash, is its first or its last one. That
depends on the k-mer alone, so the same passage gives the same anchors in any context, and one stands at
least every ``K - S`` positions. A document's fingerprint keeps every anchor in order of position: three
bytes each, four bits for the distance from the anchor before and twenty of its hash, in base64.

Likeness matches positions. A link is an anchor with the distance to, and the hash of, the one before it,
44 bits in all. The n-th occurrence of a link in one fingerprint meets the n-th in the other, and of these
meetings the longest chain that goes forward in both is kept. With a and b links and c in the chain the
likeness is c / (a + b - c): moved passages, repeated ones and added text all lower it.

Cases: a NULL or empty text has an empty fingerprint; a text without an anchor (shorter than a k-mer, or
little longer) has two units of a digest of the whole text in their place; two empty fingerprints are alike (1.0), an empty
one is unlike any other (0.0); equal texts have equal fingerprints; an empty table gives no rows. Other columns
pass through, and columns this module adds replace theirs.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm import batches as bt
from pageloom.llm.keys import SIGN, rank_among

K, S = 16, 8
# A unit of a fingerprint: four bits of distance, the rest of hash. The mark stands before a digest of a whole text.
_UNIT_BYTES, _HASH_BITS, _WHOLE = 3, 20, 15
# Code points handled at once.
_CHUNK = 1 << 19
# An odd multiplier without short patterns in its bits.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the sums over the whole number."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _windows(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` codes (a power of two), by joining runs of half the length."""
    h, n = codes.astype(np.uint64) + np.uint64(1), 1
    while n < length:
        h = h[:-n] * _power(n) + h[n:]
        n *= 2
    return h


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """The minimum of every run of ``length`` values."""
    out, n = values, 1
    while n < length:
        step = min(n, length - n)
        out = np.minimum(out[:-step], out[step:])
        n += step
    return out


def syncmers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors in an array of code points; none if it is shorter than a k-mer."""
    if len(codes) < K:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    raw = _windows(codes, S)
    inner = _mix(raw)
    inside = K - S  # s-mers after the first
    lowest = _least(inner, inside + 1)
    at = np.flatnonzero((inner[:-inside] == lowest) | (inner[inside:] == lowest))
    return at, _mix(raw[at] * _power(S) + raw[at + S])


def anchors(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) for each text; neighbours are hashed in one go, very long ones in pieces."""
    held: list[np.ndarray] = []

    def flush():
        ends = np.cumsum([len(c) for c in held])
        at, hashes = syncmers(np.concatenate(held)) if held else (np.empty(0, np.int64),) * 2
        owner = np.searchsorted(ends, at, "right")
        inside = at + K <= ends[owner] if len(at) else np.empty(0, bool)
        at, hashes, owner = at[inside], hashes[inside], owner[inside]
        bounds = np.searchsorted(owner, np.arange(len(held) + 1))
        for i, codes in enumerate(held):
            a, b = bounds[i], bounds[i + 1]
            if 0 < len(codes) < K:  # padded with a code point that no text has
                padded = np.concatenate([codes, np.full(K - len(codes), 0x110000)])
                raw = _windows(padded, S)
                yield np.zeros(1, np.int64), _mix(raw[:1] * _power(S) + raw[S : S + 1])
            else:
                yield at[a:b] - (ends[i] - len(codes)), hashes[a:b]
        held.clear()

    size = 0
    for t in texts:
        codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if size + len(codes) > _CHUNK:
            yield from flush()
            size = 0
        if len(codes) > _CHUNK:
            pieces = [(b, *syncmers(codes[b : b + _CHUNK + K - 1])) for b in range(0, len(codes) - K + 1, _CHUNK)]
            yield np.concatenate([b + p for b, p, _ in pieces]), np.concatenate([h for _, _, h in pieces])
            continue
        held.append(codes)
        size += len(codes)
    yield from flush()


def fingerprint(text: str | None, at: np.ndarray, hashes: np.ndarray) -> str:
    """The fingerprint of a text from its anchors."""
    if not text:
        return ""
    if len(text) < K or not len(at):
        whole = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
        at, hashes = np.full(2, _WHOLE), np.array([whole, whole << _HASH_BITS & (1 << 64) - 1], np.uint64)
    units = np.diff(at, prepend=0).astype(np.uint32) << np.uint32(_HASH_BITS) | (hashes >> np.uint64(64 - _HASH_BITS)).astype(np.uint32)
    return base64.b64encode(units.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - _UNIT_BYTES :].tobytes()).decode()


def links(print_: str) -> np.ndarray:
    """The links of a fingerprint: its units with the hash of the unit before (zero for the first)."""
    units = np.frombuffer(base64.b64decode(print_), np.uint8).reshape(-1, _UNIT_BYTES).astype(np.int64) @ (1 << np.arange(8 * _UNIT_BYTES - 8, -1, -8))
    before = np.concatenate([np.zeros(1, np.int64), units[:-1] & (1 << _HASH_BITS) - 1])[: len(units)]
    return units << _HASH_BITS | before


def _occurrences(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted values, the how-manieth of its kind each is, where it stood)."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    return ordered, np.arange(len(ordered)) - np.repeat(starts, np.diff(starts, append=len(ordered))), order


def _longest_chain(places: np.ndarray) -> int:
    """Length of the longest increasing subsequence of distinct numbers, in n log n; rising slices are taken whole."""
    ends, step = array("q"), 1 << 12
    for b in range(0, len(places), step):
        piece = places[b : b + step]
        if (not ends or piece[0] > ends[-1]) and (piece[1:] > piece[:-1]).all():
            ends.frombytes(piece.astype(np.int64).tobytes())
            continue
        for p in piece.tolist():
            if not ends or p > ends[-1]:
                ends.append(p)
            else:
                ends[bisect_left(ends, p)] = p
    return len(ends)


def matched(a: np.ndarray, b: np.ndarray) -> float:
    """The likeness of two lists of links."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    (a_values, a_nth, a_at), (b_values, b_nth, b_at) = _occurrences(a), _occurrences(b)
    meets = np.searchsorted(b_values, a_values) + a_nth
    same = meets < len(b)
    same[same] = b_values[meets[same]] == a_values[same]
    partner = np.full(len(a), -1, np.int64)
    partner[a_at[same]] = b_at[meets[same]]
    chain = _longest_chain(partner[partner >= 0])
    return chain / (len(a) + len(b) - chain)


def with_anchors(docs: DataFrame, text: str = "text", into: str = "anchors") -> DataFrame:
    """``docs`` with the anchors of each text: array<struct<position,hash>>, in order of position."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("hash", pa.int64())]))

    def work(texts: list) -> list[pa.Array]:
        return [pa.array([[{"position": p, "hash": h} for p, h in zip(at.tolist(), hashes.view(np.int64).tolist())] for at, hashes in anchors(texts)], kind)]

    return bt.add_columns(docs, text, {into: "array<struct<position:int,hash:bigint>>"}, work, rows=64)


def with_fingerprints(docs: DataFrame, of: dict[str, str], near: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` with a fingerprint for each text column, and likenesses of such fingerprints.

    ``of`` maps a text column to the new column; ``near`` maps a new column to the two text columns whose fingerprints
    it compares. A column mapped to an empty name is compared only. A text that stands in several columns or rows of a
    batch is hashed once.
    """
    near = near or {}
    shown = {c: n for c, n in of.items() if n}
    added = [*shown.values(), *near]
    kept = [c for c in docs.columns if c not in added]
    places = {c: kept.index(c) for c in of}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    schema = ", ".join([*fields, *[f"`{n}` string" for n in shown.values()], *[f"`{n}` double" for n in near]])

    def run(batches):
        for batch in bt.by_rows(batches, 64):
            columns = {c: batch.column(p).to_pylist() for c, p in places.items()}
            distinct = list(dict.fromkeys(t for c in columns.values() for t in c))
            prints = dict(zip(distinct, (fingerprint(t, *found) for t, found in zip(distinct, anchors(distinct)))))
            alike = [[1.0 if prints[x] == prints[y] else matched(links(prints[x]), links(prints[y])) for x, y in zip(columns[a], columns[b])] for a, b in near.values()]
            made = [pa.array([prints[t] for t in columns[c]], pa.string()) for c in shown]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, *(pa.array(x, pa.float64()) for x in alike)], names=[*kept, *added])

    return bt.bounded(docs.select(*kept)).mapInArrow(run, schema)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two stored fingerprints; a NULL one counts as empty."""

    @F.arrow_udf("double")
    def compared(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist())
        return pa.array([1.0 if p == q else matched(links(p), links(q)) for p, q in pairs], pa.float64())

    return compared(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def with_next_text(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part_bytes: int = 24 << 20) -> DataFrame:
    """``docs`` with ``next_text``: the text of the next row by descending id, and of the first for the last.

    Rows with the same id are ordered by a hash of the text; a NULL id comes last. The order is cut into
    parts of bounded size at quantiles of the keys, so each row moves once. The first row of a part also goes to
    the part before it, as that one's guard; the only thing the driver sees is one key per part.
    """
    rows = docs.drop("next_text").withColumns({
        "_a": F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-SIGN)),
        "_b": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    })
    # one exact number per key, rounded in the quantiles only: a cut may fall anywhere
    whole = F.col("_a").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.shiftright("_b", 32).cast("decimal(11,0)")
    weight = rows.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit("")))).alias("bytes")).first()["bytes"] or 0
    n_parts = int(weight // part_bytes) + 1
    bounds = []
    if n_parts > 1:
        shares = [i / n_parts for i in range(1, n_parts)]
        cuts = rows.agg(F.percentile_approx(whole, shares, 10 * n_parts + 1000).alias("cuts")).first()["cuts"]
        bounds = sorted({(int(c) >> 32, ((int(c) & 0xFFFFFFFF) << 32) - (SIGN if int(c) & 0x80000000 == 0 else 0)) for c in cuts or []})
        bounds = sorted({(a, -SIGN if b < -SIGN or b >= SIGN else b) for a, b in bounds})
    placed = rows.withColumn("_part", rank_among(bounds, "_a", "_b"))
    heads = {r["_part"]: (r["head"]["_a"], r["head"]["_b"]) for r in placed.groupBy("_part").agg(F.max(F.struct("_a", "_b")).alias("head")).collect()}
    order = sorted(heads, reverse=True)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the highest part stands "before" itself or after the lowest
    spark = docs.sparkSession
    where = spark.createDataFrame([(p, *heads[p], before[p]) for p in order], "_part int, _head_a long, _head_b long, _goes int")
    known = placed.join(F.broadcast(where), "_part")  # one row per part, a list made here
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guard"))
    guard = F.struct(F.col("_goes").alias("part"), F.lit(True).alias("guard"))
    is_head = (F.col("_a") == F.col("_head_a")) & (F.col("_b") == F.col("_head_b"))
    sent = known.select(*docs.drop("next_text").columns, "_a", "_b", F.explode(F.when(is_head, F.array(own, guard)).otherwise(F.array(own))).alias("_to"))
    sent = sent.select("*", F.col("_to.part").alias("_place"), F.col("_to.guard").alias("_guard")).drop("_to")
    lined = sent.repartitionById(len(bounds) + 1, F.col("_place"))  # a task each
    after = Window.partitionBy("_place").orderBy("_guard", F.desc("_a"), F.desc("_b"))
    return lined.withColumn("next_text", F.lead(F.coalesce(F.col(text), F.lit(""))).over(after)).filter("NOT _guard").drop("_a", "_b", "_place", "_guard")
