"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint holds, for each of 64 bits, whether most of its shingle hashes have it set.
Equal fingerprints are one vertex. To link all pairs of vertices within a distance, the bits are
dealt into parts, correlated bits together, and each part gets a threshold of its own. If the
thresholds sum to ``distance - parts + 1``, a pair within the distance is within the threshold in
some part. Thresholds (and the number of parts) come from a dynamic programme over estimated costs:
keys made, and candidate pairs expected from a bounded sample of fingerprints. The estimate steers
cost alone; whatever it says, the join below finds every pair.

A vertex probes a part by its bits there with up to the threshold's number of set bits cleared: two
vertices within the threshold meet at the bits they share. Vertices that meet are verified by the
distance of their whole fingerprints, and only a spanning forest of the verified links leaves a group.
A key with over ``block`` vertices is split: its vertices are dealt into blocks, and each pair of
blocks is a group of its own, so no task holds more than two blocks.

Cases: a NULL, empty or blank text has fingerprint 0 and is linked like any other; fewer words than
a shingle are one shingle; repeated rows share a vertex; an empty table gives no rows; other columns
pass through, except ``fingerprint`` and ``component_id``, which are replaced. A component's id is
the least id in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import batches as bt
from pageloom.llm.components import components
from pageloom.session import checkpointed

BITS, SEED = 64, 42
SAMPLE = 2048
# Relative cost of making, moving and sorting one key, in verified pairs.
_KEY_COST = 200


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words, repeats included; of the whole if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at ASCII blanks
    if not words:
        return []
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    return [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())]


def fingerprint(text: str | None, width: int = 3) -> int:
    hashes = np.array(shingle_hashes(text, width), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded unpacking of very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint`` as a BIGINT of the same 64 bits."""
    def work(texts: list) -> list[pa.Array]:
        prints = np.array([fingerprint(t, width) for t in texts], np.uint64)
        return [pa.array(prints.view(np.int64))]

    return bt.add_columns(docs, text, {"fingerprint": "bigint"}, work)


def _bit_counts(prints: DataFrame) -> np.ndarray:
    """How many fingerprints have both bits i and j; [i, i] those with bit i. Over all, in small sums."""
    def count(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel().astype(np.int64))], names=["i", "j", "n"]
        )

    sums = np.zeros((BITS, BITS))
    for r in prints.select("fingerprint").mapInArrow(count, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        sums[r["i"], r["j"]] = r["n"]
    return sums


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal the bits into parts of near-equal width, each grown from the most correlated bits left."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        rest = sorted(left)
        group = [rest[int(np.argmax(tied[np.ix_(rest, rest)].sum(axis=1)))]]
        while len(group) < width:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(tied[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group))
        left -= set(group)
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(sample: np.ndarray, n: int, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Least estimated cost and the thresholds that give it: a dynamic programme over the parts."""
    wanted, most = distance - len(groups) + 1, 2
    a, b = np.triu_indices(len(sample), 1)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        away = np.bitwise_count((sample[a] ^ sample[b]) & np.uint64(_mask(bits)))
        half, costs = len(bits) / 2, {-1: 0.0}
        for t in range(most + 1):
            keys = sum(np.prod([half - i for i in range(k)]) / (1, 1, 2)[k] for k in range(t + 1))
            # at least the share that independent bits would give: the sample sees no rare pairs
            chance = sum(len(list(combinations(range(min(len(bits), 40)), k))) for k in range(t + 1)) / 2.0 ** len(bits)
            share = max(float(np.mean(away <= t)) if len(away) else 0.0, chance)
            costs[t] = n * keys * _KEY_COST + share * n * (n - 1) / 2
        best = {
            s: min(((c + costs[t], [*ts, t]) for prev, (c, ts) in best.items() for t in costs if prev + t == s), key=lambda x: x[0])
            for s in {prev + t for prev in best for t in costs}
        }
    return best.get(wanted, (float("inf"), []))


def plan_parts(prints: DataFrame, distance: int) -> list[tuple[int, int]]:
    """(mask, threshold) of each part to probe. ``prints`` has distinct fingerprints."""
    both = _bit_counts(prints)
    n = prints.count()
    drawn = bt.first_by_hash(prints.select("fingerprint"), ["fingerprint"], SAMPLE, n).collect()
    sample = np.array([r["fingerprint"] for r in drawn], np.int64).view(np.uint64)
    plans = []
    for parts in range(1, distance + 2):
        groups = group_bits(both, n, parts)
        cost, thresholds = allocate(sample, n, groups, distance)
        if thresholds:
            plans.append((cost, [(_mask(g), t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def _probe_keys(values: np.ndarray, mask: int, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, fingerprint) arrays: the part's bits with up to ``threshold`` set bits cleared."""
    block, bits = values & np.uint64(mask), [b for b in range(BITS) if mask >> b & 1]
    for k in range(threshold + 1):
        for chosen in combinations(bits, k):
            cleared = np.uint64(_mask(list(chosen)))
            has = (values & cleared) == cleared
            yield block[has] & ~cleared, values[has]


def _forest(values: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges of the links among ``values``: search outward, comparing one with all not yet reached."""
    left = values
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                yield np.full(len(found), x), found
                reached.extend(found)
                left = left[~near]


def _group_links(keys: list[np.ndarray], values: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within each run of equal keys; short runs side by side, long ones as a forest each."""
    n = len(values)
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    for s, size in zip(starts[sizes > 8], sizes[sizes > 8]):
        yield from _forest(values[s : s + size], distance)
    run, own = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= 8, sizes)
    for gap in range(1, 8):
        if gap >= n:
            break
        near = own[:-gap] & (run[gap:] == run[:-gap])
        near &= np.bitwise_count(values[gap:] ^ values[:-gap]) <= distance
        yield values[:-gap][near], values[gap:][near]


def near_links(prints: DataFrame, distance: int = 3, block: int = 4096) -> DataFrame:
    """(a, b): links that join all fingerprints within the distance, directly or by way of others.

    ``prints`` has one row per distinct ``fingerprint``.
    """
    parts = plan_parts(prints, distance)

    def probe(batches):
        for b in bt.by_rows(batches, 8192):
            values = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, (mask, threshold) in enumerate(parts):
                for keys, own in _probe_keys(values, mask, threshold):
                    if len(own):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(own), part, np.int32)), pa.array(keys.view(np.int64)), pa.array(own.view(np.int64))],
                            names=["part", "key", "fingerprint"],
                        )

    keys = prints.select("fingerprint").mapInArrow(probe, "part int, key bigint, fingerprint bigint")
    crowded = checkpointed(keys.groupBy("part", "key").count().filter(F.col("count") > block))
    if crowded.isEmpty():
        dealt = keys.withColumn("cell", F.lit(0).cast("bigint"))
    else:
        blocks = F.ceil(F.col("count") / F.lit(block))
        own = F.pmod(F.xxhash64("fingerprint"), blocks)
        cells = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
        dealt = keys.join(crowded, ["part", "key"], "left").select(
            "part", "key", "fingerprint", F.explode(F.coalesce(cells, F.array(F.lit(0).cast("bigint")))).alias("cell")
        )

    def verify(batches):
        """Batches sorted by group; a group that a batch cuts off is carried to the next."""
        held: list[np.ndarray] | None = None

        def links(columns):
            for a, b in _group_links(columns[:3], columns[3].view(np.uint64), distance):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            cut = changes[-1] if len(changes) else 0
            yield from links([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        if held is not None:
            yield from links(held)

    group = ["part", "key", "cell"]
    grouped = dealt.select(*group, "fingerprint").repartition(*group).sortWithinPartitions(*group)
    return grouped.mapInArrow(verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint`` (BIGINT) and ``component_id``, the least id of the row's component."""
    kept = [c for c in docs.columns if c not in ("fingerprint", "component_id")]
    printed = with_fingerprints(docs.select(*kept), text, width)
    prints = checkpointed(with_fingerprints(docs.select(F.col(doc_id).alias("id"), text), text, width).select("id", "fingerprint"))
    return printed.join(component_ids(prints, distance).drop("root"), "fingerprint").select(*kept, "fingerprint", "component_id")


def component_ids(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(fingerprint, component_id, root) for the distinct fingerprints of (id, fingerprint); ``root`` names the component."""
    vertices = checkpointed(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    roots = components(near_links(vertices.select("fingerprint"), distance))
    placed = vertices.join(roots.withColumnRenamed("vertex", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fingerprint", "component_id", "root")


def one_per_component(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component: of those with the least id (a NULL id only if there is no other), the least by text hash.

    All columns are kept. The component table is written first, so that the join with the documents is a plain
    one, whose crowded fingerprints Spark can split.
    """
    own = [f"_c{i}" for i in range(len(docs.columns))]  # the documents may have columns of any name
    text, doc_id = own[docs.columns.index(text)], own[docs.columns.index(doc_id)]
    hashed = with_fingerprints(docs.toDF(*own), text, width).withColumn("_text", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    prints = checkpointed(hashed.select(F.col(doc_id).alias("id"), "fingerprint", "_text"))
    known = checkpointed(component_ids(prints, distance))
    # which row stays is settled on narrow rows: the least text hash under the component's least id
    met = prints.join(known, "fingerprint").filter(F.col("id").eqNullSafe(F.col("component_id")))
    kept = checkpointed(met.groupBy("root").agg(F.min("_text").alias("least")).join(known, "root"))
    chosen = hashed.join(kept.select("fingerprint", "component_id", "least", "root"), "fingerprint").filter(
        F.col(doc_id).eqNullSafe(F.col("component_id")) & (F.col("_text") == F.col("least"))
    )
    # rows equal in id and text are left; they are rare, so only their roots are looked up before one is taken
    repeated = met.groupBy("root", "_text").count().filter("count > 1").join(kept.select("root", F.col("least").alias("_text")).distinct(), ["root", "_text"])
    repeated = checkpointed(repeated.select("root"))
    columns = [F.col(c).alias(name) for c, name in zip(own, docs.columns)]
    if repeated.isEmpty():
        return chosen.select(*columns)
    twice = chosen.join(repeated, "root", "left_semi").dropDuplicates(["root"])
    return chosen.join(repeated, "root", "left_anti").select(*columns).unionByName(twice.select(*columns))
