"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Rows are ordered by a 128-bit key: a hash of the text, then a hash of the row's id. Equal texts are
therefore neighbours, and a group of copies of any size can still be cut between two of its rows.
Splitters are found by counting: each round sums the exact bytes of all rows in the probe intervals
that still hold a wanted boundary, across all partitions, and divides those intervals again, until a
probe lies within the tolerance of its target or an interval holds one key. The narrow table of
(key, size) is written once; only sums reach the driver (at most ``2 ** FIRST_BITS`` rows at first
and ``shards * 2 ** NEXT_BITS`` in later rounds).

The rows then move once, into pieces of shards that are small enough for a task. A row's slot is
the exact count of rows in the pieces before its own plus its place in the piece.

Cases: a NULL text weighs the fixed part only and sorts as the empty text; rows that repeat id and
text share a key and stay together; an empty table gives no rows; there may be more shards than rows
(some stay empty). The names this operator adds replace input columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.keys import SIGN as _TOP
from pageloom.llm.keys import rank_among
from pageloom.session import checkpointed

FIRST_BITS, NEXT_BITS = 14, 8


def _unsigned_prefix(column: str, bits: int) -> Column:
    """The top bits of a signed key in the order of the signed values."""
    return F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(-_TOP)), 64 - bits)


def _signed(prefix: int, bits: int) -> int:
    return (prefix << (64 - bits)) - _TOP


def find_splitters(keyed: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int]], list[tuple[tuple[int, int], int]]]:
    """``shards - 1`` boundary keys with near-equal bytes between them, and the first histogram's edges.

    ``keyed`` has _group, _row and size. An edge is (key, exact bytes below it).
    """
    def counted(rows: DataFrame, *by: Column) -> list:
        return rows.groupBy(*by).agg(
            F.sum("size").alias("bytes"), F.min("_group").alias("g0"), F.max("_group").alias("g1"),
            F.min("_row").alias("r0"), F.max("_row").alias("r1"),
        ).collect()

    first = sorted(counted(keyed, _unsigned_prefix("_group", FIRST_BITS).alias("bin")), key=lambda r: r["bin"])
    total = sum(r["bytes"] for r in first)
    slack = tolerance * total / shards
    edges, at = [], 0
    for r in first:
        edges.append(((_signed(r["bin"], FIRST_BITS), -_TOP), at, r))
        at += r["bytes"]
    found: dict[int, tuple[int, int]] = {}
    open_: dict[tuple, list] = {}  # interval -> [bytes below it, targets]

    def settle(k: int, below: list[tuple[tuple[int, int], int, object]], end: int, interval: tuple | None) -> None:
        """Take the nearer edge around target k, or open the interval that holds it."""
        target = k * total / shards
        i = max(bisect_right([b for _, b, _ in below], target) - 1, 0)
        key, low, row = below[i]
        high = below[i + 1][1] if i + 1 < len(below) else end
        after = below[i + 1][0] if i + 1 < len(below) else None
        if target - low <= min(slack, high - target):
            found[k] = key
        elif high - target <= slack and after is not None:
            found[k] = after
        elif row["g0"] == row["g1"] and row["r0"] == row["r1"]:
            # one key: it lies on the side where less is misplaced
            found[k] = key if target - low <= high - target else (row["g1"], row["r1"] + 1)
        else:
            # the common prefix of what is in there; a single group goes on to the second half of the key
            half, lo, hi = ("_row", row["r0"], row["r1"]) if row["g0"] == row["g1"] else ("_group", row["g0"], row["g1"])
            bits = 64 - ((lo + _TOP) ^ (hi + _TOP)).bit_length()
            group = row["g0"] if half == "_row" else None
            into = (half, group, (lo + _TOP) >> (64 - bits) if bits else 0, bits)
            open_.setdefault(into, [low, high, []])[2].append(k)

    for k in range(1, shards):
        if total:
            settle(k, edges, total, None)
        else:
            found[k] = (_TOP - 1, _TOP - 1)
    while open_:
        todo, open_ = open_, {}
        number, probe = F.lit(None).cast("int"), F.lit(None).cast("long")
        for n, (half, group, prefix, bits) in enumerate(todo):
            inside = _unsigned_prefix(half, bits) == prefix if bits else F.lit(True)
            if group is not None:
                inside = inside & (F.col("_group") == group)
            number = F.when(inside, F.lit(n)).otherwise(number)
            probe = F.when(inside, _unsigned_prefix(half, min(bits + NEXT_BITS, 64))).otherwise(probe)
        rows = counted(keyed.select("*", number.alias("n"), probe.alias("bin")).filter("n IS NOT NULL"), F.col("n"), F.col("bin"))
        for n, ((half, group, _, bits), (low, high, targets)) in enumerate(todo.items()):
            below, at, depth = [], low, min(bits + NEXT_BITS, 64)
            for r in sorted((r for r in rows if r["n"] == n), key=lambda r: r["bin"]):
                edge = _signed(r["bin"], depth)
                below.append(((group, edge) if half == "_row" else (edge, -_TOP), at, r))
                at += r["bytes"]
            for k in targets:
                settle(k, below, high, None)
    return [found[k] for k in range(1, shards)], [(key, at) for key, at, _ in edges]


def shard_by_bytes(
    docs: DataFrame, shards: int, text: str = "text", row_id: str = "doc_id", overhead: int = 8,
    tolerance: float = 0.005, piece_bytes: int = 64 << 20,
) -> DataFrame:
    """``docs`` with ``size``, ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in its shard)."""
    said = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop("shard", "slot").withColumns({
        "size": F.octet_length(said).cast("long") + overhead,
        "_group": F.xxhash64(said),
        "_row": F.xxhash64(F.col(row_id), F.lit("row")),
    })
    keyed = checkpointed(rows.select("_group", "_row", "size"))
    splitters, edges = find_splitters(keyed, shards, tolerance)
    # edges that cut the shards into pieces for the tasks of the exchange
    cuts, last = set(splitters), 0
    for key, below in edges:
        if below - last >= piece_bytes:
            cuts.add(key)
            last = below
    bounds = sorted(cuts)
    shard_of = [bisect_right(splitters, b) for b in [(-_TOP - 1, -_TOP), *bounds]]
    counts = {r["piece"]: r["rows"] for r in keyed.groupBy(rank_among(bounds, "_group", "_row").alias("piece")).agg(F.count("*").alias("rows")).collect()}
    before, offsets = 0, []
    for piece, shard in enumerate(shard_of):
        before = 0 if piece and shard != shard_of[piece - 1] else before
        offsets.append(before)
        before += counts.get(piece, 0)
    moved = rows.withColumn("_piece", rank_among(bounds, "_group", "_row")).repartitionById(len(bounds) + 1, F.col("_piece"))  # a task each
    place = F.row_number().over(Window.partitionBy("_piece").orderBy("_group", "_row"))
    spark = docs.sparkSession
    where = spark.createDataFrame(list(zip(range(len(shard_of)), shard_of, offsets)), "_piece int, shard int, _offset long")
    return (
        moved.withColumn("_place", place)
        .join(F.broadcast(where), "_piece")  # one row per piece, a list made here
        .withColumn("slot", F.col("_offset") + F.col("_place") - 1)
        .drop("_piece", "_group", "_row", "_place", "_offset")
    )
