"""Vector collections as versioned parquet tables.

Below ``root``, ``catalog/collection=<name>`` records the declared dimension and
``points/collection=<name>/version=<n>`` holds one written batch (id, vector, payload), whose ids are
unique. ``published/collection=<name>/<n>`` lists the batches that make up the collection after its
n-th change: first a base, then upserts, oldest first, with the rows of each. A list is written when its batches are complete, and it
is never changed, so a writer that dies leaves the last list and all of its files as they were, a
repeated batch changes nothing, and readers see one whole state at any time.

Reading takes the newest row of each id. Which one that is follows from the ids alone: the newer batches' ids are
grouped, and rows are filtered by them, so no vector or payload is grouped, and the ids are broadcast while they are few.

Batches are merged by size: when more than a few of one size class have piled up behind the larger ones, those
are merged into one of the next class. A row is so rewritten once per class, and a batch costs in proportion to itself and not
to the collection; the base is rewritten when as much has come as it holds. :meth:`Collection.compact` merges everything.

A batch that carries its source and number, as a stream's do, is recorded in the list; when it comes again
after its list was published, nothing is written.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.schemas import METADATA_FIELDS
from pageloom.session import checkpointed
from pageloom.sources.tables import folder_names, has_rows, table_exists

# Fixed value: the distance of every collection.
DISTANCE = "Cosine"

# What an empty collection reads as.
POINTS = f"id bigint, vector array<float>, payload struct<Wiki_content: string, {', '.join(f'`{f}`: ' + ('int' if f == 'Year' else 'string') for f in METADATA_FIELDS)}>"

_DOC_BITS, _CHUNK_BITS = 39, 24

# Ids of newer batches that are broadcast to the older rows.
MAX_BROADCAST_IDS = 1 << 20
# Batches of one size class that may pile up, and the growth from class to class.
PILED, GROWTH = 8, 4
_LIST = "place int, version long, folder string, n_rows long, source string, batch long"


def packed_id(doc: Column, chunk_no: Column) -> Column:
    """Point id of a numeric document key and chunk number; distinct inputs give distinct ids.

    NULL for a NULL input. A join on the id may have Spark test it before rows without a chunk are
    filtered out, so only a number that is there and out of range is an error.
    """
    fits = (
        doc.between(0, (1 << _DOC_BITS) - 1) & chunk_no.between(0, (1 << _CHUNK_BITS) - 1)
    )
    value = F.shiftleft(doc.cast("bigint"), _CHUNK_BITS).bitwiseOR(chunk_no.cast("bigint"))
    missing = doc.isNull() | chunk_no.isNull()
    return F.when(fits, value).when(missing, F.lit(None).cast("bigint")).otherwise(F.raise_error(F.lit("document or chunk number out of range")).cast("bigint"))


def with_dense_ids(df: DataFrame, order: list[str], into: str = "id") -> DataFrame:
    """Number the rows 0..n-1 by ``order``, a unique key, without a window over one partition.

    Rows are range-partitioned and written to the checkpoint folder, which fixes them; each one is
    numbered inside its partition, and the partition's offset (one small row each) is added.
    """
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranged.select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
    )
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").select(
        (F.col("_at") + F.col("_offset")).alias(into), *df.columns
    )


def metadata_struct(fields: list[str] = METADATA_FIELDS) -> Column:
    """The project columns as one struct."""
    return F.struct(*fields).alias("Metadata")


def flat_payload(content: str = "Wiki_content", metadata: str = "Metadata") -> Column:
    """Payload struct of chunk text and metadata fields side by side."""
    return F.struct(F.col(content).alias("Wiki_content"), *[F.col(f"{metadata}.{f}").alias(f) for f in METADATA_FIELDS])


@dataclass(frozen=True)
class Tier:
    """One batch of a collection."""

    version: int
    folder: str
    n_rows: int

    @property
    def size_class(self) -> int:
        return int(math.log(max(self.n_rows, 1), GROWTH))


@dataclass(frozen=True)
class Collection:
    """A named set of points. One writer at a time; any number of readers."""

    spark: SparkSession
    root: str
    name: str

    @property
    def _catalog(self) -> str:
        return f"{self.root}/catalog/collection={self.name}"

    @property
    def _published(self) -> str:
        return f"{self.root}/published/collection={self.name}"

    def _version(self, n: int) -> str:
        return f"{self.root}/points/collection={self.name}/version={n}"

    def exists(self) -> bool:
        return table_exists(self.spark, self._catalog)

    def create(self, dim: int) -> None:
        """Declare the collection; an error if it is there already."""
        if self.exists():
            raise ValueError(f"collection {self.name} exists")
        self._declare(dim)

    def _declare(self, dim: int) -> None:
        row = self.spark.range(1).select(F.lit(dim).alias("dim"), F.lit(DISTANCE).alias("distance"))
        row.coalesce(1).write.mode("overwrite").parquet(self._catalog)

    def dim(self) -> int:
        return self.spark.read.parquet(self._catalog).first()["dim"]

    def _changes(self) -> list[int]:
        """Number of the newest published list, if there is one."""
        for n in sorted((int(n) for n in folder_names(self.spark, self._published) if n.isdigit()), reverse=True):
            if table_exists(self.spark, f"{self._published}/{n}"):
                return [n]
        return []

    def _state(self) -> tuple[list[Tier], dict[str, int]]:
        """(batches, base first; the last batch number of each source)."""
        changes = self._changes()
        if not changes:
            return [], {}
        rows = self.spark.read.schema(_LIST).parquet(f"{self._published}/{changes[-1]}").orderBy("place").collect()  # bounded by merging
        tiers = [Tier(r["version"], r["folder"], r["n_rows"]) for r in rows if r["version"] is not None]
        return tiers, {r["source"]: r["batch"] for r in rows if r["version"] is None}

    def tiers(self) -> list[Tier]:
        """The batches of the collection, base first; none if nothing was stored."""
        return self._state()[0]

    def versions(self) -> list[int]:
        """The batches' numbers: base first, then upserts."""
        return [t.version for t in self.tiers()]

    def points(self) -> DataFrame:
        """All points: (id, vector, payload). A declared collection without points has no rows."""
        tiers = self.tiers()
        return self._merged(tiers) if tiers else self.spark.createDataFrame([], POINTS)

    def _merged(self, tiers: list[Tier]) -> DataFrame:
        """The newest row of each id in some batches, oldest first."""
        read = [self.spark.read.parquet(t.folder).select("id", "vector", "payload") for t in tiers]
        if len(read) == 1:
            return read[0]
        newer = list(enumerate(read))[1:]
        union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
        latest = union([df.select("id", F.lit(i).alias("place")) for i, df in newer])
        if len(newer) > 1:
            latest = latest.groupBy("id").agg(F.max("place").alias("place"))
        if sum(t.n_rows for t in tiers[1:]) <= MAX_BROADCAST_IDS:
            latest = F.broadcast(latest)
        kept = read[0].join(latest.select("id"), "id", "left_anti")
        rows = union([df.withColumn("place", F.lit(i)) for i, df in newer])
        if len(newer) > 1:
            rows = rows.join(latest, ["id", "place"], "left_semi")
        return kept.unionByName(rows.select("id", "vector", "payload"))

    def is_populated(self) -> bool:
        """The collection exists and holds a point."""
        return self.exists() and has_rows(self.points())

    def count(self) -> int:
        return self.points().count()

    def upsert(self, points: DataFrame, latest_by: str | None = None, compact_after: int = PILED, batch: tuple[str, int] | None = None) -> bool:
        """Insert the points; one with a known id replaces the old one, and other old ids stay.

        Of several rows for one id in ``points`` the one with the greatest ``latest_by`` counts (without
        it the greatest by a hash of the row). The batch is written, and batches of like size are merged when more than
        ``compact_after`` have piled up. ``batch`` is a source and its increasing batch number: what was
        stored before is not stored again, and the answer is False.
        """
        tiers, sources = self._state()
        if batch is not None:
            if sources.get(batch[0], -1) >= batch[1]:
                return False
            sources[batch[0]] = batch[1]
        self._publish(self._written(points, latest_by), tiers, sources)
        self.merge_piled(compact_after)
        return True

    def replace(self, points: DataFrame, dim: int, latest_by: str | None = None) -> None:
        """Store the points in place of what is there. Readers see the old state until the new one is complete."""
        self._declare(dim)
        self._publish(self._written(points, latest_by), [], {})

    def compact(self) -> None:
        """Merge all batches into a new base; earlier lists and their files stay readable."""
        tiers, sources = self._state()
        if tiers:
            self._publish(self._rewritten(tiers), [], sources)

    def merge_piled(self, piled: int = PILED) -> None:
        """Merge the newest batches up to a size class of which more than ``piled`` lie behind the larger ones, until there is none."""
        while run := self._piled(piled):
            tiers, sources = self._state()
            self._publish(self._rewritten(tiers[-run:]), tiers[:-run], sources)

    def _piled(self, piled: int) -> int:
        """How many of the newest batches to merge."""
        classes = [t.size_class for t in reversed(self.tiers())]
        for own in sorted(set(classes)):
            run = next((i for i, c in enumerate(classes) if c > own), len(classes))
            if classes[:run].count(own) > piled:
                return run
        return 0

    def _next(self) -> int:
        changes = self._changes()
        return changes[-1] + 1 if changes else 0

    def _written(self, points: DataFrame, latest_by: str | None) -> Tier:
        """Write a batch; only rows of repeated ids are grouped, and only then is anything written twice."""
        dim, n = self.dim(), self._next()
        wrong = F.raise_error(F.lit(f"collection {self.name} takes vectors of length {dim}"))
        vector = F.when(F.size("vector") == dim, F.col("vector")).otherwise(wrong.cast("array<float>"))
        order = [F.col(latest_by).alias("_latest")] if latest_by else []
        folder = self._version(n)
        # leftovers of a writer that died before publishing are overwritten
        points.select("id", vector.alias("vector"), "payload", *order).write.mode("overwrite").parquet(folder)
        rows = self.spark.read.parquet(folder)
        ids = rows.groupBy("id").agg(F.count("*").alias("n"))
        found = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("ids"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        if found["most"] <= 1:
            return Tier(n, folder, found["rows"])
        repeated, same = ids.filter("n > 1").select(F.col("id").alias("again")), F.col("id").eqNullSafe(F.col("again"))
        by = F.col("_latest") if latest_by else F.xxhash64("vector", F.to_json("payload"))
        chosen = rows.join(repeated, same, "left_semi").groupBy("id").agg(F.max_by(F.struct("vector", "payload"), by).alias("p"))
        single = rows.join(repeated, same, "left_anti")
        once = single.select("id", "vector", "payload").unionByName(chosen.select("id", "p.vector", "p.payload"))
        once.write.mode("overwrite").parquet(f"{folder}-once")
        return Tier(n, f"{folder}-once", found["ids"])

    def _rewritten(self, tiers: list[Tier]) -> Tier:
        """Merge batches, whose ids are unique, into one."""
        n = self._next()
        self._merged(tiers).write.mode("overwrite").parquet(self._version(n))
        return Tier(n, self._version(n), self.spark.read.parquet(self._version(n)).count())

    def _publish(self, tier: Tier, before: list[Tier], sources: dict[str, int]) -> None:
        rows = [(i, t.version, t.folder, t.n_rows, None, None) for i, t in enumerate([*before, tier])]
        rows += [(None, None, None, None, source, number) for source, number in sources.items()]
        self.spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{self._published}/{tier.version}")
