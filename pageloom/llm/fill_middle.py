"""Fill-in-middle transformation by secondary sort.

A text is cut at two hashed places into prefix, middle and suffix, and put together again in the order of its
form: psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part behind its marker; or plain, the text
itself. Tasks emit the text in chunks of at most ``CHUNK`` units (code points) and the markers as pieces of
their own, each keyed by its document and its place in the output. One exchange by document with a sort
inside the partitions brings a document's pieces together in output order; a task streams them into running
digests and holds one chunk at a time, whatever a text's length.

Restoration sees the output's pieces and the form alone: markers are found in the stream (a text that holds one is
plain, so none is mistaken), they tell which part follows, and the form tells where that part stood. Pieces
get their place in the text, are sorted again inside the same partitions, without another exchange, and streamed
into the restored text's digest.

A document's key is its id, two hashes of its text and the number of the partition it was read in. So a NULL
or repeated id is no hot key, and rows that repeat id and text are spread over as many keys as they come from
partitions; those that share a key stream as one and are returned each.

Cases: a NULL text is the empty one; an empty text, or one that holds a marker, is plain; a NULL id hashes as an
empty one; repeated rows are returned each; an empty table gives no rows. Columns named in ``keep`` pass
through, but for names that this module adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import batches as bt

# The markers in the order of the parts, and the shares of the forms in percent.
MARKERS = {"prefix": "<P>", "middle": "<M>", "suffix": "<S>"}
ORDER = {"psm": ["prefix", "suffix", "middle"], "spm": ["suffix", "prefix", "middle"]}
TRANSFORMED, SUFFIX_FIRST = 90, 20

CHUNK = 1 << 16
# Bytes of pieces that leave a task at a time.
SEND_BYTES = 4 << 20
_PARTS = ["prefix", "middle", "suffix"]
_KEY = "key_id string, key_text bigint, key_more bigint, key_part int"
_KEYS = ["key_id", "key_text", "key_more", "key_part"]
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]


def numbers(doc_id: str, salt: str = "1:") -> list[int]:
    """h1 to h4: the first four groups of eight hexadecimal digits of the id's SHA-256."""
    digest = hashlib.sha256((salt + doc_id).encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def plan(text: str, doc_id: str) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle)."""
    h1, h2, h3, h4 = numbers(doc_id)
    n = len(text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= TRANSFORMED or any(m in text for m in MARKERS.values()):
        return "plain", first, second
    return ("spm" if h4 % 100 < SUFFIX_FIRST else "psm"), first, second


def output_pieces(text: str, form: str, first: int, second: int, chunk: int = CHUNK) -> Iterator[str]:
    """The output in pieces: markers alone, parts in chunks; an empty output is one empty piece."""
    if form == "plain":
        yield from (text[at : at + chunk] for at in range(0, max(len(text), 1), chunk))
        return
    ends = {"prefix": (0, first), "middle": (first, second), "suffix": (second, len(text))}
    for part in ORDER[form]:
        yield MARKERS[part]
        a, b = ends[part]
        yield from (text[at : min(at + chunk, b)] for at in range(a, b, chunk))


def _emitter(kept: list[str], chunk: int):
    """Rows (kept, key columns, text) to their pieces; the row itself rides on piece 0."""
    def send(rows: list, held: pa.RecordBatch) -> pa.RecordBatch:
        at, place, form, n, first, second, pieces = zip(*rows)
        head = pa.array(np.array(place) == 0)
        own = held.select(range(5)).take(pa.array(at, pa.int64()))  # all but the text
        carried = own.column(0)
        columns = [
            *(own.column(i) for i in range(1, 5)), pa.array(place, pa.int64()), pa.array(pieces, pa.string()), pa.array(form, pa.string()),
            pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pc.if_else(head, carried, pa.scalar(None, carried.type)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*_KEYS, "place", "piece", "form", "n", "first", "second", "kept"])

    def run(batches):
        for batch in bt.by_rows(batches):
            rows, size = [], 0
            for i, (doc_id, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(5).to_pylist())):
                form, first, second = plan(text, doc_id)
                for place, piece in enumerate(output_pieces(text, form, first, second, chunk)):
                    rows.append((i, place, form, len(text), first, second, piece))
                    size += len(piece)
                    if size >= SEND_BYTES:
                        yield send(rows, batch)
                        rows, size = [], 0
            if rows:
                yield send(rows, batch)

    return run


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(key columns, place, piece, form, n, first, second, kept): every output in pieces, in no order yet."""
    kept = [c for c in (keep if keep is not None else [doc_id]) if c not in ADDED]
    whole, name = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    carried = F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    source = docs.select(
        carried.alias("kept"), name.alias("key_id"), F.xxhash64(whole).alias("key_text"), F.xxhash64(whole, F.lit("more")).alias("key_more"),
        F.spark_partition_id().alias("key_part"), whole.alias("text"),
    )
    # the row is absent from all pieces but the first
    fields = [
        *T.StructType.fromDDL(_KEY).fields, T.StructField("place", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("form", T.StringType()),
        T.StructField("n", T.LongType()), T.StructField("first", T.LongType()), T.StructField("second", T.LongType()), T.StructField("kept", source.schema["kept"].dataType),
    ]
    return bt.bounded(source).mapInArrow(_emitter(kept, chunk), T.StructType(fields))


def _keyed(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    """(keys as tuples, the batch), in bounded slices."""
    for batch in bt.by_rows(batches, rows):
        yield list(zip(*(batch.column(n).to_pylist() for n in _KEYS))), batch


def _sorted_pieces(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions(*_KEYS, "place")


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order to the same pieces with their place in the text, markers gone, and the output's digest on the last row."""
    names = [*_KEYS, "place", "piece", "form", "n", "first", "second", "kept", "output_sha256"]
    own, digest, part, seen, kept_type = None, None, 0, 0, None
    rows: list[tuple] = []
    size = 0
    last_place = -1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), kept_type, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    marker = {m.encode(): _PARTS.index(p) for p, m in MARKERS.items()}
    for keys, batch in _keyed(batches):
        kept_type = batch.column("kept").type
        listed = [batch.column(c).to_pylist() for c in ("place", "form", "n", "first", "second", "kept")]
        said = batch.column("piece").cast(pa.binary()).to_pylist()
        for key, piece, place, form, n, first, second, kept in zip(keys, said, *listed):
            if key != own:
                if own is not None:
                    rows.append((*own, 1 << 62, b"", None, None, None, None, None, digest.hexdigest()))
                own, digest, part, seen, last_place = key, hashlib.sha256(), 0, 0, -1
            again = place == last_place  # a repeated row's copy of the piece
            last_place = place
            if not again:
                digest.update(piece)
                if form != "plain" and piece in marker:
                    part, seen = marker[piece], 0
                    piece = b""
                else:
                    seen += 1
            elif place:
                continue
            else:
                piece = b""
            # part and running number within it; rows that repeat only carry their columns
            rows.append((*key, (part << 56) + seen, piece, form, n, first, second, kept, None))
            size += len(piece)
            if size >= SEND_BYTES or len(rows) >= 4096:
                yield batch_of(rows)
                rows, size = [], 0
    if own is not None:
        rows.append((*own, 1 << 62, b"", None, None, None, None, None, digest.hexdigest()))
        yield batch_of(rows)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the text to one row per document and repetition."""
    own, digest, held, size_of, kept_type = None, None, [], None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [kept_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["kept", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for keys, batch in _keyed(batches):
        kept_type = batch.column("kept").type
        listed = [batch.column(c).to_pylist() for c in ("form", "n", "first", "second", "kept", "output_sha256")]
        said = batch.column("piece").to_pylist()
        rows = []
        for key, piece, form, n, first, second, kept, output in zip(keys, said, *listed):
            if key != own:
                own, digest, held, size_of = key, hashlib.sha256(), [], None
            if output is not None:
                form, n, first, second = size_of
                chars = (None, None) if form == "plain" else (first, second - first)
                rows += [(k, n, form, *chars, output, digest.hexdigest()) for k in held]
                continue
            digest.update(piece)
            size_of = (form, n, first, second)
            if kept is not None:
                held.append(kept)
        if rows:
            yield batch_of(rows)


def with_fill_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(kept columns, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    made = pieces(docs, doc_id, text, keep, chunk)
    kept = made.schema["kept"].dataType
    dealt = _sorted_pieces(made.repartition(*_KEYS))
    piece_fields = [f if f.name != "piece" else T.StructField("piece", T.BinaryType()) for f in made.schema.fields]
    placed = dealt.mapInArrow(_outputs, T.StructType([*piece_fields, T.StructField("output_sha256", T.StringType())]))
    result = T.StructType([
        T.StructField("kept", kept), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType()),
    ])
    rows = _sorted_pieces(placed).mapInArrow(_restored, result)
    names = [] if kept.fieldNames() == ["none"] else [f"kept.`{c}`" for c in kept.fieldNames()]
    return rows.select(*names, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def outputs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(kept columns, form, output): the transformed texts themselves, one row per document; a row holds a whole output."""
    made = pieces(docs, doc_id, text, keep, chunk)
    kept = made.schema["kept"].dataType

    def joined(batches):
        own, place_of, held, carried, form_of = None, -1, [], [], None

        def batch_of() -> pa.RecordBatch:
            whole = "".join(held)
            n = len(carried)
            return pa.RecordBatch.from_arrays(
                [pa.array(carried, kept_type), pa.array([form_of] * n, pa.string()), pa.array([whole] * n, pa.string())], names=["kept", "form", "output"]
            )

        for keys, batch in _keyed(batches):
            kept_type = batch.column("kept").type
            listed = [batch.column(c).to_pylist() for c in ("place", "piece", "form", "kept")]
            for key, place, piece, form, row in zip(keys, *listed):
                if key != own:
                    if own is not None:
                        yield batch_of()
                    own, place_of, held, carried, form_of = key, -1, [], [], form
                if place != place_of:
                    held.append(piece)
                if row is not None:
                    carried.append(row)
                place_of = place
        if own is not None:
            yield batch_of()

    dealt = _sorted_pieces(made.repartition(*_KEYS))
    result = T.StructType([T.StructField("kept", kept), T.StructField("form", T.StringType()), T.StructField("output", T.StringType())])
    names = [] if kept.fieldNames() == ["none"] else [f"kept.`{c}`" for c in kept.fieldNames()]
    return dealt.mapInArrow(joined, result).select(*names, "form", "output")


def restored(output: str, form: str) -> str:
    """The text of an output, from the output and its form."""
    if form == "plain":
        return output
    parts, at = {}, 0
    for part, following in zip(ORDER[form], [*ORDER[form][1:], None]):
        at += len(MARKERS[part])
        end = output.index(MARKERS[following], at) if following else len(output)
        parts[part], at = output[at:end], end
    return parts["prefix"] + parts["middle"] + parts["suffix"]
