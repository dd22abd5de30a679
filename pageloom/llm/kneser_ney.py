"""Language-model scoring: interpolated modified Kneser-Ney, from sorted hash arrays that workers map.

Counting is a Spark shuffle. Tasks hash words to 64 bits, count the n-grams of some millions of tokens at a
time, and send each segment of the key space its counts as one compressed block of words (histories are
hashed again where they are needed). A segment's task cuts its blocks into parts of some 10 MB of text, sorts them by
part, merges one part at a time, appends the part's sorted arrays to the segment's files in the shared folder, and
sends the types it saw (an n-gram counts once for the shorter n-gram inside it) on to the next
level down. All counts cover all training rows. Memory follows the part; the number of segments, and so of blocks
and files, is ``SEGMENTS`` a level at most. Parts follow the history, so a part knows its
histories' totals; histories of very frequent words are dealt over many parts by the word that
follows, and their totals are added in Spark (at most ``HOT`` a level reach the driver). Which words are frequent
is read from about ``HOT_SAMPLE`` rows; that choice moves rows between parts and changes no result.

The model is a folder of plain arrays. A scoring task sorts the keys of a batch and looks them up segment by segment,
with at most ``OPEN_FILES`` files mapped at once; no part of the model is copied to a worker or sent through the driver, and
files may be larger than memory. The shared folder must be mounted under the same path everywhere.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered, then one end mark. Histories at a
text's start are filled up with start marks. A word that the training rows lack gets its share of
the uniform distribution over the known tokens and one unknown.

Cases: a NULL or empty text is its end mark alone; repeated rows count and are scored each; without
training rows every token has probability 1 (one unknown token is all there is) and the base score
follows its formula with N = V = 0; an empty table gives no rows. Other columns pass through, and
columns this module adds replace theirs. Hashes are 64 bits; within a part 40 bits of them tell keys
apart, so an unseen n-gram is taken for a seen one about once in a million.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import batches as bt
from pageloom.session import checkpointed, scratch_path

PART_BITS = 24
PART_BYTES = 10 << 20
SEGMENTS = 4096
OPEN_FILES = 128
FLUSH_TOKENS = 3 << 20
SCORE_TOKENS = 1 << 19
HOT, HOT_SAMPLE, HOT_SHARE = 256, 1000, 0.002
_BASE = 0x9E3779B97F4A7C15
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64),) * 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b % (1 << 64), np.uint64)]))
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        )
    return _powers


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in some bytes: differences of one running sum."""
    codes = np.frombuffer(data.lower(), np.uint8)
    edges = np.diff(np.concatenate([[True], _BLANK[codes], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = _powers_of(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def word_hashes(texts: list, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in order. Short texts go together, long ones in pieces."""
    held: list[bytes] = []
    size = 0

    def flush():
        starts, hashes = _hash_words(b" ".join(held))
        ends = np.cumsum([len(d) + 1 for d in held])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > chunk:
            yield from flush()
            held, size = [], 0
        if len(data) > 2 * chunk:
            if held:
                yield from flush()
                held, size = [], 0
            pieces, at = [], 0
            while at < len(data):
                to = at + chunk
                while to < len(data) and not _BLANK[data[to]]:
                    to += 1
                pieces.append(_hash_words(data[at:to])[1])
                at = to
            yield np.concatenate(pieces)
            continue
        held.append(data)
        size += len(data)
    if held:
        yield from flush()


def ngrams(words: list[np.ndarray], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, tokens per text): the word ``order - 1`` places back, ..., one place back, the token itself; every text ends with the end mark."""
    counts = np.array([len(w) + 1 for w in words], np.int64)
    pad = order - 1
    line = np.concatenate([p for w in words for p in (np.full(pad, START), w, np.array([END]))])
    target = np.ones(len(line), bool)
    first = np.cumsum(counts + pad) - counts - pad
    for k in range(pad):
        target[first + k] = False
    at = np.flatnonzero(target)
    return [line[at - k] for k in range(pad, -1, -1)], counts


def history_of(before: Iterable[np.ndarray]) -> np.ndarray:
    """Hash of the words before a token, oldest first; the nearest is hashed first."""
    hashed = np.uint64(0)
    for word in reversed(list(before)):
        hashed = mix(hashed * np.uint64(_BASE) + word)
    return hashed


def histories(words: list[np.ndarray], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(tokens, [history of 1 word, of 2, ...], tokens per text)."""
    columns, counts = ngrams(words, order)
    return columns[-1], [history_of(columns[order - k : -1]) for k in range(2, order + 1)], counts


@dataclass
class Layout:
    """Where keys live: parts, segments of neighbouring parts, the type of counts, and the words after which histories are dealt out.

    ``hot`` begins with the most frequent words.
    """

    parts: int
    order: int
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    counts: str = "uint32"

    def __post_init__(self):
        self.segments = min(self.parts, SEGMENTS)

    def segment_of(self, part: np.ndarray) -> np.ndarray:
        return part * np.uint64(self.segments) // np.uint64(self.parts)

    def of_word(self, word: np.ndarray) -> np.ndarray:
        return (mix(word) >> np.uint64(32)) % np.uint64(self.parts)

    def of_history(self, history: np.ndarray) -> np.ndarray:
        return (mix(history + np.uint64(1)) >> np.uint64(32)) % np.uint64(self.parts)

    def is_dealt(self, level: int, before: np.ndarray) -> np.ndarray:
        """Histories made of frequent words alone, ``HOT`` a level at most; ``before`` holds their words, a row for each place."""
        words = self.hot[: int(HOT ** (1 / (level - 1)) + 1e-9)]
        return np.all([np.isin(b, words) for b in np.atleast_2d(before)], axis=0)

    def of_gram(self, level: int, history: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        own, dealt = self.of_history(history), self.is_dealt(level, before)
        own[dealt] = (own[dealt] + self.of_word(word[dealt])) % np.uint64(self.parts)
        return own

    def place(self, level: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part, what rows of like place share): the word at levels 0 and 1, else the history."""
        word = columns[-1]
        if level <= 1:
            return self.of_word(word), word
        history = history_of(columns[:-1])
        return self.of_gram(level, history, columns[:-1], word), history


def _key(part: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One number that sorts by part and then by 40 bits of the hash."""
    return (part << np.uint64(64 - PART_BITS)) | (value >> np.uint64(PART_BITS))


def gram_hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history * np.uint64(_BASE) + word)


def _small(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least of 1, 2 and 4 bytes that holds them."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _pack(columns: np.ndarray, counts: np.ndarray) -> bytes:
    """A block: its distinct words once, every word as its number there, the numbers byte by byte, and the counts."""
    table, number = np.unique(columns, return_inverse=True)
    number, counts = _small(number.ravel()), _small(counts)
    head = np.array([*columns.shape, len(table), number.itemsize, counts.itemsize], np.int64)
    planes = np.ascontiguousarray(number.view(np.uint8).reshape(-1, number.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in (head, table, planes, counts)))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    k, n, words, wide, count = map(int, np.frombuffer(data, np.int64, 5))
    table = np.frombuffer(data, np.uint64, words, 40)
    at = 40 + 8 * words
    planes = np.frombuffer(data, np.uint8, k * n * wide, at).reshape(wide, -1)
    number = np.ascontiguousarray(planes.T).view(f"u{wide}").ravel()
    return table[number].reshape(k, n), np.frombuffer(data, f"u{count}", n, at + k * n * wide)


def _merged(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct key in key order, summed counts)."""
    by = np.argsort(key, kind="stable")
    key = key[by]
    new = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    return by[new], np.add.reduceat(counts[by].astype(np.int64), new) if len(new) else counts[:0].astype(np.int64)


_PLACED = "level int, place int, blob binary"
_BLOCKS = f"{_PLACED}, history bigint, sums array<bigint>"


def _block(level: int, place: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([level], pa.int32()), pa.array([place], pa.int32()), pa.array([blob], pa.binary())], names=["level", "place", "blob"]
    )


def _sums(level: int, history: list[int | None], sums: list[list[int]]) -> pa.RecordBatch:
    """Sums of a part: its histogram under no history, and those of dealt histories under theirs."""
    n = len(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array([level] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
         pa.array(history, pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
        names=["level", "place", "blob", "history", "sums"],
    )


def _with_sums(blocks: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks:
        n = b.num_rows
        yield b.append_column("history", pa.nulls(n, pa.int64())).append_column("sums", pa.nulls(n, pa.list_(pa.int64())))


def _send(level: int, place: np.ndarray, near: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Merge equal rows and send each place its block. Level 0 holds words; rows are ordered so that ``near`` repeats."""
    rough = (place << np.uint64(64 - PART_BITS)) | (mix(near) >> np.uint64(44) << np.uint64(20))
    if len(columns) > 1:
        rough |= gram_hash(near, columns[-1]) >> np.uint64(44)
    by = np.argsort(rough, kind="stable")
    columns, place, counts = columns[:, by], place[by], counts[by]
    new = np.concatenate([np.ones(min(len(place), 1), bool), np.any(columns[:, 1:] != columns[:, :-1], axis=0)])
    at = np.flatnonzero(new)
    if not len(at):
        return
    sums, place, columns = np.add.reduceat(counts.astype(np.int64), at), place[at], columns[:, at]
    cuts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield _block(level, int(place[a]), _pack(columns[:, a:b], sums[a:b]))


def _count(layout: Layout, at: int):
    """Tokens of a partition to blocks for segments: level 0 for words, level ``order`` for the longest n-grams."""
    def flush(words: list[np.ndarray]):
        columns = np.stack(ngrams(words, layout.order)[0])
        ones = np.ones(columns.shape[1], np.int64)
        for level, rows in ((0, columns[-1:]), (layout.order, columns)):
            part, near = layout.place(level, rows)
            yield from _send(level, layout.segment_of(part), near, rows, ones)

    def run(batches):
        held, size = [], 0
        for batch in bt.by_rows(batches):
            for w in word_hashes(batch.column(at).to_pylist()):
                held.append(w)
                size += len(w) + 1
                if size >= FLUSH_TOKENS:
                    yield from _with_sums(flush(held))
                    held, size = [], 0
        if held:
            yield from _with_sums(flush(held))

    return run


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = [_unpack(b) for b in blobs]
    return np.concatenate([r[0] for r in rows], axis=1), np.concatenate([r[1].astype(np.int64) for r in rows])


def _blobs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in bt.by_rows(batches, 64):
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)))


def _by_part(layout: Layout):
    """A segment's blocks to blocks of its parts, some millions of rows at a time."""
    def flush(level: int, blobs: list[bytes]):
        columns, counts = _joined(blobs)
        part, near = layout.place(level, columns)
        yield from _send(level, part, near, columns, counts)

    def run(batches):
        held: dict[int, list[bytes]] = {}
        size: dict[int, int] = {}
        for level, _, blob in _blobs(batches):
            held.setdefault(level, []).append(blob)
            size[level] = size.get(level, 0) + zstandard.frame_content_size(blob)
            if size[level] >= 8 * FLUSH_TOKENS:
                yield from flush(level, held.pop(level))
                size[level] = 0
        for level, blobs in held.items():
            yield from flush(level, blobs)

    return run


class _Files:
    """Files of one segment and level: appended to under other names and renamed at the end, so that a repeated task cannot leave half a file."""

    def __init__(self, folder: str, level: int, segment: int):
        self.stem, self.mark, self.open = f"{folder}/{level}-{segment}", f"{os.getpid()}.{os.urandom(4).hex()}", {}

    def append(self, name: str, values: np.ndarray) -> None:
        if name not in self.open:
            self.open[name] = open(f"{self.stem}-{name}.{self.mark}", "wb")
        values.tofile(self.open[name])

    def close(self) -> None:
        for name, out in self.open.items():
            out.close()
            os.replace(out.name, f"{self.stem}-{name}")


def _reduce(layout: Layout, folder: str):
    """Blocks sorted by level and part to files, rows of sums, and blocks for the next level."""
    def finish(level: int, part: int, blobs: list[bytes], files: _Files):
        columns, counts = _joined(blobs)
        word = columns[-1]
        gram = mix(word) if level <= 1 else gram_hash(history_of(columns[:-1]), word)
        at, sums = _merged(gram, counts)
        files.append("key", _key(np.full(len(at), part, np.uint64), gram[at]))
        files.append("count", sums.astype(layout.counts))
        own: list[int | None] = [None]
        lines = [[*(int((sums == i).sum()) for i in (1, 2, 3, 4)), len(at), int(sums.sum())]]
        if level >= 2:
            columns = columns[:, at]
            history = history_of(columns[:-1])
            by = np.argsort(mix(history + np.uint64(1)), kind="stable")
            new = np.flatnonzero(np.concatenate([[True], history[by][1:] != history[by][:-1]]))
            sums = sums[by]
            stats = np.stack([np.add.reduceat(v.astype(np.int64), new) for v in (sums, sums == 1, sums == 2, sums >= 3)], axis=1)
            found, dealt = history[by][new], layout.is_dealt(level, columns[:-1, by][:, new])
            own += found[dealt].view(np.int64).tolist()
            lines += stats[dealt].tolist()
            files.append("history", _key(np.full((~dealt).sum(), part, np.uint64), mix(found[~dealt] + np.uint64(1))))
            files.append("stats", stats[~dealt].astype(layout.counts))
        yield _sums(level, own, lines)
        if level >= 2:
            rows = columns[1:]
            part_of, near = layout.place(level - 1, rows)
            yield from _with_sums(_send(level - 1, layout.segment_of(part_of), near, rows, np.ones(len(at), np.int64)))

    def run(batches):
        own, files, place, blobs = None, None, None, []
        for level, part, blob in _blobs(batches):
            if own is not None and own != (level, part):
                yield from finish(*own, blobs, files)
                blobs = []
            segment = int(layout.segment_of(np.uint64(part)))
            if place != (level, segment):
                if files:
                    files.close()
                place, files = (level, segment), _Files(folder, level, segment)
            own = (level, part)
            blobs.append(blob)
        if own is not None:
            yield from finish(*own, blobs, files)
            files.close()

    return run


def discounts(low: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of types with counts 1 to 4.

    They are above 0, so that every level leaves a share to the one below.
    """
    if min(low):
        y = low[0] / (low[0] + 2 * low[1])
        out = [i - (i + 1) * y * low[i] / low[i - 1] for i in (1, 2, 3)]
        if all(0 < d <= i for i, d in enumerate(out, 1)):
            return out
    return [0.5, 1.0, 1.5]  # too few types to estimate from


@dataclass
class Model:
    """What a scoring task is sent: the layout, the sums, and where the files are."""

    folder: str
    layout: Layout
    tokens: int
    types: int
    bigram_types: int
    free: float  # the share of the lowest level that its discounts leave to unknown words
    discounts: dict[int, list[float]]
    hot: dict[int, dict[int, list[int]]]


def _mounted(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError("memory mapping needs a mounted shared folder; pass one as folder")
    return parsed.path


def train(docs: DataFrame, text: str = "text", order: int = 2, folder: str | None = None) -> Model:
    """Count the n-grams of all rows and write the model below the shared folder (or ``folder``)."""
    spark = docs.sparkSession
    folder = _mounted(folder or scratch_path(spark, "ngrams"))
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(F.col(text).alias("text"))
    seen = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    sample = texts.sample(min(1.0, HOT_SAMPLE / max(seen["rows"], 1)), seed=7)
    size = int(seen["bytes"] or 0)
    # no count exceeds the number of tokens: half the bytes, rounded up in each text, and an end mark each
    counts = "uint32" if size + 2 * seen["rows"] < 1 << 32 else "uint64"
    layout = Layout(min(size // PART_BYTES + 1, 1 << PART_BITS), order, _frequent(sample), counts)
    level, blocks = order, bt.bounded(texts).mapInArrow(_count(layout, 0), _BLOCKS)
    low = {k: [0, 0, 0, 0] for k in range(order + 1)}
    types, total = dict.fromkeys(low, 0), dict.fromkeys(low, 0)
    hot: dict[int, dict[int, list[int]]] = {}
    while level >= 1:
        placed = blocks.select("level", "place", "blob").repartitionById(layout.segments, F.col("place"))
        if layout.segments < layout.parts:
            placed = placed.mapInArrow(_by_part(layout), _PLACED)
        done = checkpointed(placed.sortWithinPartitions("level", "place").mapInArrow(_reduce(layout, folder), _BLOCKS))
        sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(6)]
        for r in done.filter("sums IS NOT NULL").groupBy("level", "history").agg(*sums).collect():  # HOT + 1 rows a level at most
            k, line = r["level"], [r[f"s{i}"] for i in range(6)]
            if r["history"] is None:
                low[k], types[k], total[k] = line[:4], line[4], line[5]
            else:
                hot.setdefault(k, {})[r["history"] % (1 << 64)] = line[:4]
        blocks = done.filter("blob IS NOT NULL")
        level -= 1
    found = {k: discounts(low[k]) for k in range(1, order + 1)}
    ones = [low[1][0], low[1][1], types[1] - low[1][0] - low[1][1]]
    free = sum(n * d for n, d in zip(ones, found[1])) / total[1] if total[1] else 1.0
    return Model(folder, layout, total[0], types[0], total[1], free, found, hot)


def _frequent(sample: DataFrame) -> np.ndarray:
    """Words with a share of over ``HOT_SHARE`` of the sample's tokens, the start mark with them; at most ``HOT``."""
    def count(batches):
        for batch in bt.by_rows(batches):
            words = np.concatenate([np.empty(0, np.uint64), *word_hashes(batch.column(0).to_pylist())])
            own, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["word", "n"])

    counts = sample.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = F.lit(HOT_SHARE) * F.lit(counts.agg(F.sum("n").alias("n")).first()["n"] or 1)
    rows = counts.filter(F.col("n") > total).orderBy(F.desc("n")).limit(HOT - 1).collect()
    return np.concatenate([[START], np.array([r["word"] for r in rows], np.int64).view(np.uint64)]).astype(np.uint64)


class Scorer:
    """Looks up sorted batches of keys in the mapped files; of those the ``OPEN_FILES`` last used stay mapped."""

    def __init__(self, model: Model):
        self.model, self.files = model, OrderedDict()

    def _map(self, level: int, segment: int, name: str) -> np.ndarray | None:
        key = (level, segment, name)
        if key not in self.files:
            path = f"{self.model.folder}/{level}-{segment}-{name}"
            kind = np.uint64 if name in ("key", "history") else self.model.layout.counts
            there = os.path.exists(path) and os.path.getsize(path)
            self.files[key] = np.memmap(path, kind, "r") if there else None
            if len(self.files) > OPEN_FILES:
                self.files.popitem(last=False)
        self.files.move_to_end(key)
        return self.files[key]

    def find(self, level: int, part: np.ndarray, value: np.ndarray, keys: str, values: str, width: int) -> np.ndarray:
        """The values beside each key, zeros for a key that is not there."""
        wanted = _key(part, value)
        by = np.argsort(wanted, kind="stable")
        line, out = wanted[by], np.zeros((len(wanted), width), np.int64)
        segments = self.model.layout.segment_of(line >> np.uint64(64 - PART_BITS)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(segments[1:] != segments[:-1]) + 1, [len(segments)]]) if len(segments) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = self._map(level, int(segments[a]), keys)
            if own is None:
                continue
            at = np.searchsorted(own, line[a:b])
            at[at == len(own)] = 0
            hit = own[at] == line[a:b]
            out[by[a:b][hit]] = self._map(level, int(segments[a]), values).reshape(-1, width)[at[hit]]
        return out

    def score(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        m = self.model
        order = m.layout.order
        columns, counts = ngrams(words, order)
        tokens = columns[-1]
        own, back = np.unique(tokens, return_inverse=True)
        part = m.layout.of_word(own)
        raw = self.find(0, part, mix(own), "key", "count", 1)[:, 0]
        base = np.log10((raw + 0.5) / (m.tokens + 0.5 * (m.types + 1)))[back]
        low = self.find(1, part, mix(own), "key", "count", 1)[:, 0]
        p = self._level(1, low, None, np.full(len(own), 1 / (m.types + 1)))[back]
        for k in range(2, order + 1):
            before = columns[order - k : -1]
            history = history_of(before)
            contexts, at = np.unique(history, return_inverse=True)
            stats = self.find(k, m.layout.of_history(contexts), mix(contexts + np.uint64(1)), "history", "stats", 4)
            for h, s in m.hot.get(k, {}).items():
                i = np.searchsorted(contexts, np.uint64(h))
                if i < len(contexts) and contexts[i] == np.uint64(h):
                    stats[i] = s
            n = self.find(k, m.layout.of_gram(k, history, before, tokens), gram_hash(history, tokens), "key", "count", 1)[:, 0]
            p = self._level(k, n, stats[at], p)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return counts, np.add.reduceat((raw > 0)[back].astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)

    def _level(self, k: int, n: np.ndarray, stats: np.ndarray | None, lower: np.ndarray) -> np.ndarray:
        """Interpolate: the discounted share of the counts, and what the discounts freed times the lower level."""
        d = np.array([0.0, *self.model.discounts[k]])
        kept = n - d[np.minimum(n, 3)]
        if stats is None:
            return kept / max(self.model.bigram_types, 1) + self.model.free * lower
        total = np.maximum(stats[:, 0], 1)
        return np.where(stats[:, 0] > 0, kept / total + stats[:, 1:] @ d[1:] / total * lower, lower)


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score (sums of log10 probabilities); row-local."""
    added = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}
    kept = [c for c in docs.columns if c not in added]
    source = docs.select(*kept)
    place = kept.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + [f"{n} {t}" for n, t in added.items()])

    def run(batches):
        scorer = Scorer(model)
        for batch in bt.by_rows(batches, 2048):
            found, held, size = [], [], 0
            for words in word_hashes(batch.column(place).to_pylist()):
                held.append(words)
                size += len(words) + 1
                if size >= SCORE_TOKENS:
                    found.append(scorer.score(held))
                    held, size = [], 0
            if held:
                found.append(scorer.score(held))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.concatenate(x)) for x in zip(*found))], names=[*kept, *added])

    return bt.bounded(source).mapInArrow(run, schema)
