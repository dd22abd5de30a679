"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; every run of characters that are neither letters nor marks counts as one blank, and one
stands at either end. Its n-grams of one to four characters are hashed into ``2 ** bits`` buckets. A language is the
vector of its buckets' log probabilities (with a small count added to each) and the log of its share of rows.

Counting sees every row that is learned from. A task adds up dense counts per language and sends them on
as compressed blocks of ``BLOCK`` buckets, so the shuffle carries a bounded table per task and never an n-gram; the
blocks of one language go to many tasks, also for a language that holds most rows. What reaches the
driver and is broadcast is one matrix, languages by buckets, of at most ``MATRIX_CELLS`` numbers: beyond
64 languages the number of buckets halves as the languages double.

Log probabilities are whole numbers (units of 2 ** -16), so that a text's sums are exact: they depend neither on the
batch it comes in nor on the order of adding, and equal texts get equal results.

Cases: a text that is NULL or has no letter is ``und`` with score 0, and so is every text where nothing was
learned. Rows with a NULL language are not learned from; an empty language string is a language; a language
whose rows have no text competes with its share of rows alone. Of equally probable languages the
first in code point order is returned. Repeated rows count each. More than ``MAX_LANGUAGES`` languages are an
error. An empty table gives no rows. Other columns pass through; the columns added replace theirs.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import batches as bt

SIZES = (1, 2, 3, 4)
BITS, BLOCK = 18, 4096
MATRIX_CELLS, MAX_LANGUAGES = 1 << 24, 4096
ADDED = 0.1
UNDETERMINED = "und"
# Characters handled at once, and count cells a task holds before it sends them on.
PIECE, HELD_CELLS = 1 << 17, 1 << 24
_UNIT = 1 << 16
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def character_kinds() -> tuple[np.ndarray, np.ndarray]:
    """(first code points, kinds) of the runs of equal kind: 2 for letters, 1 for marks, 0 for the rest."""
    kinds = np.frombuffer(bytes({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    return starts.astype(np.int32), kinds[starts]


def kind_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    starts, kinds = runs
    return np.repeat(kinds, np.diff(np.concatenate([starts, [sys.maxunicode + 1]])))


def _pieces(texts: list) -> Iterator[list[tuple[int, str]]]:
    """(index, lower-cased text) in groups of bounded size; a long text comes alone, in several pieces."""
    held, size = [], 0
    for i, t in enumerate(texts):
        low = f" {(t or '').lower()} "
        if held and size + len(low) > PIECE:
            yield held
            held, size = [], 0
        if len(low) > PIECE:
            for at in range(0, len(low), PIECE):
                yield [(i, low[at : at + PIECE])]
            continue
        held.append((i, low))
        size += len(low)
    if held:
        yield held


def _windows(codes: np.ndarray, doc: np.ndarray, carried: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of the n-grams of every size that end after the first ``carried`` characters."""
    value = np.zeros(len(codes), np.uint64)
    shift = np.uint64(64 - bits)
    for n in range(1, max(SIZES) + 1):
        if len(codes) < n:
            return
        # value[i] is now the hash of the n characters from i on
        value = (value[: len(codes) - n + 1] ^ codes[n - 1 :]) * _MIX[n % len(_MIX)]
        value ^= value >> np.uint64(29)
        first = max(carried - n + 1, 0)
        if n not in SIZES or first >= len(value):
            continue
        buckets = ((value[first:] * _MIX[0]) >> shift).view(np.int64)
        head, last = doc[first : first + len(buckets)], doc[first + n - 1 :]
        if head[0] != last[-1]:
            inside = head == last
            head, buckets = head[inside], buckets[inside]
        if len(head):
            yield head, buckets


def gram_slices(texts: list, table: np.ndarray, bits: int, letters: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers in ascending order, buckets) of all n-grams, in slices; ``letters`` notes the texts that have one."""
    keep = max(SIZES) - 1
    tail, tail_of = np.empty(0, np.uint32), -1
    for group in _pieces(texts):
        codes = np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.array([i for i, _ in group], np.int32), [len(t) for _, t in group])
        kind = table[codes]
        if letters is not None:
            letters[doc[kind == 2]] = True
        if tail_of != group[0][0]:
            tail = tail[:0]
        blank = kind == 0
        before = np.concatenate([[len(tail) > 0 and tail[-1] == 32], blank[:-1]])
        new = np.concatenate([[len(tail) == 0], doc[1:] != doc[:-1]])
        kept = ~blank | ~before | new
        codes, doc = np.where(blank, np.uint32(32), codes)[kept], doc[kept]
        carried = len(tail)
        codes = np.concatenate([tail, codes])
        doc = np.concatenate([np.full(carried, group[0][0], np.int32), doc])
        yield from _windows(codes.astype(np.uint64), doc, carried, bits)
        tail, tail_of = codes[max(len(codes) - keep, 0) :][doc[max(len(doc) - keep, 0) :] == group[-1][0]], group[-1][0]


@dataclass
class Model:
    """``logs`` holds log probabilities in units of 2 ** -16, languages by buckets; ``prior`` those of the languages."""

    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray
    bits: int
    runs: tuple[np.ndarray, np.ndarray]

    def predict(self, texts: list, table: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, its posterior probability) of each text."""
        letters = np.zeros(len(texts), bool)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total = np.repeat(self.prior[:, None], len(texts), axis=1)
        step = max(1, (1 << 22) // len(self.languages))
        for doc, buckets in gram_slices(texts, table, self.bits, letters):
            for at in range(0, len(doc), step):
                own, place = doc[at : at + step], buckets[at : at + step]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[:, own[starts]] += np.add.reduceat(np.take(self.logs, place, axis=1), starts, axis=1, dtype=np.int64)
        best = total.argmax(axis=0)
        top = total[best, np.arange(len(texts))]
        score = 1 / np.exp((total - top) / _UNIT).sum(axis=0)
        named = [self.languages[b] if known else UNDETERMINED for b, known in zip(best, letters)]
        return named, np.where(letters, score, 0.0)


_BLOCKS = "lang string, block int, counts binary"


def _pack(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.int64).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)


def _record(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["lang", "block", "counts"]
    )


def _counted(runs: tuple[np.ndarray, np.ndarray], bits: int):
    """Rows (text, lang) of a partition to blocks of counts."""
    width = min(BLOCK, 1 << bits)

    def sent(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            parts = counts.reshape(-1, width)
            rows = [(lang, int(b), _pack(parts[b])) for b in np.flatnonzero(parts.any(axis=1))]
            if rows:
                yield _record(rows)

    def run(batches):
        table, held = kind_table(runs), {}
        for batch in bt.by_rows(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                if lang not in held:
                    if (len(held) + 1) << bits > HELD_CELLS:
                        yield from sent(held)
                        held = {}
                    held[lang] = np.zeros(1 << bits, np.int64)
                for _, buckets in gram_slices([t for t, own in zip(texts, langs) if own == lang], table, bits):
                    held[lang] += np.bincount(buckets, minlength=1 << bits)
        yield from sent(held)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by language and block to their sums, one block held at a time."""
    own, total = None, None
    for batch in bt.by_rows(batches, 256):
        for lang, block, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (lang, block) != own:
                if own is not None:
                    yield _record([(*own, _pack(total))])
                own, total = (lang, block), np.zeros_like(_unpack(blob))
            total = total + _unpack(blob)
    if own is not None:
        yield _record([(*own, _pack(total))])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows given; the caller leaves out what is held out."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang IS NOT NULL")
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    known = sorted((r["lang"], r["n"]) for r in found)
    languages = [name for name, _ in known]
    bits = BITS
    while len(languages) << bits > MATRIX_CELLS:
        bits -= 1
    runs = character_kinds()
    blocks = bt.bounded(rows).mapInArrow(_counted(runs, bits), _BLOCKS)
    sums = blocks.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(_added, _BLOCKS)
    counts = np.zeros((len(languages), 1 << bits), np.int64)
    place, width = {name: i for i, name in enumerate(languages)}, min(BLOCK, 1 << bits)
    for r in sums.toLocalIterator():  # the blocks of one bounded matrix
        counts[place[r["lang"]], r["block"] * width : (r["block"] + 1) * width] = _unpack(bytes(r["counts"]))
    return model_of(languages, np.array([n for _, n in known], float), counts, bits, runs)


def model_of(languages: list[str], rows: np.ndarray, counts: np.ndarray, bits: int, runs: tuple[np.ndarray, np.ndarray]) -> Model:
    """The model of these counts, smoothed."""
    logs = np.empty(counts.shape, np.int32)
    for i, own in enumerate(counts):
        logs[i] = np.rint(np.log((own + ADDED) / (own.sum() + ADDED * counts.shape[1])) * _UNIT)
    return Model(languages, np.rint(np.log(rows / max(rows.sum(), 1)) * _UNIT).astype(np.int64), logs, bits, runs)


def with_languages(docs: DataFrame, model: Model, text: str = "text", into: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability; row-local."""
    # at most MATRIX_CELLS numbers; as plain values, since tasks have no classes of this package to load
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.logs, model.bits, model.runs))
    loaded: list = []

    def work(texts: list) -> list[pa.Array]:
        if not loaded:
            own = Model(*shared.value)
            loaded.extend([own, kind_table(own.runs)])
        named, scores = loaded[0].predict(texts, loaded[1])
        return [pa.array(named, pa.string()), pa.array(scores, pa.float64())]

    return bt.add_columns(docs, text, {into: "string", score: "double"}, work)
