"""Benchmark decontamination with an FM-index per shard of the training texts.

A task cuts its rows into shards of bounded length and indexes each one: words become numbers, the
shard's word sequence gets a suffix array, and the Burrows-Wheeler transform of the sequence goes into
a wavelet tree whose ranks answer, for any phrase, which suffixes begin with it. All test phrases
are searched backward side by side, a word at a time. The hits' positions come from sampled suffix
positions, reached by stepping backward through the transform, and the words they cover are merged into
removal spans. Nothing is shuffled, and only the phrases travel; they go in blocks of bounded size,
one pass over the rows for each.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered. A phrase is a window of
``window`` consecutive words of a test item; an item of fewer words, but not none, is one phrase.

Cases: a NULL or empty text has no words and no hits; items without words are never hit; the same
phrase in several items counts for each; repeated rows are searched each; no items means no hits. The
other columns of the documents pass through, and columns this operator adds replace theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import batches as bt

# Fixed value: ASCII letters and digits, and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
# Every other byte becomes a blank, and A-Z are lowered: then words are what blanks leave.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SHARD_WORDS = 1 << 19
SAMPLE_EVERY = 8
BLOCK_PHRASES = 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, whose last symbol is unique and least, by prefix doubling.

    Each round sorts only suffixes that still share their rank, by the rank of what follows them.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # a suffix's rank: where its group starts
    rank = np.empty(n, np.int64)
    rank[order] = group
    step = 1
    while True:
        ends = np.append(np.flatnonzero(new)[1:], n)
        size = ends - np.flatnonzero(new)
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        places = np.flatnonzero(tied)
        suffixes = order[places]
        # a tied suffix cannot reach the end: the unique last symbol would have told it apart
        key = rank[suffixes] * n + rank[suffixes + step]
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[places] = suffixes
        apart = np.concatenate([[True], key[1:] != key[:-1]])
        new[places] = apart
        rank[suffixes] = places[np.flatnonzero(apart)][np.cumsum(apart) - 1]
        step *= 2


class WaveletTree:
    """Ranks over a sequence of numbers below ``2 ** levels``, as one row of bits per level.

    Level by level, from the highest bit, the sequence is split stably into zeros and ones; the
    counts of ones before each place lead a symbol's range down the levels.
    """

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in reversed(range(levels)):
            bits = values >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            mask = bits.astype(bool)
            values = np.concatenate([values[~mask], values[mask]])

    def rank(self, symbols: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place; ``starts``: where its run begins on the last level."""
        at = places
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros):
            one = (symbols >> level & 1).astype(bool)
            before = ones[at]
            at = np.where(one, zeros + before, at - before)
        return at - starts[symbols]

    def run_starts(self, n_symbols: int) -> np.ndarray:
        """Where each symbol's run begins on the last level."""
        symbols = np.arange(n_symbols)
        at = np.zeros(n_symbols, np.int64)
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros):
            before = ones[at]
            at = np.where((symbols >> level & 1).astype(bool), zeros + before, at - before)
        return at

    def access(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, place on the last level) of each place."""
        at, symbols = places, np.zeros(len(places), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[at]
            one = ones[at + 1] > before
            symbols = symbols * 2 + one
            at = np.where(one, zeros + before, at - before)
        return symbols, at


class FMIndex:
    """Index of a word sequence; ``sequence`` holds numbers from 1, 0 is the end mark this class adds."""

    def __init__(self, sequence: np.ndarray, n_symbols: int, every: int = SAMPLE_EVERY):
        s = np.append(sequence, 0).astype(np.int64)
        order = suffix_array(s)
        self.n_symbols = n_symbols
        self.tree = WaveletTree(s[order - 1], max(int(n_symbols - 1).bit_length(), 1))
        self.run_starts = self.tree.run_starts(n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n_symbols))])
        kept = order % every == 0
        self.sampled = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
        self.positions = order[kept]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that begin with each phrase; rows of ``phrases`` are right-aligned."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.first[-1])
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbols = phrases[live, -back]
            known = symbols > 0
            low[live[~known]] = high[live[~known]] = 0
            live, symbols = live[known], symbols[known]
            both = self.tree.rank(np.concatenate([symbols] * 2), np.concatenate([low[live], high[live]]), self.run_starts)
            base = self.first[symbols]
            low[live], high[live] = base + both[: len(live)], base + both[len(live) :]
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffix places: step backward until a sampled one."""
        out, steps, left, at = np.empty(len(places), np.int64), 0, np.arange(len(places)), places
        while len(left):
            done = self.sampled[at + 1] > self.sampled[at]
            out[left[done]] = self.positions[self.sampled[at[done]]] + steps
            left, at = left[~done], at[~done]
            symbols, last = self.tree.access(at)
            at = self.first[symbols] + last - self.run_starts[symbols]
            steps += 1
        return out


class Phrases:
    """A block of distinct phrases and the items they come from."""

    def __init__(self, rows: list[tuple[bytes, list]]):
        split = [phrase.split(b" ") for phrase, _ in rows]
        self.items = [items for _, items in rows]
        self.words = {w: i for i, w in enumerate(sorted({w for p in split for w in p}))}
        self.lengths = np.array([len(p) for p in split], np.int64)
        self.numbers = np.full((len(split), max(map(len, split), default=1)), -1, np.int64)
        for row, p in zip(self.numbers, split):
            row[len(row) - len(p) :] = [self.words[w] for w in p]


def test_phrases(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(phrase, items): every distinct phrase, words joined by blanks, with the sorted ids of its items."""
    def cut(batches):
        for b in bt.by_rows(batches):
            ids, phrases = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t)
                found = {b" ".join(words[k : k + window]) for k in range(max(len(words) - window, 0) + 1)} if words else set()
                ids += [i] * len(found)
                phrases += found
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(ids, pa.string())], names=["phrase", "item"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "phrase binary, item string").groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _pieces(texts: list[list[bytes]], most: int, overlap: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(text number, first word, words); a text over ``most`` words is cut, and pieces overlap by a phrase less a word."""
    for row, words in enumerate(texts):
        step = max(most - overlap, 1)
        for base in range(0, max(len(words) - overlap, 1), step) if len(words) > most else (0,):
            yield row, base, words[base : base + step + overlap] if len(words) > most else words


def _shards(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of pieces with at most ``most`` words together; a longer one is a shard of its own."""
    start, held = 0, 0
    for i, c in enumerate(counts.tolist()):
        if i > start and held + c > most:
            yield start, i
            start, held = i, 0
        held += c
    if start < len(counts):
        yield start, len(counts)


def search_shard(texts: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Per text: merged word spans of all hits, and the numbers of the phrases that occur."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    out: list = [([], []) for _ in texts]
    if not counts.sum() or not len(phrases.lengths):
        return out
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    vocabulary = flat.dictionary.to_pylist()
    # 0 ends the sequence, 1 parts the texts, words follow
    numbers = np.empty(counts.sum() + len(texts), np.int64)
    ends = np.cumsum(counts + 1)
    numbers[ends - 1] = 1
    inside = np.ones(len(numbers), bool)
    inside[ends - 1] = False
    numbers[inside] = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
    index = FMIndex(numbers, len(vocabulary) + 2)
    own = np.zeros(len(phrases.words) + 1, np.int64)  # phrase word -> shard word, 0 if the shard lacks it
    for i, w in enumerate(vocabulary):
        k = phrases.words.get(w)
        if k is not None:
            own[k] = i + 2
    low, high = index.ranges(own[phrases.numbers], phrases.lengths)
    size = high - low
    found = np.flatnonzero(size > 0)
    if not len(found):
        return out
    which = np.repeat(found, size[found])
    offset = np.arange(len(which)) - np.repeat(np.cumsum(size[found]) - size[found], size[found])
    at = index.locate(low[which] + offset)
    by = np.argsort(at, kind="stable")
    at, which = at[by], which[by]
    row = np.searchsorted(ends, at, "right")
    begin = at - (ends - counts - 1)[row]
    for r, b, e, p in zip(row.tolist(), begin.tolist(), (begin + phrases.lengths[which]).tolist(), which.tolist()):
        spans, hits = out[r]
        if spans and b <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((b, e))
        hits.append(p)
    return out


ADDED = {"n_words": "bigint", "hit_spans": "array<struct<first:int,last:int>>", "hit_items": "array<string>"}


def find_contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` and ``hit_items``.

    ``hit_spans`` are the merged spans of word numbers, ``last`` exclusive, in order; ``hit_items`` the
    ids, as sorted strings, of the items with a phrase in the text.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    found = docs.select(*kept)
    blocks, block = [], []
    for r in test_phrases(items, item_id, item_text, window).toLocalIterator():
        block.append((bytes(r["phrase"]), r["items"]))
        if len(block) == BLOCK_PHRASES:
            blocks.append(block)
            block = []
    for n, part in enumerate([*blocks, block] if block or not blocks else blocks):
        found = _search_block(found, text, part, first=n == 0)
    return found


def _search_block(docs: DataFrame, text: str, block: list, first: bool) -> DataFrame:
    """One pass over the rows; later passes merge with what the earlier ones found."""
    shared = docs.sparkSession.sparkContext.broadcast(sorted(block))  # at most BLOCK_PHRASES phrases
    kept = [c for c in docs.columns if c not in ADDED]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    place, before = docs.columns.index(text), [] if first else [docs.columns.index(c) for c in list(ADDED)[1:]]
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        phrases = Phrases(shared.value)
        for batch in bt.by_rows(batches, 1024):
            texts = [words_of(t) for t in batch.column(place).to_pylist()]
            counts = np.fromiter(map(len, texts), np.int64, len(texts))
            spans, items = [[] for _ in texts], [set() for _ in texts]
            pieces = list(_pieces(texts, SHARD_WORDS, max(phrases.lengths.tolist(), default=1) - 1))
            sizes = np.fromiter((len(words) for _, _, words in pieces), np.int64, len(pieces))
            for a, b in _shards(sizes, SHARD_WORDS):
                for (row, base, _), (own, hits) in zip(pieces[a:b], search_shard([p[2] for p in pieces[a:b]], phrases)):
                    spans[row] = _merged([*spans[row], *((x + base, y + base) for x, y in own)])
                    items[row] |= {i for p in set(hits) for i in phrases.items[p]}
            if before:
                for n, (old_spans, old_items) in enumerate(zip(batch.column(before[0]).to_pylist(), batch.column(before[1]).to_pylist())):
                    spans[n] = _merged([*spans[n], *((s["first"], s["last"]) for s in old_spans)])
                    items[n] |= set(old_items)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ADDED],
                    pa.array(counts),
                    pa.array([[{"first": x, "last": y} for x, y in s] for s in spans], span),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ],
                names=[*kept, *ADDED],
            )

    return bt.bounded(docs).mapInArrow(run, ", ".join([*fields, *[f"{n} {t}" for n, t in ADDED.items()]]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Cut the hit words out of the text, with what stands between them; adds nothing and drops ``ADDED``."""
    place, spans = found.columns.index(text), found.columns.index("hit_spans")
    kept = [c for c in found.columns if c not in ADDED]

    def cut(value, hits):
        if not hits:
            return value
        data = value.encode("utf-8", "surrogatepass")
        words = [m.span() for m in WORD.finditer(data.translate(_FOLD))]
        pieces, at = [], 0
        for s in hits:
            pieces.append(data[at : words[s["first"]][0]])
            at = words[s["last"] - 1][1]
        return b"".join([*pieces, data[at:]]).decode("utf-8", "surrogatepass")

    def run(batches):
        for batch in bt.by_rows(batches):
            fresh = [cut(t, s) for t, s in zip(batch.column(place).to_pylist(), batch.column(spans).to_pylist())]
            columns = [pa.array(fresh, pa.string()) if c == text else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return bt.bounded(found).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name in kept))
