"""Linear-time helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.binding import let

_BLOCK = 128


def _indices(n: Column) -> Column:
    """0..n-1, empty for 0 (a bare sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def indices(n: Column) -> Column:
    return let(n, _indices)


def _scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """[start, step(start, items[0]), ...] without its last entry; one array copy per item, so for short arrays."""
    steps = F.aggregate(
        F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))),
        F.array(start).cast(f"array<{kind}>"),
        lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x)).cast(f"array<{kind}>")),
    )
    return F.when(F.size(items) > 0, steps).otherwise(F.array().cast(f"array<{kind}>"))


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The fold of all items *before* each position, for an associative ``step`` with unit ``start``.

    Spark's fold can only grow an array by copying it. Blocks keep that linear for any length met in
    a text: fold each block, scan the folds, then scan inside the blocks.
    """

    def whole(a: Column) -> Column:
        n_blocks = F.ceil(F.size(a) / F.lit(_BLOCK)).cast("int")
        blocks = F.transform(_indices(n_blocks), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))

        def of_blocks(bs: Column) -> Column:
            folds = F.transform(bs, lambda b: F.aggregate(b, start.cast(kind), step))
            return let(
                _scan_blocks(folds),
                lambda before: F.flatten(F.transform(bs, lambda b, i: _scan(b, F.get(before, i), step, kind))),
            )

        def _scan_blocks(folds: Column) -> Column:
            return let(folds, lambda f: _scan(f, start.cast(kind), step, kind))

        return let(blocks, of_blocks)

    return let(items, lambda a: F.when(F.size(a) <= _BLOCK, _scan(a, start.cast(kind), step, kind)).otherwise(whole(a)))


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start,end,hit>>: leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches come from a split with the same pattern, so the offsets are sums
    of lengths; ``keep`` drops matches after they have taken their text.
    """
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def located(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        widths = F.transform(hits, lambda h: F.char_length(h))
        steps = F.zip_with(gaps, F.concat(F.array(F.lit(0)), widths), lambda g, w: F.char_length(g) + w)
        # steps[i] = width of hit i-1 plus gap i; the one past the last hit is not needed
        own = F.slice(steps, 1, F.size(hits))
        starts = F.zip_with(running(own, F.lit(0), lambda a, b: a + b, "int"), own, lambda a, b: a + b)
        spans = F.zip_with(
            starts, hits, lambda s, h: F.struct(s.alias("start"), (s + F.char_length(h)).alias("end"), h.alias("hit"))
        )
        return spans if keep is None else F.filter(spans, lambda x: keep(x["hit"]))

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) > 0, located(hits)).otherwise(empty),
    )
