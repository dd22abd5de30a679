"""Arrays read in byte ranges, against the whole file parsed at once."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.sources import ranges, results

values = st.recursive(
    st.none() | st.integers(-5, 5) | st.text(alphabet='ab"\\[]{},é😀\n', max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(alphabet='k"\\{', max_size=3), inner, max_size=3), max_leaves=8,
)


def cut(data, size, piece):
    """The records found range by range, as the two passes find them."""
    pieces = lambda at, to: ((i, data[i : min(i + piece, to)]) for i in range(at, to, piece))
    state, depth, found = ranges.OUTSIDE, 0, []
    for at in range(0, len(data), size):
        stop = min(at + size, len(data))
        found += ranges.records(pieces(at, len(data)), stop, state, depth)
        ends, depths = ranges.summary(d for _, d in pieces(at, stop))
        state, depth = ends[state], depth + depths[state]
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(values, max_size=6), st.integers(1, 40), st.integers(1, 30), st.booleans(), st.sampled_from([None, 1]))
def test_each_record_once_at_every_cut(items, size, piece, plain, indent):
    data = json.dumps(items, ensure_ascii=plain, indent=indent).encode()
    found = cut(data, size, piece)
    assert [json.loads(v) for _, v in found] == [i for i in items if isinstance(i, (list, dict))]
    assert all(data[o : o + len(v)] == v for o, v in found)


def test_runs_of_backslashes():
    items = [{"a": "\\" * n + '"' * m, "b": "]}"} for n in range(6) for m in range(3)]
    data = json.dumps(items).encode()
    for size in range(1, 12):
        assert [json.loads(v) for _, v in cut(data, size, 5)] == items


def test_broken_off():
    assert [v for _, v in cut(b'[{"a": 1}, {"a": [2', 4, 3)] == [b'{"a": 1}', b'{"a": [2']


@pytest.mark.parametrize("range_bytes", [37, 4096, 64 << 20])
def test_files(spark, tmp_path, range_bytes):
    rng = random.Random(1)
    for name, n in [("a.json", 60), ("sub/b.json", 1), ("sub/none.json", 0), ("_skipped.json", 5)]:
        rows = [{"question": "".join(rng.choices('x"\\{]é \n', k=rng.randint(0, 30))), "eval_score": i} for i in range(n)]
        if n == 60:
            rows[7] = {"question": None, "retrieved": 1, "qdrant_context": [{"Year": 2019, "Wiki_content": "w" * 500}]}
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(json.dumps(rows, ensure_ascii=False))
    (tmp_path / "r" / "empty.json").write_text("")
    path = str(tmp_path / "r")
    got = results.read_large_arrays(spark, path, range_bytes=range_bytes)
    whole = results.read_result_arrays(spark, path)
    assert got.columns == whole.columns
    key = lambda r: (r["settings"].rsplit("/", 1)[-1], json.dumps(r.asDict(recursive=True) | {"settings": ""}, sort_keys=True))
    # Spark's reader makes a row of NULLs of an empty file
    assert sorted(map(key, got.collect())) == sorted(key(r) for r in whole.collect() if not r["settings"].endswith("empty.json"))
    if range_bytes == 37:
        assert ranges.read_array_records(spark, path, range_bytes).rdd.getNumPartitions() > 50


def test_no_files_and_other_files(spark, tmp_path):
    assert results.read_large_arrays(spark, str(tmp_path)).count() == 0
    (tmp_path / "lines.json").write_text('{"question": "a"}\n')
    with pytest.raises(Exception, match="does not begin with an array"):
        results.read_large_arrays(spark, str(tmp_path)).count()
