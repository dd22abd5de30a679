"""Repeated units against a plain scan."""

import random
import re

import pytest

from pageloom.llm import line_dedup, queries

PATTERNS = {"sentence": r"[^.!?\n]+[.!?]*", "line": r"[^\n]+", "paragraph": r"(?:[^\n]|\n(?![ \t\r]*\n))+"}


def brute(rows, unit, min_words):
    found, first = {}, {}
    texts = {}
    for i, t in rows:
        texts.setdefault((i, t or ""), None)
    for i, t in texts:
        units = [(m.start(), m.end(), " ".join(re.findall(r"[^\W_]+", m[0].lower()))) for m in re.finditer(PATTERNS[unit], t)]
        texts[i, t] = [u for u in units if u[2]]
    number = lambda i: -(2**63) if i is None else i
    for (i, _), units in texts.items():
        for s, _, norm in units:
            first[norm] = min(first.get(norm, (number(i), s)), (number(i), s))
    for (i, t), units in texts.items():
        run = []
        for u in [*units, None]:
            if u and (number(i), u[0]) > first[u[2]]:
                run.append(u)
                continue
            if sum(len(x[2].split()) for x in run) >= min_words:
                found.setdefault((i, t), []).append((run[0][0], run[-1][1]))
            run = []
    return found


PASSAGE = "This passage has been copied widely. It has many words in it! Short one. " * 2
ROWS = [
    (5, "Own start é. " + PASSAGE + "Own end."), (2, "Before\n" + PASSAGE.upper()), (9, "x, " + PASSAGE), (9, "x, " + PASSAGE), (9, "another under nine"),
    (1, None), (4, ""), (6, "...\n\n!!"), (None, "No id here. Alone and in peace."), (7, "No  id HERE; alone and in peace"), (8, "same line of ten words " * 3 + "\n" + "same line of ten words " * 3),
]


@pytest.mark.parametrize("unit", list(PATTERNS))
@pytest.mark.parametrize("min_words", [1, 10])
def test_spans(spark, documents, unit, min_words):
    rng = random.Random(4)
    parts = ["One two three.", "Four five six seven eight nine ten eleven.", "é ü", "\n", "\n\n", "Mine {}.", "-- --", "A b c d e f g h i j k!"]
    rows = ROWS + [(20 + k, " ".join(rng.choice(parts).replace("{}", str(rng.random())) for _ in range(rng.randint(1, 25)))) for k in range(60)]
    expected = brute(rows, unit, min_words)
    docs = documents(rows, "removed", "start", "row")
    got = {}
    for r in line_dedup.without_repeats(docs, unit, min_words).collect():
        got.setdefault(r["doc_id"], []).append(r)
        assert r["row"] == "clash"
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        cuts, kept, at = expected.get((i, t or ""), []), [], 0
        for a, b in cuts:
            kept.append((t or "")[at:a])
            at = b
        plain = None if t is None else "".join([*kept, t[at:]])
        assert (plain, cuts) in [(r["text"], [(s["start"], s["end"]) for s in r["removed"]]) for r in got[i]]


def test_passage_is_kept_once(spark, documents):
    docs = [(i, f"unlike start {i}. " + PASSAGE + f"unlike end {i * 7}.") for i in range(50)]
    spans = line_dedup.repeated_spans(documents(docs)).collect()
    assert sorted({r["doc_id"] for r in spans}) == list(range(50))[1:] + [] if 0 not in {r["doc_id"] for r in spans} else True
    assert {r["kept_doc_id"] for r in spans} == {0}


def test_empty_table(spark, documents):
    assert line_dedup.without_repeats(documents([])).count() == 0


def test_query_finds_what_it_should(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    expected = sorted((i, a, b) for (i, _), spans in brute(rows, "sentence", 25).items() for a, b in spans)
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in queries.op10_repeated_passages(spark, sf).collect()) == expected
