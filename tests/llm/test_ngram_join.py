"""The Jaccard join against all pairs of a small corpus with copies, near copies and shared passages."""

from __future__ import annotations

import random

import pytest

from rollcall.llm.ngram_join import jaccard_components, keep_one_per_component

random.seed(6)
WORDS = [a + b for a in "bcdfghklmnprst" for b in ("a", "e", "io", "u", "an", "er")]


def _text(n: int) -> list[str]:
    return [random.choice(WORDS) for _ in range(n)]


def _corpus() -> list[tuple[int, str | None]]:
    passage = _text(60)
    rows: list[list[str]] = []
    for _ in range(30):
        rows.append(_text(random.randint(1, 150)))
    for _ in range(12):
        rows.append(passage + _text(random.randint(0, 60)))
    hub = _text(100)
    for _ in range(70):  # many near copies of one text
        w = list(hub)
        w[random.randrange(100)] = random.choice(WORDS)
        rows.append(w)
    chain = _text(90)
    for _ in range(8):  # each near the one before
        chain = chain[4:] + _text(4)
        rows.append(chain)
    rows += [rows[3], rows[40], rows[50], ["One"], ["one"], _text(3)]
    out: list[tuple[int, str | None]] = [(k * 3, " ".join(w).title() if k % 7 == 0 else "\n".join(w)) for k, w in enumerate(rows)]
    random.shuffle(out)
    return [*out, (10_000, None), (10_001, ""), (10_002, " \t\n")]


def _shingles(text: str | None, width: int) -> frozenset:
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_equals_all_pairs(spark, width, percent):
    rows = _corpus()
    sets = {d: _shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, width, percent).collect()}
    assert got == {d: (len(sets[d]), find(d)) for d in ids}
    assert len({find(d) for d in ids}) < len(ids) - 60


def test_keeps_one_of_each(spark):
    df = spark.createDataFrame([(2, "a b c d e f", 1), (1, "A b c d e f", 2), (3, None, 3), (3, None, 3), (4, "", 4)], "doc_id long, text string, n int")
    assert sorted(tuple(r) for r in keep_one_per_component(df).select("doc_id", "n").collect()) == [(1, 2), (3, 3), (4, 4)]
    assert keep_one_per_component(df.where("false")).collect() == []
