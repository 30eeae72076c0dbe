"""Source divergences against a plain computation with Python's whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from rollcall.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    """rows (lang, source, text) -> the audit's rows."""
    groups, docs = {}, {}
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        docs.setdefault(lang or "", Counter()).update(set(terms))
    out = []
    for lang, used in docs.items():
        kept = [t for t, n in used.items() if n >= least]
        mine = {s: c for (x, s), c in groups.items() if x == lang}
        total = {s: sum(c[t] for t in kept) for s, c in mine.items()}
        share = {s: {t: 1 + 10**9 * (c[t] + 1) // (total[s] + len(kept)) for t in kept} for s, c in mine.items()}
        whole = sum(total.values()) + len(kept)
        q = {t: 1 + 10**9 * (sum(c[t] for c in mine.values()) + 1) // whole for t in kept}
        for s in mine:
            pairs = [(o, sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept)) for o in mine if o != s]
            terms = [(t, (share[s][t] - q[t]) ** 2 // q[t]) for t in kept if mine[s][t] and share[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, r + 1) for r, (t, v) in enumerate(items if part == "pair" else items[:top])]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Éa", "éa", "數據", "ABC", "naïve", "x y", "🙂"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot"] * 6 + [f"s{i}" for i in range(9)] + [None])
        low = rng.randint(0, 250)
        text = "".join(rng.choice(words[low : low + 60] + words[-7:]) + rng.choice([" ", "\n", "1", "_", "-", "\x00"]) for _ in range(rng.randint(0, 60)))
        rows.append((lang, source, rng.choice([text, text, text, None, ""])))
    return rows + [("lone", "a", "once only"), ("lone", "b", None), ("single", "s", "x x x")]


@pytest.mark.parametrize("cells,group_block", [(1 << 20, 256), (120, 256), (60, 3)])
def test_equals_a_plain_computation(spark, cells, group_block):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    got = divergence.audit_sources(docs, top=20, cells=cells, group_block=group_block)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, top=20)


def test_ties_keep_the_least_terms(spark):
    """Equal values at the end of a heap: terms by their bytes."""
    rows = [("en", "a", " ".join(f"t{chr(97 + i)}" for i in range(26)))] * 3 + [("en", "b", "other words here")] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for cells in (1 << 20, 8):
        got = divergence.audit_sources(docs, top=5, cells=cells)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, top=5)


def test_shares_and_divergences_are_exact_at_large_counts():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.choice([1, 2, 10**6, 10**12, 8 * 10**15])
        count = rng.randint(0, total - 1) if total > 1 else 0
        assert divergence.shares(np.array([[count]]), np.array([[total]]))[0, 0] == 1 + 10**9 * (count + 1) // total
        p, q = rng.randint(1, 10**9 + 1), rng.choice([1, 2, rng.randint(1, 10**9 + 1)])
        assert divergence.divergence(np.array([p]), np.array([q]))[0] == (p - q) ** 2 // q


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 10)
    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice(["abc", "É", " ", "1", "Zz", "數"]) for _ in range(60))
        assert [t.decode() for s in divergence.terms_of(text.encode()) for t in s] == TERM.findall(text.translate(LOWER))
    assert [t for s in divergence.terms_of(b"x" * 100) for t in s] == [b"x" * 100] and list(divergence.terms_of(b"")) == []


def test_empty_tables_repeats_and_extra_columns(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string, n long, term string")
    assert divergence.audit_sources(empty).count() == 0
    rows = [("en", "a", "same words"), ("en", "b", "no")] * 3
    docs = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "lang string, source string, text string, n long, term string, gid int")
    assert sorted(tuple(r) for r in divergence.audit_sources(docs).collect()) == plain(rows)
