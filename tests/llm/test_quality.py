"""Counts against plain Python, the binomial tail against exact fractions, and the guarantee on a made-up holdout."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from rollcall.llm.quality import _binomial_tail, judge, learn_cutoffs, text_statistics

random.seed(7)
BREAK = re.compile(r"[\x20\x09-\x0D]+")


def _expected(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = [w for w in BREAK.split(text) if w]
    lines = [x for x in text.split("\n") if BREAK.sub("", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def _texts() -> list[str | None]:
    words = ["a", "b", "cc", "d#", "é", "x|y", "\x0b", " "]
    out: list[str | None] = [None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "a a a a a a", "\na\n\na\n a\n", "x" * 100_000]
    for _ in range(60):
        out.append("".join(random.choice(words) + random.choice([" ", " ", "\n", "\t "]) for _ in range(random.randint(0, 80))))
    return out


def test_counts(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in text_statistics(df).collect()}
    assert got == {k: _expected(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("p", [0.005, 0.02])
def test_binomial_tail(spark, p):
    cases = [(1, 0), (100, 0), (1000, 3), (5000, 20), (300, 299)]
    df = spark.createDataFrame(cases, "_n long, _k long")
    q = Fraction(p)
    for n, k, got in df.select("_n", "_k", _binomial_tail(F.col("_n"), F.col("_k"), p)).collect():
        exact = float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))) if k <= n * p else 1.0
        assert got == pytest.approx(exact, rel=1e-9)


def test_cutoffs_hold_their_share(spark):
    rows, labels = [], []
    for k in range(6000):
        good = k % 4 != 0
        noise = 1 if good else 12
        rows.append((k, " ".join(random.choice(["word", "text", "line"]) + str(random.random())[2:6] for _ in range(30)) + " #" * random.randint(0, noise), "en"))
        labels.append((k, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    stats = text_statistics(docs.withColumnRenamed("lang", "stratum"), keep=("doc_id", "stratum"))
    cut = {r.rule: r.cutoff for r in learn_cutoffs(stats, marks).collect()}
    assert "symbols" in cut
    kept = judge(docs, marks).join(marks, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r.quality: r.k for r in kept}
    assert kept[1] > 0.98 and kept[0] < 0.6


def test_without_labels_only_the_base_rules(spark):
    docs = spark.createDataFrame([(1, "one two", None), (2, " ".join(map(str, range(50))), "xx"), (3, None, "en"), (3, None, "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in judge(docs, none).collect()) == [(1, True, False), (2, False, True), (3, True, False), (3, True, False)]
    assert judge(docs.where("false"), none).collect() == []
