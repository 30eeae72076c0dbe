"""Scores against a direct computation in double precision."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollcall.llm import lm_score
from rollcall.llm.lm_score import PRIOR, cross_entropy_difference, tokens

random.seed(3)
WORDS = ["the", "cat", "sat", "on", "mat", "Dog", "rivers", "Ünïcode", "мир", "война", "日本", "語", "12", "!", "%"]
ROWS = [
    (1, "the cat sat on the mat, the cat sat."), (2, "The dog 12 barks; Ünïcode 日本!"), (3, ""), (4, None), (5, " \n\t "), (6, "the mat sat on the cat"),
    (6, "the mat sat on the cat"), (6, "another text of six"), (7, "a" * 70_000), (8, "мир и война, мир и мир"), (None, "the dog sat"), (None, "the dog sat"),
    *((k, " ".join(random.choice(WORDS) for _ in range(random.randint(1, 40)))) for k in range(10, 60)),
]
TARGET = [1, 6, 8, 8, None, 999, *range(10, 25)]


def _tokens(text: str | None) -> list[str]:
    return re.findall("[0-9A-Za-z\u0080-⿿]+|[　-\U0010ffff]|[!-/:-@\\[-`{-~]", (text or "").lower())


def test_tokens():
    texts = [t for _, t in ROWS] + ["x_y 한국어,ok", "😀 a😀b", "Ωmega—x"]
    h, begin = tokens(texts)
    flat = [w for t in texts for w in _tokens(t)]
    assert [len(_tokens(t)) for t in texts] == [b - a for a, b in zip(begin, begin[1:], strict=False)]
    assert len({(w, int(x)) for w, x in zip(flat, h, strict=True)}) == len(set(flat)) == len(set(h.tolist()))
    assert tokens([]) [0].tolist() == [] and tokens([None, ""])[1].tolist() == [0, 0, 0]


def _direct(rows, target_ids, vocabulary: set[str]):
    """For each row (target loss, background loss) per token."""
    listed = [(t, d is not None and d in target_ids) for d, t in rows]
    word, pair, n, n_texts = (Counter(), Counter()), (Counter(), Counter()), [0, 0], [0, 0]
    seqs = []
    for text, wanted in listed:
        seq = [w if w in vocabulary else "<unknown>" for w in _tokens(text)]
        seqs.append(seq)
        for m in (0, 1) if wanted else (0,):
            word[m].update(seq)
            pair[m].update(zip(["<start>", *seq], seq, strict=False))
            n[m] += len(seq)
            n_texts[m] += 1
    for m in (0, 1):
        word[m]["<start>"] = n_texts[m]
    worth = (n[1] / n[0] if n[0] and n[1] else 1.0, 1.0)
    out = []
    for (_, wanted), seq in zip(listed, seqs, strict=True):
        losses = []
        for m in (1, 0):
            total = 0.0
            for (a, b), own in Counter(zip(["<start>", *seq], seq, strict=False)).items():
                less = own if m == 0 or wanted else 0
                left = lambda c, less=less, m=m: max(c - less, 0) * worth[m]
                p1 = (left(word[m][b]) + 1) / (left(n[m]) + len(vocabulary) + 1)
                total -= own * math.log((left(pair[m][a, b]) + PRIOR * p1) / (left(word[m][a]) + PRIOR))
            losses.append(total / len(seq) if seq else None)
        out.append((len(seq), *losses))
    return out


@pytest.mark.parametrize("sample", [1, 64])
def test_equals_direct_computation(spark, monkeypatch, sample):
    monkeypatch.setattr(lm_score, "SAMPLE", sample)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("target", F.lit("x")).withColumn("_id", F.lit(1))
    ids = spark.createDataFrame([(x,) for x in TARGET], "doc_id long")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.target_loss or 0, r.background_loss or 0, r.score or 0) for r in cross_entropy_difference(df, ids).collect()))
    vocabulary = {w for _, t in ROWS for w in _tokens(t)}
    expected = sorted((d is None, d or 0, n, a or 0, b or 0, a - b if n else 0) for (d, _), (n, a, b) in zip(ROWS, _direct(ROWS, set(TARGET), vocabulary), strict=True))
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[3:] == pytest.approx(e[3:], abs=1e-9)


def test_words_beyond_the_vocabulary_are_unknown(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SAMPLE", 2)
    monkeypatch.setattr(lm_score, "MOST_WORDS", 10)
    rows = [r for r in ROWS if r[0] is not None]
    df, ids = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(x,) for x in TARGET], "doc_id long")
    flagged = lm_score._flagged(df, ids, "doc_id", "text")
    models = lm_score.fit(flagged)
    number = {w: int(models.numbers(tokens([w])[0])[0]) for _, t in rows for w in _tokens(t)}
    vocabulary = {w for w, k in number.items() if k}
    assert 0 < len(vocabulary) <= 10 and min(Counter(w for _, t in rows for w in _tokens(t))[v] for v in vocabulary) > 1
    got = sorted((r.doc_id, r.n_tokens, r.target_loss or 0, r.background_loss or 0) for r in cross_entropy_difference(df, ids).collect())
    expected = sorted((d, n, a or 0, b or 0) for (d, _), (n, a, b) in zip(rows, _direct(rows, set(TARGET), vocabulary), strict=True))
    for g, e in zip(got, expected, strict=True):
        assert g == pytest.approx(e, abs=1e-9)


def test_scripts_without_spaces_and_copies_are_told_apart(spark):
    first, second = "猫が好きです。犬も好きです。" * 3, "経済成長率は低下した。" * 3
    rows = [(1, first), (2, first[7:]), (3, second), (4, second[11:]), (5, "мир труд май " * 5), (6, "май мир " * 5), (7, "война огонь " * 5), (8, "война дым " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in cross_entropy_difference(df, spark.createDataFrame([(1,), (5,)], "doc_id long")).collect()}
    assert got[2] < got[4] and got[6] < got[8]
    copies = df.union(spark.createDataFrame([(9, rows[4][1])], "doc_id long, text string"))
    loss = {r.doc_id: r.background_loss for r in cross_entropy_difference(copies, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert loss[5] == loss[9] < loss[7]


def test_empty_corpus_and_no_target(spark):
    df = spark.createDataFrame(ROWS[:6], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert cross_entropy_difference(df.where("false"), none).collect() == []
    assert len(cross_entropy_difference(df, none).collect()) == 6
