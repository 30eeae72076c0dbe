"""Folding and matching on single texts; learning and held-out accuracy on a made-up corpus."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rollcall.llm.toxicity import ToxicityModel, _Matcher, fold, held_out, learn, score_toxicity

random.seed(4)
PLAIN = ["table", "river", "cloud", "walk", "green", "seven", "house", "bread", "paper", "stone", "train", "music"]


def test_fold_undoes_disguises():
    assert fold("1D10T") == " idiot "
    assert fold("i.d.i.o.t!") == " idiot "
    assert fold("ідіоt") == fold("idiot")
    assert fold("ｍｏｒｏｎ") == " moron "
    assert fold("mo​ron") == " moron "
    assert fold("in 2024, 15%") == " in 2024 15 "
    assert fold("") == "  "


def test_exceptions_excuse_and_length_normalises():
    model = ToxicityModel({" clown ": 5.0}, ["clown fish"], [2.0, 1.0, 1.0, -4.0])
    m = _Matcher(model)
    assert m.score("a clown fish") == m.score("a cloud fish")
    assert m.score("you clown") > 0.5 > m.score("clown " + "word " * 3000)


def _corpus(spark):
    rows, labels = [], []
    for k in range(900):
        toxic = int(k % 5 == 0)
        words = [random.choice(PLAIN) for _ in range(random.randint(5, 60))]
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(["idiot", "m0ron", "scum,", "SCUM", "idi0t"]))
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    rows += [(2000, None), (2001, ""), (2002, "idiot " * 50_000)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _corpus(spark)
    model = learn(docs, labels.where(~held_out()))
    assert {e.strip() for e in model.entries} >= {"idiot", "moron", "scum"}
    scored = score_toxicity(docs.withColumn("score", F.lit("old")), model)
    rows = {r.doc_id: r.score for r in scored.collect()}
    assert len(rows) == 903 and all(0 <= s <= 1 for s in rows.values())
    truth = {r.doc_id: r.toxic for r in labels.where(held_out()).collect()}
    right = sum((rows[d] >= 0.5) == bool(t) for d, t in truth.items())
    assert right / len(truth) > 0.97
    assert rows[2000] == rows[2001] < 0.5 < rows[2002]


def test_nothing_to_learn_from(spark):
    docs, labels = _corpus(spark)
    model = learn(docs, labels.where("false"))
    assert not model.entries
    assert score_toxicity(docs.limit(3), model).where("score >= 0.5").count() == 0
    nulls = spark.createDataFrame([(1, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    assert not learn(docs, nulls).entries
    assert score_toxicity(docs.where("false"), model).collect() == []


def test_a_bound_sample_keeps_the_true_rate(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(3000):
        toxic = int(k % 10 == 0)
        words = [rng.choice(PLAIN) for _ in range(20)]
        if toxic or rng.random() < 0.2:
            words.insert(rng.randrange(20), "idiot")
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for most in (12_000, 400):  # unbound, and half of the sample toxic
        scored = score_toxicity(docs, learn(docs, labels, max_texts=most))
        mean, top = scored.agg(F.avg("score"), F.max("score")).first()
        assert abs(mean - 0.1) < 0.03 and top < 0.5


def test_long_words_are_folded_and_learned():
    assert fold("1d1ot" + "x" * 60) == " idiot" + "x" * 60 + " "
    assert fold("a" * 5000 + "1" + "b" * 5000) == " " + "a" * 5000 + "i" + "b" * 5000 + " "


def _slow_features(model: ToxicityModel, text: str) -> list[float]:
    """The same by plain searches for each entry and phrase."""
    folded = fold(text)
    places = [(k, k + len(p) - 1, p, w) for p, w in model.entries.items() for k in range(len(folded)) if folded.startswith(p, k)]
    excused = [(k, k + len(fold(p)) - 1) for p in model.exceptions for k in range(len(folded)) if folded.startswith(fold(p), k)]
    left = [x for x in places if not any(a <= x[0] and x[1] <= b for a, b in excused)]
    total = sum(max(w for k, _, _, w in left if k == at) for at in {x[0] for x in left})
    words = max(1, len(folded.split()))
    return [total / math.sqrt(words), math.log1p(sum({p: w for _, _, p, w in left}.values())), math.log1p(100.0 * total / words), 1.0]


def test_the_automaton_finds_what_plain_searches_find():
    rng = random.Random(12)
    entries = {" idiot ": 3.0, " idio": 1.5, " scum": 2.0, " moron ": 4.0, " clown ": 2.5, " a b ": 1.0}
    model = ToxicityModel(entries, ["clown fish", "idiot proof", "the moron"], [0.5, 1.0, 0.2, -2.0])
    words = ["idiot", "1d1ot", "idiotic", "scum", "5cum!", "moron", "m.o.r.o.n", "clown", "fish", "proof", "the", "a", "b", "table", "ідіоt", ""]
    for _ in range(500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        assert np.allclose(_Matcher(model).features(text), _slow_features(model, text)), text


def test_many_matches_and_exceptions_take_one_sweep():
    import time

    from rollcall.llm.toxicity import ToxicityModel, _Matcher

    model = ToxicityModel(entries={" idiot": 2.0, " proof ": 1.0, " scum ": 3.0}, exceptions=["idiot proof", "scum of the earth"])
    matcher = _Matcher(model)
    assert matcher.features("an idiot proof design")[:2] == [0.0, 0.0]
    assert matcher.features("idiot proof idiot scum of the")[1] > 0
    began = time.time()
    assert matcher.features("idiot proof " * 80_000)[:2] == [0.0, 0.0] and time.time() - began < 20
