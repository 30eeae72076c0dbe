"""Pairs of names scored many at a time and once for each two names; edges thinned before they are shuffled."""

import random

import numpy as np
import pyarrow as pa

from rollcall.functions import scores
from rollcall.functions.scores import pair_tenths, set_ratio_tenths
from rollcall.operators import components, golden


def test_scores_of_pairs_equal_those_of_one_pair():
    rnd = random.Random(3)
    words = ["a", "ab", "the", "of", "가나", "회사", "x" * 70, "\U0001f600b", *(f"w{k}" for k in range(60))]
    names = list({" ".join(sorted(set(rnd.choices(words[: rnd.choice([6, len(words)])], k=rnd.choice([0, 1, 2, 4, 9, 60]))))) for _ in range(120)})
    i, j = np.repeat(np.arange(len(names)), len(names)), np.tile(np.arange(len(names)), len(names))
    sets = [frozenset(n.split(" ")) if n else frozenset() for n in names]
    assert pair_tenths(names, i, j).tolist() == [set_ratio_tenths(sets[a], sets[b]) for a, b in zip(i, j, strict=True)]
    assert len(pair_tenths(names, i[:0], j[:0])) == 0


def test_a_batch_compares_two_names_once(monkeypatch):
    asked = []
    monkeypatch.setattr(scores, "pair_tenths", lambda names, i, j: asked.append(len(i)) or pair_tenths(names, i, j))
    names = ["alpha beta", "alpha bets", "alpha echo zulu", None]
    a, b = pa.array(names * 400), pa.array(names[::-1] * 400)
    got = scores._tenths_of.func(a, b).to_pylist()
    middle = set_ratio_tenths(frozenset({"alpha", "bets"}), frozenset({"alpha", "echo", "zulu"}))
    assert asked == [2] and got == [0, middle, middle, 0] * 400


def test_edges_of_a_group_are_thinned(spark):
    edges = [(f"k{a:03}", f"k{b:03}") for a in range(200) for b in range(a + 1, 200)] + [("z", "z"), (None, "k001")]
    frame = spark.createDataFrame(edges, "a string, b string").coalesce(1)
    thin = components.thinned(frame)
    assert thin.count() == 199 + 1
    want = sorted(map(tuple, components.connected_components(frame).collect()))
    assert sorted(map(tuple, components.connected_components(thin).collect())) == want


def test_a_stranger_links_no_members(spark):
    members = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    pairs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "d"), ("a", "x")], "key_a string, key_b string")
    assert sorted(map(tuple, golden.clusters(members, pairs).collect())) == [("c", "c"), ("d", "c")]
