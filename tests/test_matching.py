"""Matching, clusters, golden records and merges on literal rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rollcall.operators import golden, greedy, matching
from rollcall.operators.components import connected_components

RECORDS = "key string, name string, country string, domain string, reg_no string"


def _tiers(spark, rows, **k) -> dict:
    df = spark.createDataFrame(rows, RECORDS)
    return {(r.key_a, r.key_b): r.tier for r in matching.duplicate_candidates(df, **k).collect()}


def test_every_tier(spark):
    rows = [
        ("a1", "Acme Corporation", "KR", "https://acme.com", None), ("a2", "Acme, Inc.", "KR", "http://www.acme.com/ir", None), ("a3", "Zeta", "KR", "acme.com", None),
        ("a4", "Acme", "KR", None, None), ("a5", "Acme", "KR", "acme.co.kr", None), ("d1", "Hanwha abcdef", "KR", None, None), ("d2", "Hanwha abcdxy", "KR", "hanwha.com", None),
        ("b1", "One", "KR", None, "124-81-00998"), ("b2", "Two", "KR", None, "1248100998"), ("b3", "One", "US", None, "1248100998"),
        ("c1", "Same Name", "KR", "same.com", "1"), ("c2", "Same Name", "KR", "same.com", "2"),
    ]
    got = _tiers(spark, rows)
    assert got[("a1", "a2")] == "auto" and got[("a1", "a3")] == "domain" and got[("a1", "a4")] == "lexical"
    assert got[("a1", "a5")] == "keep_both" and got[("d1", "d2")] == "shortlist"
    assert got[("b1", "b2")] == "reg_no" and ("b1", "b3") not in got
    assert got[("c1", "c2")] == "keep_both"
    random.shuffle(rows)
    assert _tiers(spark, rows) == got


def test_block_cap(spark):
    rows = [(f"k{n}", f"Name{n} X", "KR", "shared.com", None) for n in range(5)]
    df = spark.createDataFrame(rows, RECORDS)
    assert [(r.kind, r.size) for r in matching.skipped_blocks(df, 3).collect() if r.kind == "dom"] == [("dom", 5)]
    assert len(_tiers(spark, rows)) == 10
    assert _tiers(spark, rows, max_block=3) == {}


def test_components_equal_union_find(spark):
    random.seed(3)
    for n, m in ((2, 1), (40, 25), (60, 90)):
        edges = [(random.randrange(n), random.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1064)]
        root = {x: x for e in edges for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            p, q = sorted((find(a), find(b)))
            root[q] = p
        df = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
        got = {r.node: r.component for r in connected_components(df).collect()}
        assert got == {x: find(x) for x in root}
    assert connected_components(df.where("false")).collect() == []


def test_golden_and_merge(spark):
    members = spark.createDataFrame(
        [("k1", "Acme", "KR", "acme.com", None, None), ("k2", "Acme Trading Co", "KR", None, "dart", "1"), ("k3", "아크메 무역", "KR", "acme.kr", None, None), ("k4", "Else", "KR", None, None, None)],
        "key string, name string, country string, domain string, registry string, registry_id string",
    )
    pairs = spark.createDataFrame([("k1", "k2"), ("k2", "k3"), ("k4", "gone")], "key_a string, key_b string")
    gold = golden.golden_records(members, pairs)
    row = gold.first()
    assert gold.count() == 1
    assert (row.survivor_key, row.canonical_name, row.canonical_domain, row.absorbed_keys) == ("k2", "Acme Trading Co", "acme.com", ["k1", "k3"])
    ledger = spark.createDataFrame(
        [("k1", "acme.com", None, None), ("k2", None, None, None), ("k3", "acme.kr", None, None), ("k9", None, "k1", "auto"), ("k4", None, None, None)],
        "key string, domain string, duplicate_of string, merge_reason string",
    ).withColumns({"merged_by": F.lit(None).cast("string"), "merged_at": F.lit(None).cast("timestamp")})
    at = F.lit("2024-01-01").cast("timestamp")
    once = golden.apply_golden(ledger, gold, "auto", at)
    got = {r.key: (r.duplicate_of, r.merge_reason, r.domain) for r in once.collect()}
    assert got == {"k1": ("k2", "auto", "acme.com"), "k2": (None, None, "acme.com"), "k3": ("k2", "auto", "acme.kr"), "k9": ("k2", "auto (rechained)", None), "k4": (None, None, None)}
    twice = golden.apply_golden(once, gold, "auto", at)
    assert {r.key: (r.duplicate_of, r.merge_reason, r.domain) for r in twice.collect()} == got


def test_refused_survivor(spark):
    ledger = spark.createDataFrame([("s", None, "root", "auto", None, None), ("x", None, None, None, None, None), ("root", None, None, None, None, None)], "key string, domain string, duplicate_of string, merge_reason string, merged_by string, merged_at timestamp")
    gold = spark.createDataFrame([("s", "S", None, ["x"])], "survivor_key string, canonical_name string, canonical_domain string, absorbed_keys array<string>")
    after = {r.key: r.duplicate_of for r in golden.apply_golden(ledger, gold, "auto", F.lit(None).cast("timestamp")).collect()}
    assert after == {"s": "root", "x": None, "root": None}


def test_greedy_equals_sequential(spark):
    random.seed(5)
    for _ in range(4):
        rows = [(n, random.choice([None, *"abcdefgh"]), random.choice([None, *"uvwxyz"])) for n in range(60)]
        seen_k, seen_d, want = set(), set(), []
        for n, k, d in rows:
            if (k is not None and k in seen_k) or (d is not None and d in seen_d):
                continue
            want.append(n)
            seen_k.add(k)
            seen_d.add(d)
        df = spark.createDataFrame(rows, "seq int, key string, domain string")
        assert sorted(r.seq for r in greedy.greedy_distinct(df, "seq").collect()) == want
