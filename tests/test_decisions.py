"""Many merge decisions at once against one after another."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rollcall.operators import decisions

LEDGER = "key string, name string, domain string, registry string, registry_id string, duplicate_of string, merge_reason string, merged_by string, merged_at timestamp, canonical_name string"
PAIRS = "id string, key_a string, key_b string, tier string, status string, survivor_key string, decided_by string, decided_at timestamp"


def _replay(pairs, ledger, taken):
    """A loop over the decisions; names are one word each, so that only registry, domain and key rank them."""
    pairs, ledger = {p[0]: dict(zip(PAIRS.replace(",", "").split()[::2], p, strict=True)) for p in pairs}, {r[0]: dict(zip(LEDGER.replace(",", "").split()[::2], r, strict=True)) for r in ledger}
    accepted = []
    for seq, name, by in sorted(taken):
        p = pairs.get(name)
        if p is None or p["status"] != "pending":
            continue
        rows = [ledger.get(p["key_a"]), ledger.get(p["key_b"])]
        if None in rows or any(r["duplicate_of"] for r in rows) or rows[0] is rows[1]:
            continue
        registered = lambda r: not (r["registry"] and r["registry_id"])
        winner, loser = sorted(rows, key=lambda r: (registered(r), not r["domain"], r["key"]))
        label = min(rows, key=lambda r: (registered(r), r["name"].isascii(), r["key"]))
        domains = sorted((registered(r), r["key"], r["domain"]) for r in rows if r["domain"])
        winner["canonical_name"] = label["name"]
        if not winner["domain"] and domains:
            winner["domain"] = domains[0][2]
        why = f"워크벤치 사람확정({p['tier']})"
        for r in ledger.values():
            if r["duplicate_of"] == loser["key"]:
                r |= {"duplicate_of": winner["key"], "merge_reason": why + " (rechained)", "merged_by": by}
        loser |= {"duplicate_of": winner["key"], "merge_reason": why, "merged_by": by}
        p |= {"status": "merged", "survivor_key": winner["key"], "decided_by": by}
        accepted.append(seq)
    return accepted, pairs, ledger


def test_decisions_at_once_equal_one_after_another(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    for seed in range(3):
        rng = random.Random(seed)
        keys = [f"k{n:02}" for n in range(24)]
        ledger = [(k, rng.choice(["Acme", "Beta", "아크메"]), rng.choice([None, "", f"{k}.com", f"{k}.com"]), rng.choice([None, None, "dart"]), "1", None, None, None, None, None) for k in keys]
        ledger += [(f"old{n}", "Old", None, None, None, rng.choice(keys), "auto", "x", None, "kept") for n in range(6)]
        pairs = [(f"c{n}", *rng.sample([*keys, "gone", "old1"], 2), rng.choice(["auto", "domain"]), rng.choice(["pending"] * 5 + ["separated"]), None, None, None) for n in range(40)]
        pairs.append(("same", "k01", "k01", "auto", "pending", None, None, None))
        taken = [(n, rng.choice([p[0] for p in pairs] + ["unknown"]), rng.choice("uv")) for n in rng.sample(range(1000), 45)]
        book, bench = spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(pairs, PAIRS)
        settled = decisions.settle_merges(bench, book, spark.createDataFrame(taken, "seq int, id string, decided_by string"))
        accepted, want_pairs, want_ledger = _replay(pairs, ledger, taken)
        assert sorted(r.seq for r in settled.where("accepted").collect()) == sorted(accepted) and settled.count() == len(taken)
        after, merged = decisions.apply_merges(bench, book, settled, at)
        got = {r.id: (r.status, r.survivor_key, r.decided_by) for r in after.collect()}
        assert got == {k: (p["status"], p["survivor_key"], p["decided_by"]) for k, p in want_pairs.items()}
        names = ("duplicate_of", "merge_reason", "merged_by", "canonical_name", "domain")
        rows = merged.collect()
        assert {r.key: tuple(r[n] for n in names) for r in rows} == {k: tuple(r[n] for n in names) for k, r in want_ledger.items()}
        again = decisions.settle_merges(after, merged, spark.createDataFrame(taken, "seq int, id string, decided_by string"))
        assert again.where("accepted").count() == 0


def test_no_decisions(spark):
    book, bench = spark.createDataFrame([], LEDGER), spark.createDataFrame([], PAIRS)
    settled = decisions.settle_merges(bench, book, spark.createDataFrame([(1, "x", "u")], "seq int, id string, decided_by string"))
    assert [(r.seq, r.accepted, r.survivor) for r in settled.collect()] == [(1, False, None)]
    after, merged = decisions.apply_merges(bench, book, settled, F.lit(None).cast("timestamp"))
    assert after.count() == merged.count() == 0
