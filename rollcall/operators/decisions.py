"""Many decisions to merge at once, with the result of taking them one after another.

A decision takes a pending candidate's two companies for the same. It is refused where one of them is gone from the
ledger or is a duplicate already, which an earlier decision may have made it; so decisions that share a company
depend on one another, and others do not. Rounds settle side by side every decision that is the first
undecided one of both its companies; what each company is by then, a root or not and with or without a domain, is a
small table that the rounds carry on. Rounds follow the longest chain of decisions that share companies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import identity
from rollcall.operators.golden import has_registry
from rollcall.session import materialise, release


def settle_merges(candidates: DataFrame, ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """seq, id, accepted, survivor, loser, canonical_name, domain (the survivor's after the merge), decided_by, tier: every decision.

    candidates: id, key_a, key_b, tier, status. ledger: key, name, domain, registry, registry_id, duplicate_of.
    decisions: seq (unique, the order in which they are taken), id, decided_by. A refused decision has nulls
    for what it would have done, and so has one on an unknown candidate; of several decisions on a candidate the first that is
    accepted counts.
    """
    asked = decisions.join(candidates.select("id", "key_a", "key_b", "tier", "status"), "id", "left")
    asked = materialise(asked.select("seq", "id", "decided_by", "key_a", "key_b", "tier", "status"), "asked")
    keys = asked.select(F.col("key_a").alias("key")).union(asked.select("key_b")).distinct()
    state = ledger.where("duplicate_of is null").join(keys, "key", "left_semi").select(
        "key", F.trim("name").alias("name"), F.col("domain").alias("domain"), (~has_registry()).cast("int").alias("no_reg"),
        (-F.size(identity.name_tokens(F.col("name")))).alias("fewer"), (~F.col("name").rlike("[^\\x00-\\x7F]")).cast("int").alias("plain"),
    )
    state = materialise(state, "roots")
    left = materialise(_open(asked.where("status = 'pending' and key_a <> key_b"), state), "open")
    done: DataFrame | None = None
    while not left.isEmpty():
        first = left.select(F.explode(F.array("key_a", "key_b")).alias("key"), "seq").groupBy("key").agg(F.min("seq").alias("first"))
        both = left.join(first.toDF("key_a", "_a"), "key_a").join(first.toDF("key_b", "_b"), "key_b").where("seq = _a and seq = _b")
        side = lambda s: state.select(F.col("key").alias(f"key_{s}"), F.struct(*state.columns).alias(s))
        settled = both.join(side("a"), "key_a").join(side("b"), "key_b").select("seq", "id", "decided_by", "tier", *_merged())
        settled = materialise(settled, "settled")
        done = settled if done is None else done.unionByName(settled)
        filled = settled.select(F.col("survivor").alias("key"), F.col("domain").alias("_domain"))
        new = state.join(settled.select(F.col("loser").alias("key")), "key", "left_anti").join(filled, "key", "left")
        new = materialise(new.select(*(F.coalesce("_domain", "domain").alias("domain") if c == "domain" else F.col(c) for c in state.columns)), "roots")
        rest = left.join(settled.select("seq"), "seq", "left_anti").join(settled.select("id"), "id", "left_anti")
        rest = materialise(_open(rest, new), "open")
        release(left)
        release(state)
        left, state = rest, new
    names = ("survivor", "loser", "canonical_name", "domain")
    if done is None:
        return asked.select("seq", "id", F.lit(False).alias("accepted"), *(F.lit(None).cast("string").alias(c) for c in names), "decided_by", "tier")
    return asked.join(done.select("seq", *names), "seq", "left").select("seq", "id", F.col("survivor").isNotNull().alias("accepted"), *names, "decided_by", "tier")


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The decisions both of whose companies are still roots: once one is not, it never is again."""
    for s in ("key_a", "key_b"):
        rows = rows.join(roots.select(F.col("key").alias(s)), s, "left_semi")
    return rows.select("seq", "id", "decided_by", "key_a", "key_b", "tier")


def _merged() -> list[Column]:
    """survivor, loser, canonical_name, domain of the structs a and b, by the rules of golden records."""
    dom = {s: identity.registered_domain(F.col(f"{s}.domain")) for s in "ab"}
    rank = {s: F.struct(F.col(f"{s}.no_reg"), dom[s].isNull().cast("int"), F.col(f"{s}.fewer"), F.col(f"{s}.key")) for s in "ab"}
    label = {s: F.struct(F.col(f"{s}.no_reg"), F.col(f"{s}.fewer"), F.col(f"{s}.plain"), F.col(f"{s}.key")) for s in "ab"}
    trust = {s: F.struct(F.col(f"{s}.no_reg"), F.col(f"{s}.key")) for s in "ab"}
    a_first = rank["a"] < rank["b"]
    best = F.when(dom["a"].isNull(), dom["b"]).when(dom["b"].isNull(), dom["a"]).otherwise(F.when(trust["a"] < trust["b"], dom["a"]).otherwise(dom["b"]))
    own = F.when(a_first, F.col("a.domain")).otherwise(F.col("b.domain"))
    return [
        F.when(a_first, F.col("a.key")).otherwise(F.col("b.key")).alias("survivor"), F.when(a_first, F.col("b.key")).otherwise(F.col("a.key")).alias("loser"),
        F.when(label["a"] < label["b"], F.col("a.name")).otherwise(F.col("b.name")).alias("canonical_name"), F.when(F.coalesce(own, F.lit("")) == "", F.coalesce(best, own)).otherwise(own).alias("domain"),
    ]


def _tops(edges: DataFrame) -> DataFrame:
    """key, into, seq, decided_by, why, hops: for each absorbed company the root it ends at and the last decision on its way there.

    A company is absorbed at most once, and its survivor only later, so the last step to the root is the last decision that moved
    it. Steps are doubled until no way gets longer.
    """
    now = materialise(edges.select(F.col("loser").alias("key"), F.col("survivor").alias("into"), "seq", "decided_by", "why", F.lit(1).alias("hops")), "ways")
    while True:
        further = now.select(F.col("key").alias("into"), F.struct("into", "seq", "decided_by", "why", "hops").alias("n"))
        joined = now.join(further, "into", "left")
        pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(c)).alias(c)
        hops = (F.col("hops") + F.coalesce("n.hops", F.lit(0))).alias("hops")
        new = materialise(joined.select("key", pick("into"), pick("seq"), pick("decided_by"), pick("why"), hops), "ways")
        longer = new.join(now.select("key", F.col("hops").alias("_h")), "key").where("hops > _h").isEmpty()
        release(now)
        now = new
        if longer:
            return now


def apply_merges(candidates: DataFrame, ledger: DataFrame, settled: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, ledger) after the decisions of settle_merges.

    Accepted candidates are merged, with survivor, decider and time. Absorbed companies point at the root that they end at; those
    that were pointed on by a later decision, and earlier duplicates of absorbed ones, carry that decision's reason, marked.
    Survivors take the canonical name and domain of their last merge. Deciding again changes nothing.
    """
    edges = materialise(settled.where("accepted").withColumn("why", F.concat(F.lit("워크벤치 사람확정("), "tier", F.lit(")"))), "accepted")
    won = edges.select("id", F.col("survivor").alias("_s"), F.col("decided_by").alias("_by"))
    joined = candidates.join(won, "id", "left")
    fresh = F.col("_s").isNotNull()
    new = {"status": F.lit("merged"), "survivor_key": F.col("_s"), "decided_by": F.col("_by"), "decided_at": at}
    after = joined.select(*(F.when(fresh, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in candidates.columns))

    tops = _tops(edges)
    known = ledger if "canonical_name" in ledger.columns else ledger.withColumn("canonical_name", F.lit(None).cast("string"))
    mine = tops.select("key", F.col("into").alias("_into"), F.when(F.col("hops") == 1, F.col("why")).otherwise(F.concat("why", F.lit(" (rechained)"))).alias("_why"), F.col("decided_by").alias("_who"))
    parents = tops.select(F.col("key").alias("duplicate_of"), F.col("into").alias("_pinto"), F.concat("why", F.lit(" (rechained)")).alias("_pwhy"), F.col("decided_by").alias("_pwho"))
    named = edges.groupBy(F.col("survivor").alias("key")).agg(F.max_by("canonical_name", "seq").alias("_name"), F.max_by("domain", "seq").alias("_domain"), F.lit(True).alias("_named"))
    rows = known.join(mine, "key", "left").join(parents, "duplicate_of", "left").join(named, "key", "left")
    moved, survives = F.coalesce("_into", "_pinto").isNotNull(), F.coalesce("_named", F.lit(False))
    put = {
        "duplicate_of": F.coalesce("_into", "_pinto", "duplicate_of"),
        "merge_reason": F.when(moved, F.coalesce("_why", "_pwhy")).otherwise(F.col("merge_reason")),
        "merged_by": F.when(moved, F.coalesce("_who", "_pwho")).otherwise(F.col("merged_by")),
        "merged_at": F.when(moved, at).otherwise(F.col("merged_at")),
        "canonical_name": F.when(survives, F.col("_name")).otherwise(F.col("canonical_name")),
        "domain": F.when(survives, F.col("_domain")).otherwise(F.col("domain")),
    }
    return after, rows.select(*(put[c].alias(c) if c in put else F.col(c) for c in known.columns))
