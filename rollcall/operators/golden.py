"""Clusters of confirmed duplicates, their golden records, and the reversible merge into the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import identity
from rollcall.operators.components import connected_components, thinned
from rollcall.session import materialise


def confirmed_pairs(candidates: DataFrame, verdicts: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """key_a, key_b: the confirmed tiers, and judged pairs that a real judge (never the stub) calls the same."""
    sure = candidates.where(F.col("tier").isin("reg_no", "auto")).select("key_a", "key_b")
    if verdicts is None:
        return sure
    more = verdicts.where(F.col("same") & (F.col("confidence") >= least) & (F.col("model") != "stub")).select("key_a", "key_b")
    return sure.unionByName(more)


def has_registry() -> Column:
    return (F.coalesce("registry", F.lit("")) != "") & (F.coalesce("registry_id", F.lit("")) != "")


def clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, cluster: components of the pairs both of whose ends are members.

    Pairs are written as they come, those of a block together, and thinned before they are shuffled. Their ends, far fewer, are
    looked up among the members; pairs are joined only where some are strangers.
    """
    pairs = materialise(pairs.select("key_a", "key_b"), "pairs")
    ends = pairs.select(F.col("key_a").alias("key")).distinct().union(pairs.select(F.col("key_b").alias("key")).distinct())
    strangers = materialise(ends.distinct().join(members.select("key"), "key", "left_anti"), "strangers")
    known = pairs
    if not strangers.isEmpty():
        for end in ("key_a", "key_b"):
            known = known.join(strangers.withColumnRenamed("key", end), end, "left_anti")
    return connected_components(thinned(known, "key_a", "key_b"), "key_a", "key_b").select(F.col("node").alias("key"), F.col("component").alias("cluster"))


def golden_records(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """survivor_key, canonical_name, canonical_domain, absorbed_keys: one row for each cluster of two or more.

    Survivor: with a registry, with a domain, most tokens, least key. Name: with a registry, most
    tokens, not only ASCII, least key. Domain: with a registry, least key, among those that have one.
    """
    found = clusters(members, pairs).join(members, "key")
    tokens = F.size(identity.name_tokens(F.col("name")))
    dom = identity.registered_domain(F.col("domain"))
    plain = (~F.col("name").rlike("[^\\x00-\\x7F]")).cast("int")
    rows = found.select(
        "cluster", "key", F.trim("name").alias("name"), (~has_registry()).cast("int").alias("no_reg"), dom.isNull().cast("int").alias("no_dom"),
        (-tokens).alias("fewer"), plain.alias("plain"), dom.alias("dom"),
    )
    grouped = rows.groupBy("cluster").agg(
        F.min_by("key", F.struct("no_reg", "no_dom", "fewer", "key")).alias("survivor_key"),
        F.min_by("name", F.struct("no_reg", "fewer", "plain", "key")).alias("canonical_name"),
        F.min_by("dom", F.when(F.col("dom").isNotNull(), F.struct("no_reg", "key"))).alias("canonical_domain"),
        F.collect_set("key").alias("keys"),
    ).where(F.size("keys") > 1)
    absorbed = F.array_sort(F.array_except("keys", F.array("survivor_key")))
    return grouped.select("survivor_key", "canonical_name", "canonical_domain", absorbed.alias("absorbed_keys"))


def apply_golden(ledger: DataFrame, golden: DataFrame, merged_by: str, at: Column, reason: str = "auto") -> DataFrame:
    """The ledger after the merges; a column canonical_name is added where the ledger has none.

    A survivor that is itself a duplicate is refused with its whole cluster. Absorbed rows point at
    their survivor; a row that is a duplicate already keeps its merge. Rows that pointed at a row absorbed now
    are pointed at its survivor, with this merge's reason, marked. A survivor takes the canonical name, and the
    canonical domain if it has none; other rows keep both. Applying twice is applying once.
    """
    known = ledger if "canonical_name" in ledger.columns else ledger.withColumn("canonical_name", F.lit(None).cast("string"))
    roots = known.where("duplicate_of is null").select("key")
    accepted = materialise(golden.join(roots.withColumnRenamed("key", "survivor_key"), "survivor_key", "left_semi"), "golden")
    pairs = accepted.select(F.explode("absorbed_keys").alias("key"), F.col("survivor_key").alias("into")).where("key <> into")
    to = pairs.join(roots, "key", "left_semi")
    parents = to.select(F.col("key").alias("duplicate_of"), F.col("into").alias("rechained"))
    named = accepted.select(F.col("survivor_key").alias("key"), F.col("canonical_name").alias("new_name"), F.col("canonical_domain").alias("new_domain"), F.lit(True).alias("survives"))
    joined = known.join(to, "key", "left").join(parents, "duplicate_of", "left").join(named, "key", "left")
    moved, survives = F.coalesce("into", "rechained").isNotNull(), F.coalesce("survives", F.lit(False))
    why = F.when(F.col("into").isNotNull(), F.lit(reason)).otherwise(F.lit(f"{reason} (rechained)"))
    set_if = lambda value, old: F.when(moved, value).otherwise(F.col(old))
    new = {
        "duplicate_of": F.coalesce("into", "rechained", "duplicate_of"),
        "merge_reason": set_if(why, "merge_reason"),
        "merged_by": set_if(F.lit(merged_by), "merged_by"),
        "merged_at": set_if(at, "merged_at"),
        "canonical_name": F.when(survives, F.col("new_name")).otherwise(F.col("canonical_name")),
        "domain": F.when(survives & (F.coalesce("domain", F.lit("")) == ""), F.coalesce("new_domain", "domain")).otherwise(F.col("domain")),
    }
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in known.columns))
