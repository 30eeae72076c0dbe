"""The workbench of duplicate candidates: its list, its counts, and the decisions to merge or to keep apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.golden import apply_golden, golden_records

STATUSES = ("pending", "merged", "separated")


def candidate_items(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates (id, key_a, key_b, ...) with both companies' names and domains, the country of the first that has one,
    and stale: whether one of the two is no longer in the ledger (key, name, country, domain). All other columns stay."""
    side = lambda s: ledger.select(
        F.col("key").alias(f"key_{s}"), F.col("name").alias(f"name_{s}"), F.col("country").alias(f"_country_{s}"), F.col("domain").alias(f"domain_{s}"), F.lit(True).alias(f"_known_{s}")
    )
    kept = candidates.drop("name_a", "name_b", "domain_a", "domain_b", "country", "stale")
    joined = kept.join(side("a"), "key_a", "left").join(side("b"), "key_b", "left")
    country = F.coalesce(F.nullif("_country_a", F.lit("")), F.nullif("_country_b", F.lit("")), F.lit(""))
    stale = F.col("_known_a").isNull() | F.col("_known_b").isNull()
    return joined.select(*(F.col(c) for c in kept.columns), "name_a", "name_b", country.alias("country"), "domain_a", "domain_b", stale.alias("stale"))


def list_candidates(candidates: DataFrame, ledger: DataFrame, status: str | None = "pending", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the candidates of a status (None: all), the highest scores first; only the page is joined with the ledger."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    rows = candidates if status is None else candidates.where(F.col("status") == status)
    page = rows.orderBy(F.desc("name_score"), "id").offset(offset).limit(limit)
    return candidate_items(page, ledger)


def summary(candidates: DataFrame) -> DataFrame:
    """One row: pending, merged, separated, total."""
    return candidates.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count("*").alias("total"))


def add_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates with the verdicts (id, same, confidence, reason, model) on pending ones; decided ones, and those without a
    verdict, keep what they have."""
    names = {"same": "llm_same", "confidence": "llm_confidence", "reason": "llm_reason", "model": "llm_model"}
    new = verdicts.select("id", *(F.col(a).alias(f"_{b}") for a, b in names.items()), F.lit(True).alias("_said"))
    joined = candidates.join(new, "id", "left")
    fresh = F.coalesce("_said", F.lit(False)) & (F.col("status") == "pending")
    kept = [c for c in candidates.columns if c not in names.values()]
    old = lambda c: F.col(c) if c in candidates.columns else F.lit(None)
    return joined.select(*kept, *(F.when(fresh, F.col(f"_{c}")).otherwise(old(c)).alias(c) for c in names.values()))


def decide_separate(candidates: DataFrame, decisions: DataFrame, at: Column) -> DataFrame:
    """Candidates after decisions (id, decided_by) to keep pairs apart; only pending ones change."""
    joined = candidates.join(decisions.select("id", F.col("decided_by").alias("_by")), "id", "left")
    taken = F.col("_by").isNotNull() & (F.col("status") == "pending")
    new = {"status": F.lit("separated"), "decided_by": F.col("_by"), "decided_at": at}
    return joined.select(*(F.when(taken, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in candidates.columns))


def decide_merge(candidates: DataFrame, members: DataFrame, ledger: DataFrame, decision: tuple[str, str], at: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, ledger) after one decision (id, decided_by) that a pair is the same company.

    The survivor comes from the golden record of the two, the reason names the tier. Refused, and nothing changes,
    where the candidate isn't pending, a company is gone from the ledger, or the merge would absorb nothing.
    """
    name, by = decision
    row = candidates.where((F.col("id") == name) & (F.col("status") == "pending")).select("key_a", "key_b", "tier").first()
    if row is None:
        return candidates, ledger
    keys = [row["key_a"], row["key_b"]]
    two = members.where(F.col("key").isin(*keys))
    golden = golden_records(two, members.sparkSession.createDataFrame([tuple(keys)], "key_a string, key_b string"))
    roots = {r["key"] for r in ledger.where(F.col("key").isin(*keys) & F.col("duplicate_of").isNull()).select("key").collect()}  # two rows
    found = golden.select("survivor_key", "absorbed_keys").first()
    if found is None or found["survivor_key"] not in roots or not roots & set(found["absorbed_keys"]):
        return candidates, ledger
    merged = apply_golden(ledger, golden, by, at, f"워크벤치 사람확정({row['tier']})")
    new = {"status": F.lit("merged"), "survivor_key": F.lit(found["survivor_key"]), "decided_by": F.lit(by), "decided_at": at}
    after = candidates.select(*(F.when(F.col("id") == name, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in candidates.columns))
    return after, merged
