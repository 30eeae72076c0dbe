"""State changes of the ledger and its companions, each a function from the old table and the changes to the new one.

Nothing is updated in place: the caller writes the result beside the old table and swaps them, so a job
that dies half-way leaves the old state. Applying the same changes twice gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import identity


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the least order of each key, without a sort of the others: whole rows are compared as structs."""
    least = F.min_by(F.struct(*rows.columns), order)
    return rows.groupBy(key).agg(least.alias("_r")).select("_r.*")


def least_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row with the least values, column by column: the same one however the job runs."""
    return rows.groupBy(key).agg(F.min(F.struct(*(c for c in rows.columns if c != key))).alias("_r")).select(key, "_r.*").select(*rows.columns)


# Characters that a discovered company's columns hold; longer texts are cut.
LENGTHS = {"name": 512, "region": 64, "reg_no": 64, "ticker": 32, "phone": 64, "ir_url": 512, "name_eng": 512, "market": 32}


def save_discovered(ledger: DataFrame, found: DataFrame, at: Column, order: str | None = None) -> DataFrame:
    """New keys are inserted; a known key's row stays as it is but for last_crawled_at, the time of this crawl.

    Of several found rows of one key the first by `order` is inserted, or the least where there is no order; columns that found
    lacks are null in new rows, and texts are cut to LENGTHS.
    """
    one = least_of_each(found, "key") if order is None else first_of_each(found, "key", order).drop(order)
    put = lambda c: F.substring(c, 1, LENGTHS[c]) if c in LENGTHS else F.col(c)
    new = one.select("key", *(put(c).alias(f"_{c}") for c in one.columns if c != "key"), F.lit(True).alias("_seen"))
    both = ledger.withColumn("_known", F.lit(True)).join(new, "key", "full_outer")
    held = set(one.columns) - {"key"}
    inserted = F.col("_known").isNull()
    return both.select(
        *(
            F.when(F.col("_seen"), at).otherwise(F.col(c)).alias(c) if c == "last_crawled_at"
            else F.when(inserted, at).otherwise(F.col(c)).alias(c) if c == "first_seen" and c not in held
            else F.when(inserted, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in held
            else F.col(c)
            for c in ledger.columns
        )
    )


def insert_only(ledger: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """The rows to add: of each unknown key the first, in the ledger's columns; a null key identifies nothing."""
    unknown = rows.where("key is not null").join(ledger.select("key"), "key", "left_anti")
    return first_of_each(unknown, "key", order)


def replace_contacts(contacts: DataFrame, desired: DataFrame) -> DataFrame:
    """The contacts after the companies in `desired` got exactly those: others' rows stay, theirs are replaced, ids are kept."""
    touched = desired.select("company_id").distinct()
    ids = identity.contact_id(F.col("company_id"), F.col("type"), F.col("value"))
    new = least_of_each(desired.withColumn("contact_id", ids).select(*contacts.columns), "contact_id")
    return contacts.join(touched, "company_id", "left_anti").select(*contacts.columns).unionByName(new)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of the changes replace those of the same key."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def populate_candidates(known: DataFrame, candidates: DataFrame) -> DataFrame:
    """The workbench after a report: uncertain pairs are inserted or refreshed while pending; decided ones never change."""
    new = candidates.where(F.col("tier").isin("domain", "lexical", "shortlist")).select(
        identity.pair_id(F.col("key_a"), F.col("key_b")).alias("id"), F.col("key_a").alias("_a"), F.col("key_b").alias("_b"), F.col("tier").alias("_t"), F.col("name_score").alias("_s")
    )
    both = known.join(new, "id", "full_outer")
    fresh = F.col("_a").isNotNull() & (F.coalesce("status", F.lit("pending")) == "pending")
    take = lambda n, o: F.when(fresh, F.col(n)).otherwise(F.col(o)).alias(o)
    return both.select("id", F.coalesce("key_a", "_a").alias("key_a"), F.coalesce("key_b", "_b").alias("key_b"), take("_t", "tier"), take("_s", "name_score"), F.coalesce("status", F.lit("pending")).alias("status"))


def rekey_map(keys: DataFrame) -> DataFrame:
    """old, new: the name: keys whose country part has another normal form."""
    parts = F.split("key", ":", 3)
    new = F.concat(F.lit("name:"), identity.normal_country(F.get(parts, 1)), F.lit(":"), F.get(parts, 2))
    return keys.where(F.col("key").startswith("name:")).select(F.col("key").alias("old"), new.alias("new")).where("old <> new")


def rekey_pairs(known: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pairs under new keys, ordered anew, with new ids; of pairs that become equal the least old id stays, pairs of one key go."""
    to = lambda c: mapping.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new"))
    joined = known.join(to("key_a"), "key_a", "left").join(to("key_b"), "key_b", "left")
    a, b = F.coalesce("key_a_new", "key_a"), F.coalesce("key_b_new", "key_b")
    moved = joined.select(F.col("id").alias("old_id"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "tier", "name_score", "status").where("a <> b")
    named = moved.select(identity.pair_id(F.col("a"), F.col("b")).alias("id"), "old_id", F.col("a").alias("key_a"), F.col("b").alias("key_b"), "tier", "name_score", "status")
    return first_of_each(named, "id", "old_id").drop("old_id")


def advance_cursor(position: Column, total: Column) -> Column:
    """Where the next run begins: the position, or 0 at the end."""
    return F.when((position >= 0) & (position < total), position).otherwise(F.lit(0))


def finish_jobs(jobs: DataFrame, reason: str) -> DataFrame:
    running = F.col("status") == "running"
    return jobs.withColumn("error", F.when(running, F.lit(reason)).otherwise(F.col("error"))).withColumn("status", F.when(running, F.lit("failed")).otherwise(F.col("status")))


def latest_job(jobs: DataFrame, status: str | None = None) -> DataFrame:
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now).join(users.where("is_active"), "user_id")


def blank_runs_stop(rows: DataFrame, sheet: str, line: str, blank: Column, most: int = 200) -> DataFrame:
    """The rows of each sheet before its first run of `most` blank ones, without the blank ones."""
    by_line = Window.partitionBy(sheet).orderBy(line)
    marked = rows.withColumn("_blank", blank.cast("int"))
    run = F.sum("_blank").over(by_line.rowsBetween(-most + 1, 0))
    ended = marked.withColumn("_run", run).withColumn("_ended", F.max((F.col("_run") >= most).cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    return ended.where("_ended = 0 AND _blank = 0").drop("_blank", "_run", "_ended")
