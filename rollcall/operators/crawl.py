"""What a crawl leaves behind: new rows of the ledger, absorbed ones, leads, progress, jobs, and later corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import identity
from rollcall.functions.dimensions import AMBIGUOUS_LABELS, KSIC, SIC, UK_SIC, korean_names
from rollcall.operators.ledger import least_of_each, save_discovered


def records(ledger: DataFrame, include_merged: bool = False) -> DataFrame:
    """key, name, country, domain, reg_no of the ledger's rows; rows merged into others only on demand."""
    rows = ledger if include_merged else ledger.where("duplicate_of is null")
    return rows.select("key", "name", F.coalesce("country", F.lit("")).alias("country"), "domain", "reg_no")


def seen(ledger: DataFrame) -> DataFrame:
    """kind ('key' or 'domain') and value of all that the ledger knows already."""
    keys = ledger.select(F.lit("key").alias("kind"), F.col("key").alias("value"))
    domains = ledger.select(F.lit("domain").alias("kind"), identity.registered_domain(F.col("domain")).alias("value"))
    return keys.union(domains).where("value is not null").distinct()


def absorb_inline(ledger: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """The ledger after found rows (the ledger's columns that are known, and survivor) were recorded, and those that have a
    survivor linked to it. A row that is a duplicate already, or its own survivor, is only recorded."""
    after = save_discovered(ledger, found.drop("survivor"), at)
    to = found.where("survivor is not null and survivor <> key").groupBy("key").agg(F.min("survivor").alias("_to"))
    joined = after.join(to, "key", "left")
    linked = F.col("_to").isNotNull() & F.col("duplicate_of").isNull()
    new = {"duplicate_of": F.col("_to"), "merged_at": at, "merged_by": F.lit("auto"), "merge_reason": F.lit("inline:name+domain")}
    return joined.select(*(F.when(linked, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in after.columns))


def build_leads(found: DataFrame, contacts: DataFrame, existence: DataFrame, labels: DataFrame) -> DataFrame:
    """One lead for each found company (key, name, country, industry, listed, domain): whether it exists (existence: key,
    is_active, site_alive, confidence), its label, homepage, accepted addresses and the first of them, phone and form.

    contacts: key, ord (unique in a company), type, value, accepted. labels: key and what a classifier said; it is asked only
    of active companies with an ambiguous label, and an empty answer leaves the label.
    """
    ordered = lambda kind, name: contacts.where(F.col("type") == kind).groupBy("key").agg(F.min_by("value", "ord").alias(name))
    mails = contacts.where("type = 'email' and accepted").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("_m"))
    mails = mails.select("key", F.transform("_m", lambda m: m["value"]).alias("email_candidates"))
    joined = found.join(existence, "key", "left").join(labels.select("key", F.col("label").alias("_label")), "key", "left")
    for part in (mails, ordered("phone", "phone"), ordered("form", "form")):
        joined = joined.join(part, "key", "left")
    active = F.coalesce("is_active", F.lit(False))
    asked = active & F.col("industry").isin(*AMBIGUOUS_LABELS) & (F.coalesce("_label", F.lit("")) != "")
    known = F.col("listed").isin("listed", "unlisted")
    return joined.select(
        "key", "name", "country", F.when(asked, F.col("_label")).otherwise(F.col("industry")).alias("industry"), F.when(known, F.col("listed")).otherwise("unknown").alias("listed"),
        "domain", F.when(F.coalesce("domain", F.lit("")) != "", F.concat(F.lit("https://"), "domain")).alias("homepage"), active.alias("is_active"),
        F.coalesce("site_alive", F.lit(False)).alias("site_alive"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("email_candidates", F.array().cast("array<string>")).alias("email_candidates"), F.get("email_candidates", 0).alias("email"), "phone", "form",
    )


def ensure_discovered(ledger: DataFrame, leads: DataFrame, at: Column) -> DataFrame:
    """The ledger with a row for every lead's company; rows that are there stay untouched, unlike those of a crawl."""
    names = [c for c in leads.columns if c in ledger.columns]
    new = least_of_each(leads.select(*names), "key").join(ledger.select("key"), "key", "left_anti")
    made = new.select(*(at.alias(c) if c in ("last_crawled_at", "first_seen") else F.col(c) if c in names else F.lit(None).cast(ledger.schema[c].dataType).alias(c) for c in ledger.columns))
    return ledger.unionByName(made)


def progress(found: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: discovered, enriched (with any contact), saved (active companies)."""
    some = (F.size("email_candidates") > 0) | F.col("phone").isNotNull() | F.col("form").isNotNull()
    counts = leads.agg(F.count_if(some).alias("enriched"), F.count_if("is_active").alias("saved"))
    return found.agg(F.count("*").alias("discovered")).crossJoin(counts)  # single rows


def backfill_industries(company: DataFrame, discovered: DataFrame, verdicts: DataFrame) -> DataFrame:
    """company after active ones with an ambiguous label, and a discovery, took the label that a classifier said (company_id,
    label); where it said nothing the label stays."""
    known = company.join(discovered.select("key").distinct(), "key", "left_semi").select("company_id", F.lit(True).alias("_known"))
    joined = company.join(known, "company_id", "left").join(verdicts.select("company_id", F.col("label").alias("_label")), "company_id", "left")
    taken = F.coalesce("_known", F.lit(False)) & F.col("is_active") & F.col("industry").isin(*AMBIGUOUS_LABELS) & (F.coalesce("_label", F.lit("")) != "")
    return joined.select(*(F.when(taken, F.col("_label")).otherwise(F.col(c)).alias(c) if c == "industry" else F.col(c) for c in company.columns))


def rekey_companies(company: DataFrame, child: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(company, child) after keys changed (old, new): companies get the new key and the id that follows from it, and rows of
    the child (company_id, ...) follow their company."""
    to = mapping.select(F.col("old").alias("key"), F.col("new").alias("_new"))
    joined = company.join(to, "key", "left").withColumn("_id", F.when(F.col("_new").isNotNull(), identity.company_id(F.col("_new"))).otherwise(F.col("company_id")))
    named = {"company_id": F.col("_id"), "key": F.coalesce("_new", "key")}
    after = joined.select(*(named[c].alias(c) if c in named else F.col(c) for c in company.columns))
    moved = joined.where("_new is not null").select("company_id", "_id")
    follow = child.join(moved, "company_id", "left").select(*(F.coalesce("_id", c).alias(c) if c == "company_id" else F.col(c) for c in child.columns))
    return after, follow


def clear_reviews(queue: DataFrame, lost: DataFrame) -> DataFrame:
    """The queue after companies (company_id) lost all their addresses: no candidates and no selection, the status stays."""
    joined = queue.join(lost.select("company_id", F.lit(True).alias("_lost")).distinct(), "company_id", "left")
    gone = F.coalesce("_lost", F.lit(False)) & ~F.col("candidates").eqNullSafe(F.lit("[]"))
    new = {"candidates": F.lit("[]"), "selected": F.lit(None).cast("string"), "selected_by_human": F.lit(False)}
    return joined.select(*(F.when(gone, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in queue.columns))


def parse_verdict(text: Column, model: str) -> Column:
    """struct(same, confidence, reason, model) of a judge's answer: the JSON between the first brace and the last one; an answer
    without it, or a broken one, is uncertain. confidence is kept between 0 and 1."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = F.try_parse_json(body)
    is_json = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    get = lambda path, kind: F.try_variant_get(parsed, path, kind)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(get("$.confidence", "double"), F.lit(0.0))))
    reason = F.coalesce(F.nullif(F.trim(get("$.reason", "string")), F.lit("")), F.lit("(근거 미제공)"))
    failed = F.when(body == "", "LLM 응답에 JSON 없음(파싱 실패)").otherwise("LLM JSON 파싱 실패")
    return F.struct(
        F.coalesce(is_json & get("$.same", "boolean"), F.lit(False)).alias("same"), F.when(is_json, confidence).otherwise(0.0).alias("confidence"),
        F.when(is_json, reason).otherwise(failed).alias("reason"), F.lit(model).alias("model"),
    )


def request_cancel(jobs: DataFrame, job_id: str, at: Column) -> DataFrame:
    """The jobs with one marked to be cancelled, at a time, if it is running."""
    asked = (F.col("id") == job_id) & (F.col("status") == "running")
    return jobs.withColumn("cancel_requested", F.col("cancel_requested") | asked).withColumn("updated_at", F.when(asked, at).otherwise(F.col("updated_at")))


def job_items(jobs: DataFrame) -> DataFrame:
    """Jobs as they are sent out: times in ISO 8601, with the offset of UTC."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias(c)
    times = ("started_at", "updated_at", "finished_at")
    return jobs.select(*(iso(c) if c in times else F.col(c) for c in jobs.columns))


def korean_label(country: Column) -> Column:
    """The Korean name of a country by any of its names, its code where it has none; null of an unknown country."""
    iso = F.upper(identity.normal_country(country))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in korean_names().items() for x in pair)), iso)


def supported_countries(spark: SparkSession) -> DataFrame:
    """iso and label of the countries that have names here."""
    return spark.createDataFrame(sorted(korean_names().items()), "iso string, label string")


def supported_industries(spark: SparkSession) -> DataFrame:
    """The industries for which any register's codes are known."""
    return spark.createDataFrame([(x,) for x in sorted({*KSIC, *SIC, *UK_SIC})], "industry string")
