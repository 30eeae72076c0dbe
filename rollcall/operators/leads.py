"""Leads, put together from the tables that hold their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import mail
from rollcall.operators.queue import effective_selected, parse_candidates


def _first(contact: DataFrame, kind: str, name: str) -> DataFrame:
    """company_id and the value of the contact of the least id of one type."""
    rows = contact.where(F.col("type") == kind).groupBy("company_id")
    return rows.agg(F.min_by("value", "contact_id").alias(name))


def load_leads(
    company: DataFrame, discovered: DataFrame, contact: DataFrame, queue: DataFrame, validation: DataFrame, company_ids: DataFrame | None = None
) -> DataFrame:
    """One row for each company (or each in company_ids): its own columns, listed and domain of its discovery, phone and form
    (of the least contact id), the e-mail that was chosen, and that e-mail's validation.

    company: company_id, key, name, ...; discovered: key, listed, domain; contact: contact_id, company_id, type, value, role,
    confidence; queue: company_id, candidates, selected (one row a company at most); validation: contact_id, status, mx, smtp.
    The e-mail is the queue's effective selection while the company has it as a contact; else the best accepted one; else
    the one of the least contact id. A company without a discovery is listed as unknown, one without an e-mail has no status.
    """
    company = company.drop("listed", "domain")
    rows = company if company_ids is None else company.join(company_ids.select("company_id").distinct(), "company_id", "left_semi")
    chosen = queue.select("company_id", effective_selected(F.col("selected"), parse_candidates(F.col("candidates"))).alias("_chosen"))
    entry = F.struct("value", "role", "confidence", "contact_id")
    emails = contact.where("type = 'email'").groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("contact_id", entry.alias("e")))).alias("_all"))
    emails = emails.select("company_id", F.transform("_all", lambda x: x["e"]).alias("_emails"))
    joined = rows.join(discovered.select("key", "listed", "domain"), "key", "left").join(chosen, "company_id", "left").join(emails, "company_id", "left")
    wanted = F.get(F.filter("_emails", lambda e: e["value"] == F.col("_chosen")), 0)
    picked = F.coalesce(wanted, F.get(mail.rank_accepted(F.col("_emails")), 0), F.get("_emails", 0))
    named = joined.withColumn("_email", picked).withColumn("contact_id", F.col("_email.contact_id"))
    checked = named.join(validation.select("contact_id", "status", "mx", "smtp"), "contact_id", "left")
    full = checked.join(_first(contact, "phone", "phone"), "company_id", "left").join(_first(contact, "form", "form_url"), "company_id", "left")
    return full.select(
        *company.columns, F.coalesce("listed", F.lit("unknown")).alias("listed"), "domain", F.col("_email.value").alias("email"), "phone", "form_url",
        F.col("_email").isNotNull().alias("has_email"), F.col("phone").isNotNull().alias("has_phone"), F.col("form_url").isNotNull().alias("has_form"),
        F.when(F.col("_email").isNotNull(), F.coalesce("status", F.lit("unknown"))).alias("status"), "mx", "smtp",
    )
