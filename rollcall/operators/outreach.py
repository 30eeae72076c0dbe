"""Recipients of a mailing, within a daily quota; nothing is ever sent from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import identity
from rollcall.operators.queue import apply_filters


def recipients(queue: DataFrame, company: DataFrame, log: DataFrame, **filters) -> DataFrame:
    """email, company_id: confirmed selections, the least company of each address, without those already sent to."""
    rows = apply_filters(queue.where("status = 'confirmed'").join(company, "company_id"), **filters)
    address = F.lower(F.trim("selected"))
    one = rows.where(F.coalesce(address, F.lit("")) != "").groupBy(address.alias("email")).agg(F.min("company_id").alias("company_id"))
    return one.join(log.where("status = 'sent'").select("email").distinct(), "email", "left_anti")


def sent_today(log: DataFrame, now: Column) -> DataFrame:
    return log.where((F.col("status") == "sent") & (F.col("sent_at") >= F.date_trunc("day", now))).agg(F.count("*").alias("sent"))


def batch(found: DataFrame, log: DataFrame, now: Column, quota: int = 400) -> DataFrame:
    """The recipients that today's quota leaves room for, by address, and the id of their log rows."""
    room = max(0, quota - sent_today(log, now).first()["sent"])
    return found.orderBy("email").limit(room).withColumn("send_id", identity.send_id(F.col("email")))


def preview(found: DataFrame, log: DataFrame, now: Column, quota: int = 400, sample: int = 10) -> DataFrame:
    """One row: recipients, remaining, sample (the first addresses)."""
    first = found.orderBy("email").limit(sample).agg(F.array_sort(F.collect_list("email")).alias("sample"))
    counts = found.agg(F.count("*").alias("recipients"))
    left = sent_today(log, now).select(F.greatest(F.lit(0), F.lit(quota) - F.col("sent")).alias("remaining"))
    return counts.crossJoin(left).crossJoin(first)  # single rows


def log_sends(log: DataFrame, sends: DataFrame) -> DataFrame:
    """The log with one row for each address: the new one where there is one."""
    return log.join(sends.select("send_id"), "send_id", "left_anti").unionByName(sends)
