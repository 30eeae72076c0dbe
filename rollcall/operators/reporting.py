"""Statistics of leads and users, costs and budgets, and the texts of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.dimensions import UNIT_PRICES


def lead_statistics(leads: DataFrame) -> DataFrame:
    """One row over leads (country, is_active, has_email, has_phone, has_form, status, smtp, method).

    A form counts only for a lead without an e-mail.
    """
    some = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    email = F.col("has_email")
    return leads.agg(
        F.count("*").alias("total"),
        some(F.col("is_active")).alias("active"),
        some(email).alias("with_email"),
        some(F.col("has_phone")).alias("with_phone"),
        some(F.col("has_form") & ~F.coalesce(email, F.lit(False))).alias("with_form"),
        some(email & (F.col("status") == "valid")).alias("valid"),
        some(email & (F.col("status") == "risky")).alias("risky"),
        some(email & (F.col("status") == "invalid")).alias("invalid"),
        some(email & F.col("smtp")).alias("smtp_ok"),
    )


def histogram(rows: DataFrame, column: str, blank: str = "?") -> DataFrame:
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(blank))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def user_statistics(users: DataFrame, audit: DataFrame, queue: DataFrame) -> DataFrame:
    """user_id, confirmed, rejected, last_at (of any action), claimed (pending rows held); 0 where there is nothing."""
    acts = audit.groupBy(F.col("actor_id").alias("user_id")).agg(
        F.count_if(F.col("action") == "confirmed").alias("confirmed"), F.count_if(F.col("action") == "rejected").alias("rejected"), F.max("ts").alias("last_at")
    )
    held = queue.where("status = 'pending' AND claimed_by is not null").groupBy(F.col("claimed_by").alias("user_id")).agg(F.count("*").alias("claimed"))
    joined = users.join(acts, "user_id", "left").join(held, "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("user_id", zero("confirmed"), zero("rejected"), "last_at", zero("claimed"))


def recent_audit(audit: DataFrame, queue: DataFrame, company: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = audit.join(queue.select("review_id", "company_id"), "review_id").join(company.select("company_id", F.col("name").alias("company")), "company_id", "left")
    return rows.orderBy(F.desc("ts"), "audit_id").offset(offset).limit(limit).select("audit_id", "review_id", "action", "actor_id", "company", "ts")


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def priced(events: DataFrame, prices: dict[str, int] | None = None) -> DataFrame:
    """events (provider, units, ts) with unit_cost, cost and month: units below 0 count as 0, unknown providers cost 0."""
    table = events.sparkSession.createDataFrame(sorted((prices or UNIT_PRICES).items()), "provider string, price int")
    units = F.greatest(F.col("units"), F.lit(0))
    joined = events.join(F.broadcast(table), "provider", "left")  # eight rows
    return joined.select(*events.columns, F.coalesce("price", F.lit(0)).alias("unit_cost"), (units * F.coalesce("price", F.lit(0))).alias("cost"), month_key(F.col("ts")).alias("month"))


def cost_breakdown(costs: DataFrame, month: str) -> DataFrame:
    return costs.where(F.col("month") == month).groupBy("provider").agg(F.sum("cost").alias("cost"), F.sum("units").alias("units"))


def budget_report(costs: DataFrame, month: str, budget: int) -> DataFrame:
    """month, total, budget, remaining (not below 0), pct of the budget to one decimal (0 without one), over."""
    total = F.coalesce(F.sum("cost"), F.lit(0))
    return costs.where(F.col("month") == month).agg(total.alias("total")).select(
        F.lit(month).alias("month"), "total", F.lit(budget).cast("long").alias("budget"), F.greatest(F.lit(0), F.lit(budget) - F.col("total")).alias("remaining"),
        # the double is rounded, half to even, as it stands
        F.when(F.lit(budget) != 0, F.bround(F.col("total") / F.nullif(F.lit(budget), F.lit(0)) * 100, 1)).otherwise(0.0).alias("pct"),
        (F.col("total") >= budget).alias("over"),
    )


def spent_until_budget(costs: DataFrame, budget: int) -> DataFrame:
    """The calls of each month that a budget lets through, in time: a call runs while what was spent before is below it.

    Sums go in two levels: over the hours of a month, then over the calls of an hour, so no task gets a whole month.
    """
    hour = costs.withColumn("_hour", F.date_trunc("hour", "ts"))
    before = Window.partitionBy("month").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)  # at most 744 hours
    hours = hour.groupBy("month", "_hour").agg(F.sum("cost").alias("_cost")).select("month", "_hour", F.coalesce(F.sum("_cost").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("month", "_hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = hour.join(hours.where(F.col("_before") < budget), ["month", "_hour"])
    spent = F.col("_before") + F.coalesce(F.sum("cost").over(within), F.lit(0))
    return summed.withColumn("spent", spent).where(F.col("spent") < budget).select(*costs.columns, "spent")


def throttle(failures: DataFrame, most: int = 5, window_seconds: int = 900) -> DataFrame:
    """user_id, second, n, retry_after: failures within the window up to each one, and the seconds until the
    oldest of those leaves it, 1 at least (0 while there are fewer than `most`)."""
    recent = Window.partitionBy("user_id").orderBy("second").rangeBetween(-window_seconds + 1, 0)
    rows = failures.withColumn("n", F.count("*").over(recent))
    oldest = F.min("second").over(recent)
    wait = F.when(F.col("n") >= most, F.greatest(F.lit(1), F.ceil(oldest + window_seconds - F.col("second")))).otherwise(0)
    return rows.withColumn("retry_after", wait.cast("long"))


# Fixed value: the note for leads that have a form and no e-mail.
FORM_ONLY = "사이트 내 문의폼"


def export_rows(leads: DataFrame) -> DataFrame:
    """Leads in the twelve columns of the export: country, name, phone, e-mail, form, site, two blanks, industry, whether
    the e-mail exists (a note where there is only a form), whether the site is alive, a blank."""
    mark = lambda c: F.when(F.coalesce(c, F.lit(False)), "O").otherwise("X")
    text = lambda c: F.coalesce(c, F.lit(""))
    email, form = F.coalesce("has_email", F.lit(False)), F.coalesce("has_form", F.lit(False))
    exists = F.when(email, mark(F.col("status") == "valid")).when(form, FORM_ONLY).otherwise("X")
    site = F.coalesce(F.nullif("homepage", F.lit("")), F.nullif("domain", F.lit("")), F.lit(""))
    blank = F.lit("")
    return leads.select(
        F.col("country").alias("a"), F.col("name").alias("b"), text("phone").alias("c"), F.when(email, text("email")).otherwise(blank).alias("d"),
        F.when(form, text("form_url")).otherwise("X").alias("e"), site.alias("f"), blank.alias("g"), blank.alias("h"), F.col("industry").alias("i"),
        exists.alias("j"), mark(F.col("site_alive")).alias("k"), blank.alias("l"),
    )


def report_status(stats: DataFrame | None = None) -> Column:
    """The label of a day: fixed words for no leads, no e-mails, and anything else."""
    return F.when(F.col("total") == 0, "점검").when(F.col("with_email") == 0, "주의").otherwise("정상")


def _listed(counts: str) -> Column:
    """name=count of a map, by name."""
    pairs = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")


def _said(*parts: str) -> Column:
    """Parts that are columns' names in braces, others as they stand."""
    return F.concat(*(F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts))


def daily_reports(stats: DataFrame) -> DataFrame:
    """For each row of statistics (date, milestone, next_plan, the counts of lead_statistics, by_method and by_country as
    maps, commits as an array): the day's report, its board task and its stand-up note, as text columns."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    lines = [
        _said("리드 ", "{total}", "건 처리(실존 ", "{active}", ")"),
        _said("이메일 확보 ", "{with_email}", "(검증 valid ", "{valid}", "/risky ", "{risky}", "/invalid ", "{invalid}", ", SMTP확정 ", "{smtp_ok}", ")"),
        _said("전화 ", "{with_phone}", " · 문의폼만 ", "{with_form}"),
        F.when(some("by_method"), F.concat(F.lit("이메일 출처: "), _listed("by_method"))),
        F.when(some("by_country"), F.concat(F.lit("국가: "), _listed("by_country"))),
        F.when(some("commits"), F.concat(F.lit("커밋:\n- "), F.array_join("commits", "\n- "))),
    ]
    note = _said(
        "리드 ", "{total}", "(실존 ", "{active}", ") · 이메일 ", "{with_email}", "(valid ", "{valid}", "/SMTP ", "{smtp_ok}", ") · 전화 ", "{with_phone}", " · 폼 ", "{with_form}"
    )
    plan = F.coalesce("next_plan", F.lit(""))
    return stats.select(
        "date", "milestone", F.concat_ws("\n", *lines).alias("done"), plan.alias("next"), F.when(report_status() == "정상", "없음").otherwise("산출 지표 점검 필요").alias("issues"),
        report_status().alias("status"), _said("{date}", " 크롤 운영").alias("task"), F.when(F.col("total") != 0, "Done").otherwise("점검").alias("task_status"),
        F.lit("Mid").alias("priority"), F.lit("시스템(자동)").alias("owner"), note.alias("note"),
        F.when(some("commits"), F.array_join(F.slice("commits", 1, 5), "; ")).otherwise(_said("리드 ", "{total}", "건 처리")).alias("yesterday"),
        F.when(plan != "", plan).otherwise(_said("리드 ", "{with_email}", "건 이메일 검증·후속 보강")).alias("today"),
        F.when(F.col("total") != 0, "없음").otherwise("발견 산출 0 — 소스 점검").alias("blocker"),
    )
