"""The review queue: filters, pages, signals, claims and state changes, each from tables to a table.

queue: review_id, company_id, field, status, candidates (JSON array), claimed_by, selected,
selected_by_human. company: company_id, name, country, industry, listed, region.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import identity

from rollcall.functions.dimensions import COUNTRIES

LISTED = ("listed", "unlisted", "unknown")
STATUSES = ("pending", "confirmed", "rejected")


def split_csv(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda t: F.trim(t)), lambda t: t != "")


def country_match_set(tokens: Sequence[str]) -> list[str]:
    """The tokens and all aliases of the countries they name, in lower case. The caller's tokens, not data."""
    wanted = {t.strip().lower() for t in tokens if t and t.strip()}
    return sorted(wanted | {a for _, _, aliases in COUNTRIES if wanted & set(aliases) for a in aliases})


def apply_filters(
    joined: DataFrame, countries: Sequence[str] = (), industries: Sequence[str] = (), listed: str | None = None, regions: Sequence[str] = ()
) -> DataFrame:
    """Keep the rows of the given countries (any alias), industries, listing and regions; what isn't given doesn't filter."""
    if listed is not None and listed not in LISTED:
        raise ValueError(f"listed must be one of {LISTED}")
    out = joined
    if countries:
        out = out.where(F.lower("country").isin(country_match_set(countries)))
    if industries:
        out = out.where(F.col("industry").isin([i.strip() for i in industries]))
    if listed is not None:
        out = out.where(F.col("listed") == listed)
    if regions:
        out = out.where(F.col("region").isin(list(regions)))
    return out


def parse_candidates(candidates: Column) -> Column:
    """The JSON array of strings; empty where it is null or not one."""
    return F.coalesce(F.from_json(candidates, "array<string>"), F.array().cast("array<string>"))


def effective_selected(selected: Column, values: Column) -> Column:
    """The selection while it is a candidate, else the first candidate, else null."""
    return F.when(F.coalesce(F.array_contains(values, selected), F.lit(False)), selected).otherwise(F.get(values, 0))


def unclaimed(queue: DataFrame, company: DataFrame, status: str | None = None, **filters) -> DataFrame:
    joined = queue.where("claimed_by is null").join(company, "company_id")
    if status is not None:
        joined = joined.where(F.col("status") == status)
    return apply_filters(joined, **filters)


def page(queue: DataFrame, company: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """A page in the order status, name, review_id; claimed rows are left out. The offset and limit are the feature."""
    return unclaimed(queue, company, **filters).orderBy("status", "name", "review_id").offset(offset).limit(limit)


def email_signals(contact: DataFrame, validation: DataFrame) -> DataFrame:
    """company_id, signals: address to (status, mx, smtp) of a company's validated e-mails; of equal addresses the least contact's."""
    rows = contact.where("type = 'email'").join(validation, "contact_id")
    one = rows.groupBy("company_id", "value").agg(F.min_by(F.struct("status", "mx", "smtp"), "contact_id").alias("s"))
    return one.groupBy("company_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "s")))).alias("signals"))


def first_forms(contact: DataFrame) -> DataFrame:
    """company_id, form_url, form_confidence: the form of the least contact id."""
    least = F.min_by(F.struct("value", "confidence"), "contact_id")
    return contact.where("type = 'form'").groupBy("company_id").agg(least.alias("f")).select(
        "company_id", F.col("f.value").alias("form_url"), F.col("f.confidence").alias("form_confidence")
    )


def items(queue: DataFrame, company: DataFrame, contact: DataFrame, validation: DataFrame) -> DataFrame:
    """Queue rows as shown: candidates as an array, the effective selection, listing, form, and each candidate's status."""
    values = parse_candidates(F.col("candidates"))
    joined = queue.join(company, "company_id", "left").join(email_signals(contact, validation), "company_id", "left").join(first_forms(contact), "company_id", "left")
    shown = joined.withColumn("values", values)
    statuses = F.transform("values", lambda v: F.coalesce(F.try_element_at("signals", v)["status"], F.lit("unverified")))
    return shown.select(
        "review_id", "company_id", "status", "values", effective_selected(F.col("selected"), F.col("values")).alias("effective"),
        F.coalesce("listed", F.lit("unknown")).alias("listed"), "form_url",
        F.coalesce(F.col("form_confidence") < 0.4, F.lit(False)).alias("low_confidence"), F.when(F.col("signals").isNull(), F.transform("values", lambda v: F.lit("unverified"))).otherwise(statuses).alias("statuses"),
    )


def allocate_claims(queue: DataFrame, requests: DataFrame, cap: int = 100) -> DataFrame:
    """review_id, user_id: unclaimed pending rows by id, dealt to requests (ord, user_id, batch) in their order.

    A request wants the smaller of its batch and what the user may still hold; requests must name
    distinct users. Intervals of row numbers give disjoint claims in one pass. The requests are few.
    """
    held = queue.where("claimed_by is not null AND status = 'pending'").groupBy(F.col("claimed_by").alias("user_id")).agg(F.count("*").alias("held"))
    wants = requests.join(held, "user_id", "left").withColumn("want", F.greatest(F.lit(0), F.least("batch", F.lit(cap) - F.coalesce("held", F.lit(0)))))
    by_order = Window.partitionBy(F.lit(1)).orderBy("ord")
    until = wants.withColumn("hi", F.sum("want").over(by_order)).withColumn("lo", F.col("hi") - F.col("want"))
    total = wants.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0]
    open_rows = queue.where("claimed_by is null AND status = 'pending'").orderBy("review_id").limit(int(total))
    numbered = open_rows.select("review_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("review_id")).alias("n"))  # as many as were asked for
    return numbered.join(F.broadcast(until), (F.col("n") > F.col("lo")) & (F.col("n") <= F.col("hi"))).select("review_id", "user_id")


def enqueue(queue: DataFrame, offered: DataFrame) -> DataFrame:
    """The queue after e-mail candidates (company_id, review_id, values, preferred) are enqueued.

    New: pending, with the preferred candidate or the first. Existing: the candidates are replaced and
    the status stays; a human choice stays only while it is a candidate.
    """
    fallback = F.when(F.coalesce(F.array_contains("values", F.col("preferred")), F.lit(False)), F.col("preferred")).otherwise(F.get("values", 0))
    new = offered.select("review_id", F.col("company_id").alias("n_company"), F.col("values"), fallback.alias("fallback"))
    both = queue.join(new, "review_id", "full_outer")
    touched, old = F.col("n_company").isNotNull(), F.col("status").isNotNull()
    human = F.coalesce("selected_by_human", F.lit(False))
    stays = human & F.coalesce(F.array_contains("values", F.col("selected")), F.lit(False))
    changed = {
        "company_id": F.coalesce("company_id", "n_company"),
        "field": F.coalesce("field", F.lit("email")),
        "status": F.coalesce("status", F.lit("pending")),
        "candidates": F.when(touched, F.to_json("values")).otherwise(F.col("candidates")),
        "selected": F.when(~touched, F.col("selected")).when(old & stays, F.col("selected")).otherwise(F.col("fallback")),
        "selected_by_human": F.when(~touched, F.col("selected_by_human")).otherwise(old & stays),
    }
    return both.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns))


def my_work(queue: DataFrame, company: DataFrame, contact: DataFrame, validation: DataFrame) -> DataFrame:
    """user_id and the pending items that each user holds, as items shows them, with their place in the order of name and id.

    What a user holds stays whatever filters say; rows whose company is gone are left out."""
    held = queue.where("claimed_by is not null and status = 'pending'").join(company.select("company_id"), "company_id", "left_semi")
    of = held.select("review_id", F.col("claimed_by").alias("user_id"), "company_id").join(company.select("company_id", "name"), "company_id").drop("company_id")
    rows = items(held.select(*queue.columns), company, contact, validation).join(of, "review_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("name", "review_id"))).drop("name")


# Fixed value: what an address that a person types must look like.
TYPED_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def register_typed(queue: DataFrame, contact: DataFrame, typed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue, contact, answers) after people typed addresses in: typed holds review_id, email and seq, the order (unique).

    An address that is no candidate of its row yet becomes the last one and a contact of the company, with the
    role ir, method manual and confidence 1, unless the company has that contact. answers: seq and registered: null where the
    address is malformed, false where the row is unknown or has the candidate already.
    """
    plain = typed.select("seq", "review_id", F.trim("email").alias("email"))
    good = plain.where(F.coalesce(F.col("email").rlike(TYPED_EMAIL), F.lit(False)))
    first = good.groupBy("review_id", "email").agg(F.min("seq").alias("seq"))  # a later one finds it there
    known = first.join(queue.select("review_id", "company_id", parse_candidates(F.col("candidates")).alias("_values")), "review_id")
    new = known.where(~F.array_contains("_values", F.col("email")))
    more = new.groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "email"))), lambda x: x["email"]).alias("_more"))
    longer = F.to_json(F.concat(parse_candidates(F.col("candidates")), F.col("_more")))
    after = queue.join(more, "review_id", "left").select(*(F.when(F.col("_more").isNotNull(), longer).otherwise(F.col(c)).alias(c) if c == "candidates" else F.col(c) for c in queue.columns))
    made = new.select("company_id", F.col("email").alias("value")).distinct().withColumn("contact_id", identity.contact_id(F.col("company_id"), F.lit("email"), F.col("value")))
    made = made.join(contact.select("contact_id"), "contact_id", "left_anti")
    fixed = {"type": F.lit("email"), "role": F.lit("ir"), "extract_method": F.lit("manual"), "confidence": F.lit(1.0)}
    rows = made.select(*(F.col(c) if c in made.columns else fixed.get(c, F.lit(None)).cast(contact.schema[c].dataType).alias(c) for c in contact.columns))
    answers = plain.join(new.select("seq", F.lit(True).alias("_new")), "seq", "left")
    valid = F.coalesce(F.col("email").rlike(TYPED_EMAIL), F.lit(False))
    return after, contact.unionByName(rows), answers.select("seq", F.when(valid, F.coalesce("_new", F.lit(False))).alias("registered"))


def decide(queue: DataFrame, decisions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(queue, audit rows) after decisions (review_id, status, user_id, user_name, selected).

    A decision is refused, and changes nothing, where its status is none, another user holds the row, or its selection
    is not among the candidates. A terminal status releases the claim. Who decided, and when, is noted, and an audit
    row written, for decisions of a user; others only change the status. Decisions must name distinct rows.
    """
    d = decisions.select(
        "review_id", F.col("status").alias("d_status"), F.col("user_id").alias("d_user"), F.col("user_name").alias("d_name"), F.col("selected").alias("d_selected")
    )
    joined = queue.join(d, "review_id", "left")
    own = F.col("claimed_by").isNull() | F.coalesce(F.col("claimed_by") == F.col("d_user"), F.lit(False))
    offered = F.col("d_selected").isNull() | F.coalesce(F.array_contains(parse_candidates(F.col("candidates")), F.col("d_selected")), F.lit(False))
    marked = joined.withColumn("_taken", F.coalesce(F.col("d_status").isin(*STATUSES), F.lit(False)) & own & offered)
    taken, terminal = F.col("_taken"), F.col("d_status").isin("confirmed", "rejected")
    chosen, by_user = taken & F.col("d_selected").isNotNull(), taken & (F.col("d_user").isNotNull() | F.col("d_name").isNotNull())
    set_if = lambda when, value, old: F.when(when, value).otherwise(F.col(old))
    changed = {
        "status": set_if(taken, F.col("d_status"), "status"),
        "claimed_by": set_if(taken & terminal, F.lit(None), "claimed_by"),
        "selected": set_if(chosen, F.col("d_selected"), "selected"),
        "selected_by_human": set_if(chosen, F.lit(True), "selected_by_human"),
    }
    noted = {"claimed_at": (taken & terminal, F.lit(None)), "assignee": (by_user, F.col("d_name")), "assignee_id": (by_user, F.col("d_user")), "reviewed_at": (by_user, at)}
    changed |= {c: set_if(when, value, c) for c, (when, value) in noted.items() if c in queue.columns}
    after = marked.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns))
    audit = marked.where(by_user).select(
        "review_id", F.col("d_user").alias("actor_id"), F.coalesce("d_name", F.lit("")).alias("actor_name"), F.col("d_status").alias("action"),
        F.coalesce("d_selected", "selected").alias("selected"), at.alias("ts"),
    )
    return after, audit


def set_status(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue after decisions (review_id, status, user_id, selected); see decide."""
    named = decisions if "user_name" in decisions.columns else decisions.withColumn("user_name", F.lit(None).cast("string"))
    return decide(queue, named, F.current_timestamp())[0]


def reclaim(queue: DataFrame, user_id: str) -> tuple[DataFrame, DataFrame]:
    """(queue, audit rows): all pending rows that a user holds are released."""
    theirs = (F.col("claimed_by") == user_id) & (F.col("status") == "pending")
    released = F.coalesce(theirs, F.lit(False))
    after = queue.withColumn("claimed_by", F.when(released, F.lit(None)).otherwise(F.col("claimed_by")))
    return after, queue.where(released).select("review_id", F.lit("reclaim").alias("action"))
