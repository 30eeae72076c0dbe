"""One commit over several tables: all or nothing, once, and refused where another was quicker."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollcall.functions import identity
from rollcall.operators.versions import Book, Conflict, save_leads

def _at():
    return F.lit("2024-05-01").cast("timestamp")


CONTACT = "array<struct<type: string, value: string, role: string, method: string, confidence: double, status: string, mx: boolean, domain_match: boolean, smtp: boolean, provider: string>>"
LEAD = f"key string, name string, country string, industry string, homepage string, is_active boolean, site_alive boolean, confidence double, domain string, email string, contacts {CONTACT}"
EMPTY = {
    "ledger": "key string, name string, country string, domain string, first_seen timestamp, last_crawled_at timestamp",
    "company": "company_id string, key string, name string, country string, industry string, homepage string, is_active boolean, site_alive boolean, existence_confidence double, listed string",
    "contact": "contact_id string, company_id string, type string, value string, role string, method string, confidence double",
    "validation": "contact_id string, status string, mx boolean, domain_match boolean, smtp boolean, provider string, checked_at timestamp",
    "queue": "review_id string, company_id string, field string, status string, candidates string, selected string, selected_by_human boolean, claimed_by string",
}


def _mail(value, status=None):
    return ("email", value, "ir", "static", 0.9, status, True if status else None, None, None, None)


def _book(spark, path) -> Book:
    book = Book(spark, str(path))
    assert book.commit({n: spark.createDataFrame([], s) for n, s in EMPTY.items()}, 0) == 1
    return book


def _lead(spark, key, name, contacts, email=None):
    return spark.createDataFrame([(key, name, "KR", "은행", None, True, True, 0.7, "a.com", email, contacts)], LEAD)


def test_leads_are_saved_whole_and_once(spark, tmp_path):
    book = _book(spark, tmp_path / "book")
    phone = ("phone", "+82", "general", "static", 0.8, None, None, None, None, None)
    first = save_leads(_lead(spark, "dom:a.com", "A" * 600, [_mail("ir@a.com", "valid"), _mail("info@a.com", "risky"), phone], "info@a.com"), _at())
    assert book.change("run1", first) == 2
    assert book.change("run1", first) == 2 and book.manifest()["batches"] == ["run1"]
    cid = spark.range(1).select(identity.company_id(F.lit("dom:a.com"))).first()[0]
    assert [(r.company_id, len(r.name), r.existence_confidence) for r in book.read("company").collect()] == [(cid, 512, 0.7)]
    queue = book.read("queue").first()
    assert (queue.candidates, queue.selected, queue.status) == ('["ir@a.com","info@a.com"]', "info@a.com", "pending")
    assert book.read("ledger").first().key == "dom:a.com" and book.read("contact").count() == 3
    ids = {r.value: r.contact_id for r in book.read("contact").collect()}
    # a person decides, and a later run finds other addresses
    decided = book.read("queue").withColumns({"status": F.lit("confirmed"), "selected": F.lit("ir@a.com"), "selected_by_human": F.lit(True)})
    assert book.commit({"queue": decided}, 2) == 3
    second = save_leads(_lead(spark, "dom:a.com", "B", [_mail("new@a.com"), _mail("ir@a.com")], "new@a.com"), _at())
    assert book.change("run2", second) == 4
    assert {r.value: r.contact_id for r in book.read("contact").collect()}["ir@a.com"] == ids["ir@a.com"]
    assert {r.value for r in book.read("contact").collect()} == {"new@a.com", "ir@a.com"}
    assert [(r.contact_id, r.status) for r in book.read("validation").collect()] == [(ids["ir@a.com"], "valid")]
    queue = book.read("queue").first()
    assert (queue.status, queue.selected, queue.candidates) == ("confirmed", "ir@a.com", '["new@a.com","ir@a.com"]')
    assert book.read("contact", 2).count() == 3 and book.read("company", 1).count() == 0
    # a lead without contacts takes them away, and stays in the queue
    assert book.change("run3", save_leads(_lead(spark, "dom:a.com", "B", []), _at())) == 5
    assert book.read("contact").count() == book.read("validation").count() == 0
    assert (book.read("queue").first().candidates, book.read("ledger").count()) == ("[]", 1)


def test_a_job_that_dies_leaves_the_old_version(spark, tmp_path):
    book = _book(spark, tmp_path / "book")
    broken = F.udf(lambda x: 1 / 0, "int")(F.col("key"))
    rows = spark.createDataFrame([("k",)], "key string")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        book.commit({"ledger": rows.withColumn("x", F.lit(1)), "company": rows.withColumn("x", broken)}, 1)
    assert book.version() == 1 and book.read("ledger").columns == [f.split()[0] for f in EMPTY["ledger"].split(", ")]


def test_the_second_of_two_commits_is_refused(spark, tmp_path):
    book = _book(spark, tmp_path / "book")
    row = spark.createDataFrame([("k",)], "key string")
    assert book.commit({"ledger": row}, 1, "x") == 2
    with pytest.raises(Conflict):
        book.commit({"ledger": row.union(row)}, 1, "y")
    assert book.read("ledger").count() == 1
    seen = []

    def slow(tables):
        if not seen:  # another commit comes first
            seen.append(book.commit({"company": row}, 2, "z"))
        return {"ledger": tables["ledger"].union(row)}

    assert book.change("w", slow) == 4
    assert book.read("ledger").count() == 2 and book.read("company").count() == 1 and book.manifest()["batches"] == ["x", "z", "w"]
