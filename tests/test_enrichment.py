"""Contacts of companies and their domains on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators import enrichment


def test_resolve(spark):
    companies = spark.createDataFrame([(1, "SK hynix Inc.", "KR"), (2, "ABC", "US"), (3, "Hanwha ETF", "KR"), (4, "Samsung Electronics", "KR")], "key int, name string, country string")
    hits = spark.createDataFrame(
        [(1, 1, "https://skhynix.com"), (1, 2, "https://www.skhynix.co.kr/x"), (2, 1, "https://abcnews.com"), (3, 1, "https://hanwha.com"), (4, 1, "https://unisamsung.com"), (4, 2, "https://samsung.com")],
        "key int, rank int, link string",
    )
    assert {r.key: r.domain for r in enrichment.resolve_domains(companies, hits).collect()} == {1: "skhynix.co.kr", 4: "samsung.com"}


def test_contacts_over_pages(spark):
    rows = [
        ("a", 1, "https://a.com/", "write ir@a.com"), ("a", 2, "https://a.com/contact", '<a href="mailto:ir@a.com">x</a><a href="tel:02-1234-5678">t</a><form action="/contact"><textarea></textarea></form>'),
        ("b", 3, "https://b.com/contact", "nothing"), ("c", 4, "https://c.com/", None),
    ]
    df = spark.createDataFrame(rows, "company string, page_id int, url string, html string")
    got = {r.company: r for r in enrichment.escalate(enrichment.company_contacts(df)).collect()}
    assert (got["a"].emails, got["a"].phones, got["a"].form, got["a"].fallback) == (["ir@a.com"], ["02-1234-5678"], "https://a.com/contact", False)
    assert (got["b"].emails, got["b"].form, got["b"].fallback) == ([], "https://b.com/contact", True)
    assert (got["c"].emails, got["c"].form, got["c"].fallback) == ([], None, False)


def test_variants_and_finders(spark):
    urls = ["https://www.x.com/a", "https://x.com/a", "https://m.x.com", "https://a.b.x.com"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(enrichment.url_variants(F.col("u"))).collect()] == [
        ["https://www.x.com/a", "https://m.x.com/a", "https://x.com/a"], ["https://x.com/a", "https://m.x.com/a"], ["https://m.x.com"], ["https://a.b.x.com"],
    ]
    found = spark.createDataFrame([(1, '{"data": {"emails": [{"value": "a@b.c"}, {"value": ""}]}}'), (2, '{"people": [{"email": "email_not_unlocked@x"}, {"email": "d@e.f"}]}'), (3, "broken")], "id int, payload string")
    assert sorted(map(tuple, enrichment.finder_addresses(found).collect())) == [(1, "a@b.c"), (2, "d@e.f")]
