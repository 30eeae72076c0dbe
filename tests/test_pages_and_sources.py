"""Pages, captured registers, ledger changes and streams on literal rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rollcall.functions import industry, pages
from rollcall.functions.dimensions import KSIC, SIC
from rollcall.operators import ledger, reporting
from rollcall.sources import registers, scans
from rollcall.streaming import incremental


def _pages(spark, *html):
    return spark.createDataFrame([(n, "https://www.acme.com/en/", h) for n, h in enumerate(html)], "page_id int, url string, html string")


def test_links_stop_in_page_order(spark):
    html = "".join(f'<a href="/contact/{n}">x</a>' for n in range(3)) + '<a href="/ir">IR</a><a href="https://other.com/ir">o</a><a href="/contact/0">again</a><a href="/a.pdf">ir</a>'
    df = _pages(spark, html)
    got = [r.link for r in pages.candidate_links(df, 20).orderBy("ord").collect()]
    assert got == ["https://www.acme.com/ir"] + [f"https://www.acme.com/contact/{n}" for n in range(3)]
    assert [r.link for r in pages.candidate_links(df, 2).orderBy("ord").collect()] == ["https://www.acme.com/contact/0", "https://www.acme.com/contact/1"]


def test_images(spark):
    df = _pages(spark, '<img src="/logo.png"><img src="data:x"><img src="b.gif" alt="이메일"><img src="/c.svg">')
    assert [r.link for r in pages.candidate_images(df).orderBy("ord").collect()] == ["https://www.acme.com/en/b.gif", "https://www.acme.com/logo.png"]


def test_forms(spark):
    df = _pages(
        spark, '<form action="/contact"><input></form><form action="/inquiry"><textarea></textarea></form>', '<form class="contact"><input type="password"></form>',
        '<iframe src="https://a.typeform.com/x"></iframe>', '<form action="/newsletter/contact"><input type="email"></form>', '<iframe src="https://ads.com/?typeform.com"></iframe>', "<form>문의 <input></form>",
    )
    got = {r.page_id: (r.form_url, r.confidence) for r in pages.page_form(df).collect()}
    assert got == {0: ("https://www.acme.com/inquiry", 60), 2: ("https://a.typeform.com/x", 70), 5: ("https://www.acme.com/en/", 45)}


def test_emails_first_pass_counts(spark):
    df = _pages(spark, '<a href="mailto:IR@acme.com?x">IR@acme.com</a> sales (at) acme (dot) com hr@acme.com <img src="a@2x.png"> <!-- hidden@acme.com -->')
    assert {(r.value, r.confidence) for r in pages.page_emails(df).collect()} == {("ir@acme.com", 9), ("sales@acme.com", 6), ("hidden@acme.com", 4)}


def test_longest_unambiguous_prefix(spark):
    codes = spark.createDataFrame([(1, "7372"), (2, "49"), (3, None), (4, "2834"), (5, ""), (6, "99")], "id int, code string")
    assert {r.id: r.label for r in industry.label_from_code(codes, SIC, "id").collect()} == {1: "IT·소프트웨어", 2: None, 3: None, 4: "제약·바이오", 5: None, 6: None}
    k = spark.createDataFrame([(1, "49"), (2, "58"), (3, "12")], "id int, code string")
    assert {r.id: r.label for r in industry.label_from_code(k, KSIC, "id").collect()} == {1: None, 2: "IT·소프트웨어", 3: None}


def test_captured_registers(spark):
    def one(payload):
        return spark.createDataFrame([(json.dumps(payload),), ("broken",)], "payload string")

    t = one({"fields": ["cik", "name", "ticker", "exchange"], "data": [[1, "A", "a", "NYSE"], ["x", "B", "b", "Nasdaq"], [3, "C", "c", None], [4, "D", "d", "LSE"]]})
    # a null exchange reads as a name that is none of the known ones; only a row without the field has none
    assert sorted(tuple(r) for r in registers.edgar_tickers(t).select("cik", "name", "exchange").collect()) == [(1, "A", "nyse")]
    c = one({"items": [{"company_number": "1", "company_name": "N", "company_status": "active", "sic_codes": ["99", "41100"], "registered_office_address": {"address_line_1": "1 St", "postal_code": " "}}, {"company_number": "2", "company_name": "M", "company_status": "dissolved"}]})
    assert [tuple(r) for r in registers.companies_house_items(c).select("registry_id", "name", "address", "label").collect()] == [("1", "N", "1 St", "건설·엔지니어링")]
    g = one({"data": [{"id": "L1", "attributes": {"entity": {"legalName": {"name": "G"}, "status": "active", "legalAddress": {"country": "DE"}}}}, {"id": "L2", "attributes": {"entity": {"status": "INACTIVE"}}}]})
    assert [tuple(r) for r in registers.gleif_records(g).select("registry_id", "name", "country").collect()] == [("L1", "G", "DE")]
    b = lambda q, n, h: {"item": {"value": f"http://w/entity/{q}"}, "itemLabel": {"value": n}, "hqLabel": {"value": h}}
    w = one({"results": {"bindings": [b("Q1", "One", "Q9"), b("Q1", "Uno", "Rome"), b("Q2", "Q2", "x"), b("P3", "x", "y")]}})
    assert [tuple(r) for r in registers.wikidata_bindings(w).orderBy("registry_id").select("registry_id", "name", "headquarters").collect()] == [("P3", "x", "y"), ("Q1", "One", None)]
    o = one({"results": {"companies": [{"company": {"name": "O", "company_number": "7", "jurisdiction_code": "gb"}}, {"company": {"name": "P", "company_number": "8", "jurisdiction_code": "gb", "inactive": True}}]}})
    assert [tuple(r) for r in registers.opencorporates_companies(o).select("registry_id", "name").collect()] == [("gb/7", "O")]
    s = one({"data": {"prices": [{"type": "stocks", "nc": "D05", "n": "DBS"}, {"type": "bonds", "nc": "B1", "n": "x"}]}})
    assert [tuple(r) for r in registers.sgx_rows(s).collect()] == [("D05", "DBS")]
    listing = spark.createDataFrame([("<td>AA</td><td>A &amp; B</td><td>AA</td><td>again</td>",)], "html string")
    assert [tuple(r) for r in registers.listing_rows(listing, "<td>([A-Z]+)</td><td>([^<]*)</td>").collect()] == [("AA", "A & B")]


def test_import_and_search(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("﻿업체명,국가,사이트,기타\nACME,US,acme.com,1\n,,,\n()(),KR,,2\n삼성,대한민국,,3\n", encoding="utf-8")
    assert sorted(r.key for r in registers.read_import(spark, str(path)).collect()) == ["dom:acme.com", "name:kr:삼성"]
    # a page of nothing but domains that the query had before has no candidates, and so doesn't stop it
    hits = [(0, 1, 1, "Acme | Home", "https://acme.com"), (0, 1, 2, "Gov", "https://x.gov"), (0, 2, 1, "Acme", "https://www.acme.com/a"), (0, 3, 1, "Late", "https://late.com"), (1, 1, 1, "Beta - official", "https://beta.io")]
    df = spark.createDataFrame(hits, "query int, page int, rank int, title string, link string").withColumn("segment", F.lit("s"))
    none = spark.createDataFrame([], "domain string")
    assert sorted((r.domain, r.name) for r in scans.crawl_search(df, none).collect()) == [("acme.com", "Acme"), ("beta.io", "Beta"), ("late.com", "Late")]


def test_blank_runs_stop_a_sheet(spark):
    rows = [("s", n, "" if 3 <= n < 6 or n == 1 else f"v{n}") for n in range(9)]
    df = spark.createDataFrame(rows, "sheet string, line int, v string")
    assert sorted(r.line for r in ledger.blank_runs_stop(df, "sheet", "line", F.col("v") == "", most=3).collect()) == [0, 2]


def test_ledger_changes_repeat(spark):
    old = spark.createDataFrame([("a", "A", None)], "key string, name string, last_crawled_at timestamp")
    new = spark.createDataFrame([("a", "other"), ("b", "B")], "key string, name string")
    at = F.lit("2024-01-01").cast("timestamp")
    once = ledger.save_discovered(old, new, at)
    assert sorted((r.key, r.name) for r in once.collect()) == [("a", "A"), ("b", "B")]
    assert sorted(map(tuple, ledger.save_discovered(once, new, at).collect())) == sorted(map(tuple, once.collect()))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(n, ["serper", "hunter", "nobody"][n % 3], n % 4 - 1) for n in range(40)]
    events = spark.createDataFrame(rows, "event_id long, provider string, units int").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") * 86400 * 2))
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    incremental.monthly_costs(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = reporting.priced(events).groupBy("month", "provider").agg(F.sum("cost"), F.sum("units")).collect()
    got = incremental.read_monthly_costs(spark, str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_of_discoveries(spark, tmp_path):
    spark.createDataFrame([("k0", "old", 0)], "key string, name string, seq long").write.parquet(str(tmp_path / "ledger" / "batch=-1"))
    found = spark.createDataFrame([(f"k{n % 4}", f"n{n}", n) for n in range(12)], "key string, name string, seq long")
    for lo in (0, 6):
        found.where(f"seq >= {lo} AND seq < {lo + 6}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.new_companies(stream, str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination(120)
    keys = [r.key for r in spark.read.parquet(str(tmp_path / "ledger")).collect()]
    assert sorted(keys) == ["k0", "k1", "k2", "k3"]


def test_windows_of_failures(spark):
    df = spark.createDataFrame([("u", 60), ("u", 120), ("v", 60)], "user_id string, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    assert max(r.n for r in incremental.failures_per_window(df).collect()) == 2


def test_pages_that_never_close_anything(spark):
    """Work in proportion to the page, and the meaning that a browser gives it."""
    import time

    html = ["<script>" * 125_000, "<a href=x" * 100_000, "<!--" * 250_000, "<" * 1_000_000, "<form><input>" * 70_000]
    df = _pages(spark, *html).cache()
    df.count()
    began = time.time()
    assert [r.n for r in df.select("page_id", F.length(pages.visible_text(F.col("html"))).alias("n")).orderBy("page_id").collect()] == [0, 900_000, 1_000_000, 1_000_000, 0]
    assert pages.candidate_links(df).count() == 0 and pages.page_form(df).count() == 0
    assert time.time() - began < 60
    odd = _pages(
        spark, '<!-- <a href="/contact">c</a> --><script>"<a href=/ir>"</script><a title="a>b" href=/ir?x=1&amp;y=2>ir</a>', "<a href='../../contact'>c</a><a href='./about#t'>a</a><a href='?ir'>q</a>",
        '<style><a href="/ir"></style><a data-href="/ir">n</a><a href="/x"><b>Contact', "<form action='/contact'><textarea name=a></textarea>",
    )
    links = {(r.page_id, r.link) for r in pages.candidate_links(odd).collect()}
    assert links == {(0, "https://www.acme.com/ir?x=1&y=2"), (1, "https://www.acme.com/contact"), (1, "https://www.acme.com/en/about#t"), (1, "https://www.acme.com/en/?ir"), (2, "https://www.acme.com/x")}
    assert [(r.page_id, r.form_url, r.confidence) for r in pages.page_form(odd).collect()] == [(3, "https://www.acme.com/contact", 60)]
