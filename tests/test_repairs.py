"""Rules of the ledger, the queue, exports and verification on small tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from rollcall.functions import verify
from rollcall.operators import golden, ledger, matching, queue, reporting
from rollcall.operators.components import connected_components
from rollcall.sources import registers


def _at():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


def test_merge_keeps_earlier_merges_and_names(spark):
    rows = [("a", "A", None, None, None, None), ("b", " b.com ", None, None, None, None), ("c", "", "b", "old", "u", "Kept C"), ("d", None, None, None, None, "Earlier D"), ("e", None, "d", "old", "u", None)]
    before = spark.createDataFrame([(k, d, o, m, u, n) for k, d, o, m, u, n in rows], "key string, domain string, duplicate_of string, merge_reason string, merged_by string, canonical_name string").withColumn("merged_at", F.lit(None).cast("timestamp"))
    merge = spark.createDataFrame([("a", "Golden", "g.com", ["b", "c"]), ("e", "No", "n.com", ["d"])], "survivor_key string, canonical_name string, canonical_domain string, absorbed_keys array<string>")
    once = golden.apply_golden(before, merge, "auto", _at())
    got = {r.key: r for r in once.collect()}
    assert (got["a"].duplicate_of, got["a"].canonical_name, got["a"].domain) == (None, "Golden", "A")
    assert (got["b"].duplicate_of, got["b"].merge_reason, got["b"].domain) == ("a", "auto", " b.com ")
    # c was a duplicate of b before: it is pointed at a, once, as a child and not as a row absorbed now
    assert (got["c"].duplicate_of, got["c"].merge_reason, got["c"].canonical_name) == ("a", "auto (rechained)", "Kept C")
    assert (got["d"].duplicate_of, got["d"].canonical_name, got["e"].duplicate_of, got["e"].merge_reason) == (None, "Earlier D", "d", "old")
    assert sorted(map(str, golden.apply_golden(once, merge, "auto", _at()).collect())) == sorted(map(str, once.collect()))


def test_decisions_are_refused_or_audited(spark):
    q = spark.createDataFrame(
        [("r1", "pending", "u1", '["a@x.com","b@x.com"]', "a@x.com", False), ("r2", "pending", None, '["a@x.com"]', None, False), ("r3", "pending", "u2", "[]", None, False), ("r4", "pending", None, None, None, False)],
        "review_id string, status string, claimed_by string, candidates string, selected string, selected_by_human boolean",
    ).withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    d = spark.createDataFrame([("r1", "confirmed", "u1", "Ann", "b@x.com"), ("r2", "confirmed", "u1", None, "z@x.com"), ("r3", "rejected", "u1", None, None), ("r4", "pending", None, None, None)], "review_id string, status string, user_id string, user_name string, selected string")
    after, audit = queue.decide(q, d, _at())
    got = {r.review_id: r for r in after.collect()}
    assert (got["r1"].status, got["r1"].claimed_by, got["r1"].selected, got["r1"].selected_by_human) == ("confirmed", None, "b@x.com", True) and got["r1"].reviewed_at
    assert (got["r2"].status, got["r2"].selected, got["r3"].status, got["r3"].claimed_by, got["r4"].reviewed_at) == ("pending", None, "pending", "u2", None)
    assert [(r.review_id, r.actor_id, r.actor_name, r.action, r.selected) for r in audit.collect()] == [("r1", "u1", "Ann", "confirmed", "b@x.com")]


def test_export_columns(spark):
    shape = "country string, name string, phone string, has_email boolean, email string, status string, has_form boolean, form_url string, homepage string, domain string, industry string, site_alive boolean"
    df = spark.createDataFrame(
        [("KR", "A", "1", True, "a@x", "valid", True, "f", "h", "d", "건설", True), ("KR", "B", None, False, None, None, True, "f", None, "d", "건설", False), ("KR", "C", None, True, "c@x", "risky", False, None, "", None, "건설", None)], shape
    )
    assert sorted(tuple(r) for r in reporting.export_rows(df).collect()) == [
        ("KR", "A", "1", "a@x", "f", "h", "", "", "건설", "O", "O", ""), ("KR", "B", "", "", "f", "d", "", "", "건설", "사이트 내 문의폼", "X", ""), ("KR", "C", "", "c@x", "X", "", "", "", "건설", "X", "X", ""),
    ]


def test_known_companies_stay_as_they_are(spark):
    old = spark.createDataFrame([("a", None, None)], "key string, name string, last_crawled_at timestamp")
    new = spark.createDataFrame([("a", "New"), ("b", "B")], "key string, name string")
    got = {r.key: r for r in ledger.save_discovered(old, new, _at()).collect()}
    assert got["a"].name is None and got["a"].last_crawled_at == got["b"].last_crawled_at == datetime.datetime(2024, 1, 2) and got["b"].name == "B"


def test_verification_rules(spark):
    rows = [("a@x.com", None, True), ("a@x.com", "localhost-", True), ("a@x.com", "www.x.com", True), ("bad", "x.com", True), ("a@x.com", "", False)]
    df = spark.createDataFrame(rows, "email string, dom string, mx boolean")
    none = F.lit("unknown")
    got = [r.v.status for r in df.select(verify.email_validation(F.col("email"), F.col("dom"), F.col("mx"), none, none).alias("v")).collect()]
    assert got == ["valid", "risky", "valid", "invalid", "invalid"]
    states = [(" Open", None), ("receivership", None), ("voluntary-arrangement", None), (None, None)]
    df = spark.createDataFrame(states, "st string, gone boolean")
    assert [r.v for r in df.select(verify.registry_status(F.lit("companies_house"), F.col("st"), F.col("gone"), F.lit("SC12")).alias("v")).collect()] == [True, False, None, None]
    assert df.limit(1).select(verify.registry_status(F.lit("companies_house"), F.lit("active"), F.col("gone"), F.lit("a/b")).alias("v")).first().v is None
    pages = [(0, "x"), (403, "x"), (200, "Just a moment..."), (200, "x" * 10), (200, "x" * 3000), (301, "x" * 3000)]
    df = spark.createDataFrame(pages, "code int, body string")
    assert [r.v for r in df.select(verify.response_verdict(F.col("code"), F.col("body")).alias("v")).collect()] == ["blocked", "blocked", "challenge", "challenge", "weak_ok", "weak_ok"]
    assert [r.v for r in df.select(verify.response_verdict(F.col("code"), F.col("body"), F.lit(True), bad_sizes=(3010,)).alias("v")).collect()] == ["blocked", "blocked", "challenge", "strong_ok", "challenge", "challenge"]


def test_titles_and_reports(spark):
    titles = [("Investor Relations :: Meritage Homes", "x.com", "Meritage Homes"), ("Home", "acme.com", "Acme"), ("투자정보 | LG Chem", "l.com", "LG Chem"), ("Coca-Cola - Official Site", "c.com", "Coca-Cola")]
    df = spark.createDataFrame(titles, "t string, d string, want string")
    assert all(r.got == r.want for r in df.select(registers.company_name(F.col("t"), F.col("d")).alias("got"), "want").collect())
    stats = spark.createDataFrame(
        [("2024-01-02", None, "", 3, 2, 2, 1, 1, 1, 1, 0, 1, {"mailto": 2, "api": 1}, {"KR": 3}, ["fix x"]), ("2024-01-03", "M", "plan", 0, 0, 0, 0, 0, 0, 0, 0, 0, None, None, None)],
        "date string, milestone string, next_plan string, total long, active long, with_email long, with_phone long, with_form long, valid long, risky long, invalid long, smtp_ok long, by_method map<string,long>, by_country map<string,long>, commits array<string>",
    )
    a, b = reporting.daily_reports(stats).collect()
    assert a.done == "리드 3건 처리(실존 2)\n이메일 확보 2(검증 valid 1/risky 1/invalid 0, SMTP확정 1)\n전화 1 · 문의폼만 1\n이메일 출처: api=1, mailto=2\n국가: KR=3\n커밋:\n- fix x"
    assert (a.status, a.issues, a.task_status, a.yesterday, a.today, a.blocker) == ("정상", "없음", "Done", "fix x", "리드 2건 이메일 검증·후속 보강", "없음")
    assert (b.status, b.issues, b.task_status, b.yesterday, b.today, b.blocker) == ("점검", "산출 지표 점검 필요", "점검", "리드 0건 처리", "plan", "발견 산출 0 — 소스 점검")


def test_inline_matches_within_a_run_and_the_cap(spark):
    new = spark.createDataFrame([("name:kr:acme tool", "Acme Tool", "KR", 1), ("name:kr:acme tools", "Acme Tools", "KR", 2), ("dom:x", "Acme Tool", "KR", 3)], "key string, name string, country string, ord int")
    old = spark.createDataFrame([("name:kr:acme toll", "Acme Toll", "KR "), ("dom:y", "Acme Tool", "KR")], "key string, name string, country string")
    got = {(r.key_a, r.key_b): r.tier for r in matching.inline_lexical(new, old, "ord").collect()}
    assert set(got) == {("name:kr:acme toll", "name:kr:acme tool"), ("name:kr:acme toll", "name:kr:acme tools"), ("name:kr:acme tool", "name:kr:acme tools")}
    # the second new row finds two rows in its block
    assert set(map(lambda r: (r.key_a, r.key_b), matching.inline_lexical(new, old, "ord", max_block=2).collect())) == {("name:kr:acme toll", "name:kr:acme tool")}


def test_hubs_are_looked_up_apart(spark, monkeypatch):
    from rollcall.operators import components

    monkeypatch.setattr(components, "HUB_EDGES", 5)
    edges = [(0, k) for k in range(1, 40)] + [(k, 99) for k in range(20, 60)] + [(200 + k, 201 + k) for k in range(15)] + [(500, 500), (7, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in [*range(60), 99]} == {0} and {got[200 + k] for k in range(16)} == {200} and got[500] == 500 and len(got) == 61 + 16 + 1
