"""Identity rules on literal rows."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollcall.functions import identity, mail, verify
from rollcall.functions.scores import token_set_tenths


def _map(spark, column, values):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    return [r.x for r in df.select("n", column(F.col("v")).alias("x")).orderBy("n").collect()]


def test_domains(spark):
    cases = {
        "https://www.Apple.com/ir": "apple.com", "http://ir.samsung.co.kr:8080/x?y": "samsung.co.kr", "user@host.example.org": "example.org", "localhost": None,
        "": None, None: None, "a.b.c.com": "c.com", "//x.go.jp": "x.go.jp", "www.foo_bar.com": "foo_bar.com", "10.1.2.3": "2.3", "http://[::1]/": None, "x.com.": "com.",
    }
    assert _map(spark, identity.registered_domain, list(cases)) == list(cases.values())


def test_names_and_numbers(spark):
    names = {"Acme, Inc.": "acme", "삼성물산 주식회사": "삼성물산", "Co & Co": "", "Ünited Ltd": "nited", None: "", "A-B c": "abc"}
    assert _map(spark, identity.normal_name, list(names)) == list(names.values())
    assert _map(spark, identity.normal_reg_no, ["124-81-00998", "1248100998", " - ", None, "AB 1"]) == ["1248100998", "1248100998", None, None, "ab1"]
    assert _map(spark, identity.normal_country, ["대한민국", " USA ", "Atlantis", None]) == ["kr", "us", "atlantis", ""]


def test_keys(spark):
    rows = [("DART", " 001 ", "x.com", "n", "KR"), (None, "1", "https://www.Apple.com/ir", "n", "US"), ("", "", None, "삼성물산", "대한민국"), (None, None, None, "()", "KR"), (None, None, None, "x" * 300, "KR")]
    df = spark.createDataFrame(rows, "r string, i string, d string, n string, c string")
    keys = [k.k for k in df.select(identity.canonical_key(*(F.col(c) for c in "ridnc")).alias("k")).collect()]
    assert keys[:4] == ["reg:dart:001", "dom:apple.com", "name:kr:삼성물산", None]
    assert len(keys[4]) == 255 and keys[4].startswith("name:kr:xxx")


def test_pair_id_is_symmetric(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string")
    assert len({r[0] for r in df.select(identity.pair_id(F.col("a"), F.col("b"))).collect()}) == 1


def _score(a: list[str], b: list[str]) -> int:
    """The definition, in plain Python."""
    if not a or not b:
        return 0
    i, x, y = (" ".join(sorted(s)) for s in (set(a) & set(b), set(a) - set(b), set(b) - set(a)))
    if i and (not x or not y):
        return 1000
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
        row = new
    g = 1 if i else 0

    def tenths(part: int, whole: int) -> int:
        q, r = divmod(1000 * part, whole)
        return q + (2 * r > whole or (2 * r == whole and q % 2 == 1))

    l1, l2 = len(i) + g + len(x), len(i) + g + len(y)
    best = [tenths(l1 + l2 - (len(x) + len(y) - 2 * row[-1]), l1 + l2)]
    if i:
        best += [tenths(2 * len(i), len(i) + l1), tenths(2 * len(i), len(i) + l2)]
    return max(best)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["ab", "abc", "bc", "hanwha", "systems", "x"]), max_size=4), st.lists(st.sampled_from(["ab", "acb", "bc", "hanwa", "system", "x"]), max_size=4)), min_size=1, max_size=20))
def test_scores(spark, pairs):
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "n int, a array<string>, b array<string>")
    got = [r.s for r in df.select("n", token_set_tenths(F.col("a"), F.col("b")).alias("s")).orderBy("n").collect()]
    assert got == [_score(a, b) for a, b in pairs]


def test_subset_scores_full(spark):
    df = spark.createDataFrame([(["hanwha"], ["hanwha", "systems"])], "a array<string>, b array<string>")
    assert df.select(token_set_tenths(F.col("a"), F.col("b"))).first()[0] == 1000


def test_mail(spark):
    roles = {"ir@x.com": "ir", "shirley@x.com": "general", "hr.ir@x.com": "ir", "recruit2@x.com": "hr", "express@x.com": "general", "pr-team@x.com": "press", "홍보팀@x.com": "press", "": "general", None: "general", "ir2024@x.com": "ir"}
    assert _map(spark, mail.role, list(roles)) == list(roles.values())
    junk = {"banner@2x-992.jpg": True, "a@example.com": True, "a@b.example.com": True, "a@acme.com": False, "x": False}
    assert _map(spark, mail.is_junk, list(junk)) == list(junk.values())
    assert _map(spark, mail.deobfuscate, ["info (at) acme [dot] com", "a＠b.c", "look at this"]) == ["info@acme.com", "a@b.c", "look at this"]
    text = "ir@firm.co"
    payload = "4a" + "".join(f"{b ^ 0x4A:02x}" for b in text.encode())
    assert _map(spark, mail.decode_protected, [payload, "zz", "4a", None, "4a1"]) == [text, None, None, None, None]


def test_format_and_verdicts(spark):
    assert _map(spark, verify.email_format_ok, ["a@b.c", "a@@b.c", "a@b", "ab.c"]) == [True, False, False, False]
    df = spark.createDataFrame([([550, 250], [False, False], "bad"), ([450, 250], [False, False], "ok"), ([250], [True], "unknown"), ([], [], "unknown")], "c array<int>, a array<boolean>, want string")
    for r in df.select(verify.smtp_verdict(F.col("c"), F.col("a")).alias("got"), "want").collect():
        assert r.got == r.want
    assert _map(spark, lambda c: verify.vendor_verdict(verify.ZEROBOUNCE, c), ["Valid", "spamtrap", "catch-all", "new word", None]) == ["ok", "bad", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize(("country", "address", "want"), [("KR", " 부산광역시 해운대구", "부산"), ("kr", "경기도 광주시", "경기"), ("대한민국", "서울 중구", None), ("KR", None, None), ("KR", "Seoul", None)])
def test_region(spark, country, address, want):
    df = spark.createDataFrame([(country, address)], "c string, a string")
    assert df.select(identity.korean_region(F.col("c"), F.col("a"))).first()[0] == want
