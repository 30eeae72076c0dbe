"""Typed addresses, held work and response profiles on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions.responses import Profile, _as_regex, fitting_profiles
from rollcall.operators import queue

QUEUE = "review_id string, company_id string, field string, status string, candidates string, claimed_by string, selected string, selected_by_human boolean"
CONTACT = "contact_id string, company_id string, type string, value string, role string, extract_method string, confidence double"


def test_typed_addresses_become_candidates_and_contacts(spark):
    q = spark.createDataFrame([("r1", "c1", "email", "pending", '["a@x.com"]', None, None, False), ("r2", "c1", "email", "pending", "broken", None, None, False)], QUEUE)
    c = spark.createDataFrame([], CONTACT)
    typed = [(1, "r1", " new@x.com "), (2, "r1", "a@x.com"), (3, "r1", "new@x.com"), (4, "r2", "new@x.com"), (5, "r2", "no address"), (6, "gone", "b@x.com"), (7, "r1", "b@x.com"), (8, "r1", None), (9, "r1", "a@b@c.de")]
    after, contacts, answers = queue.register_typed(q, c, spark.createDataFrame(typed, "seq int, review_id string, email string"))
    assert {r.review_id: r.candidates for r in after.collect()} == {"r1": '["a@x.com","new@x.com","b@x.com"]', "r2": '["new@x.com"]'}
    assert sorted((r.company_id, r.value, r.role, r.extract_method, r.confidence) for r in contacts.collect()) == [("c1", "b@x.com", "ir", "manual", 1.0), ("c1", "new@x.com", "ir", "manual", 1.0)]
    assert {r.seq: r.registered for r in answers.collect()} == {1: True, 2: False, 3: False, 4: True, 5: None, 6: False, 7: True, 8: None, 9: None}
    again, same, _ = queue.register_typed(after, contacts, spark.createDataFrame(typed, "seq int, review_id string, email string"))
    assert sorted(map(str, again.collect())) == sorted(map(str, after.collect())) and same.count() == 2


def test_held_work_has_an_order(spark):
    q = spark.createDataFrame([(f"r{n}", f"c{n % 3}", "email", "pending" if n != 4 else "confirmed", "[]", "u" if n else None, None, False) for n in range(7)] + [("x", "gone", "email", "pending", "[]", "u", None, False)], QUEUE)
    company = spark.createDataFrame([("c0", "Zeta", "unknown"), ("c1", "Alpha", "listed"), ("c2", "Beta", None)], "company_id string, name string, listed string")
    c, v = spark.createDataFrame([], CONTACT), spark.createDataFrame([], "contact_id string, status string, mx boolean, smtp boolean")
    got = queue.my_work(q, company, c, v).orderBy("place").collect()
    assert [(r.user_id, r.review_id, r.place) for r in got] == [("u", "r1", 1), ("u", "r2", 2), ("u", "r5", 3), ("u", "r3", 4), ("u", "r6", 5)]


def test_patterns_of_names():
    import fnmatch
    import re

    for pattern in ("x-a*", "gt[0-3]?", "[!a]b", "a.b", "a[", "[]x]", "^[^a]", "c++"):
        ours = re.compile(_as_regex(pattern).replace("(?s)", ""), re.S)
        for name in ("x-a", "x-ab", "gt1z", "gt4z", "cb", "ab", "axb", "a.b", "a[", "]", "x", "^^", "^a", "c++", "cc"):
            assert bool(ours.match(name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)


def test_profiles_are_ranked_and_stable(spark):
    profiles = [Profile("one", cookie=("sid",), body=("Denied",)), Profile("two", header=("X-Two-*",), server=("Two",), strong=3), Profile("_skip", body=("denied",))]
    rows = [(1, ["SID"], {"x-two-a": "1", "Server": "two/2"}, "access denied"), (2, None, None, None), (3, [], {"X-TWO-": ""}, ""), (4, ["sid"], {"x-two-b": "y"}, "")]
    df = spark.createDataFrame(rows, "id int, cookies array<string>, headers map<string,string>, body string")
    got = sorted((r.id, r["rank"], r.profile, r.confidence, list(r.signals)) for r in fitting_profiles(df, profiles).collect())
    assert got == [
        (1, 1, "one", 9, ["cookie:sid", "body:Denied"]), (1, 2, "two", 6, ["header:X-Two-*"] + ["server:Two"]), (2, 1, "unknown_challenge", 1, ["fallback"]), (3, 1, "two", 6, ["header:X-Two-*"]),
        (4, 1, "one", 6, ["cookie:sid"]), (4, 2, "two", 6, ["header:X-Two-*"]),
    ]
    assert fitting_profiles(df, profiles, least=9).where(F.col("profile") == "unknown_challenge").count() == 3
    assert fitting_profiles(df, []).count() == 4
