"""Scans, search crawls and domain resolution against loops that do one thing after another."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rollcall.operators import enrichment
from rollcall.sources import registers, scans


def _list_run(total, good, limit, cap, position):
    offset = position if 0 <= position < total else 0
    taken, scanned = [], 0
    for pos in range(offset, min(offset + limit, total)):
        scanned += 1
        if good(pos):
            taken.append(pos)
            if len(taken) >= cap:
                break
    return taken, 0 if offset + scanned >= total else offset + scanned


def test_list_scans_go_on_and_start_anew(spark):
    rng = random.Random(3)
    for total in (0, 1, 23, 60):
        rows = [(p, rng.random() < 0.4) for p in range(total)]
        universe = spark.createDataFrame(rows, "pos long, good boolean")
        cases = [(f"s{k}", rng.randint(1, 30)) for k in range(6)]
        segments = spark.createDataFrame(cases, "segment string, limit int")
        at = {"s0": 5, "s1": total + 4, "s2": -1, "other": 7}
        cursors = spark.createDataFrame(list(at.items()), "segment string, position long")
        for _ in range(4):
            taken, cursors = scans.scan_list(universe, segments, cursors, 3, lambda w: w.where("good"))
            got = {}
            for r in taken.collect():
                got.setdefault(r.segment, []).append(r.pos)
            after = {r.segment: r.position for r in cursors.collect()}
            for name, limit in cases:
                want, stop = _list_run(total, lambda p: rows[p][1], limit, 3, at.get(name, 0))
                assert sorted(got.get(name, [])) == want
                if total:
                    assert after[name] == stop
            assert after["other"] == 7
            at = after
            cursors = spark.createDataFrame(list(at.items()), "segment string, position long")


def test_two_runs_see_what_a_double_run_sees(spark):
    universe = spark.createDataFrame([(p, p % 3 == 0) for p in range(50)], "pos long, good boolean")
    none = spark.createDataFrame([], "segment string, position long")
    run = lambda limit, cap, cursors: scans.scan_list(universe, spark.createDataFrame([("s", limit)], "segment string, limit int"), cursors, cap, lambda w: w.where("good"))
    one, after = run(12, 4, none)
    two, last = run(12, 4, after)
    double, end = run(24, 8, none)
    assert sorted(r.pos for r in one.union(two).collect()) == sorted(r.pos for r in double.collect())
    assert last.collect() == end.collect()


def _page_run(pages, cap, most, by_items, position):
    """pages: start -> list of entries (good or not), or None for a failure."""
    at = max(position, 0 if by_items else 1)
    out, n, ended = [], 0, False
    while len(out) < cap and n < most:
        items = pages.get(at)
        if items is None:
            break
        if not items:
            ended = True
            break
        for k, good in enumerate(items):
            if good:
                out.append((at, k))
                if len(out) >= cap:
                    break
        at += len(items) if by_items else 1
        n += 1
    return out, 0 if ended else at


def test_page_scans_stop_at_failures_caps_and_ends(spark):
    rng = random.Random(9)
    for by_items in (True, False):
        books = {}
        for k in range(12):
            at, pages = 0 if by_items else 1, {}
            for _ in range(rng.randint(0, 9)):
                pages[at] = [rng.random() < 0.5 for _ in range(rng.randint(1, 6))]
                at += len(pages[at]) if by_items else 1
            pages[at] = []
            if len(pages) > 3 and k % 3 == 0:
                pages[sorted(pages)[2]] = None
            books[f"b{k}"] = pages
        sizes = spark.createDataFrame([(b, s, None if i is None else len(i)) for b, p in books.items() for s, i in p.items()], "segment string, start long, n long")
        items = spark.createDataFrame([(b, s, k) for b, p in books.items() for s, i in p.items() for k, good in enumerate(i or []) if good], "segment string, start long, at int")
        at = {b: rng.choice([0, 0, 1, 3]) for b in books}
        for _ in range(3):
            cursors = spark.createDataFrame(list(at.items()), "segment string, position long")
            taken, after = scans.scan_pages(sizes, items, cursors, 5, 3, by_items)
            got = {}
            for r in taken.collect():
                got.setdefault(r.segment, []).append((r.start, r.at))
            after = {r.segment: r.position for r in after.collect()}
            for b, pages in books.items():
                want, stop = _page_run(pages, 5, 3, by_items, at[b])
                assert (sorted(got.get(b, [])), after[b]) == (want, stop)
            at = after


def _query_run(pages, seen, cap, least):
    out, local, page = [], set(), 1
    while len(out) < cap and page in pages:
        candidates = new = 0
        for domain in pages[page]:
            if domain in local or domain.split(".")[-2] in scans.NO_COMPANY or domain in scans.BLOCKED:
                continue
            local.add(domain)
            candidates += 1
            if domain in seen:
                continue
            new += 1
            out.append(domain)
            if len(out) >= cap:
                break
        page += 1
        if len(out) >= cap or (candidates and new / candidates < least):
            break
    return out


def test_search_crawl_equals_a_loop(spark):
    rng = random.Random(4)
    names = [f"d{k}.com" for k in range(40)] + ["x.go.kr", "y.ac.uk", "facebook.com", "naver.com"]
    seen = set(names[:14])
    for cap in (3, 9, 100):
        want, rows = {}, []
        for s in range(4):
            merged: list[str] = []
            for q in range(3):
                pages = {p: [rng.choice(names) for _ in range(rng.randint(1, 7))] for p in range(1, rng.randint(2, 9)) if p != 5 or q}
                rows += [(s, q, p, k, f"https://www.{d}/x", None if k % 2 else f"{d} - Home") for p, ds in pages.items() for k, d in enumerate(ds)]
                merged += [d for d in _query_run(pages, seen, cap, 0.4) if d not in merged]
            want[s] = merged[:cap]
        hits = spark.createDataFrame(rows, "segment int, query int, page int, rank int, link string, title string")
        known = spark.createDataFrame([(d,) for d in seen], "domain string")
        got = {}
        for r in scans.crawl_search(hits, known, cap, 0.4).orderBy("segment", "position").collect():
            got.setdefault(r.segment, []).append(r.domain)
        assert {s: got.get(s, []) for s in want} == want


def test_quota_takes_the_first_that_can_be_resolved(spark):
    rows = [
        ("a", "Acme Group", None, "US", "acme.com"), ("b", "Some ETF", None, "US", None), ("c", "한글", None, "KR", None), ("d", "한글", "Hanmi Co", "KR", ""),
        ("e", "Beta Works", "X UCITS", "DE", None), ("f", "Gamma", None, "US", None), ("g", "Delta Inc", None, "US", None),
    ]
    companies = spark.createDataFrame(rows, "key string, name string, name_eng string, country string, domain string")
    links = [("d", "naver", 1, "hanmi.com"), ("d", "naver", 2, "hanmi.co.kr"), ("d", "default", 0, "hanmi.kr"), ("f", "default", 1, "gammaray.org"), ("f", "default", 0, "facebook.com"), ("g", "default", 1, "delta.com")]
    hits = spark.createDataFrame(links, "key string, provider string, rank int, link string")
    find = lambda *more: {r.key: (r.provider, r.domain) for r in enrichment.resolve_domains(companies, hits, "key", *more).collect()}
    assert find(2, ("default", "naver")) == {"d": ("naver", "hanmi.co.kr"), "f": ("default", "gammaray.org")}
    assert find(9, ("default",)) == {"d": ("default", "hanmi.kr"), "f": ("default", "gammaray.org"), "g": ("default", "delta.com")}
    assert find(9, ("naver",)) == {"d": ("naver", "hanmi.co.kr")} and find(0, ("default",)) == {}


def test_built_companies(spark):
    rows = [("삼성", "대한민국", "전체", "unknown", "1", "건설·엔지니어링", "서울시 중구", None), ("N", "KR", "전체", "listed", None, None, None, "부산"), ("B", "KR", "건설", "listed", "2", "은행", "경기도 성남", None)]
    df = spark.createDataFrame(rows, "name string, country string, industry string, seg_listed string, registry_id string, label string, address string, region string")
    got = {r.name: r for r in registers.built_companies(df, "dart", "dart").collect()}
    assert (got["삼성"].key, got["삼성"].industry, got["삼성"].segment, got["삼성"].region) == ("reg:dart:1", "건설·엔지니어링", "대한민국/전체/unknown", None)
    assert (got["N"].key, got["N"].industry, got["N"].listed, got["N"].region) == ("name:kr:n", "미분류", "listed", "부산")
    assert (got["B"].industry, got["B"].region) == ("건설", "경기")


def test_places_over_several_pages(spark):
    rows = [(p, a) for p in (2, 0, 5) for a in (7, 1, 4)]
    got = registers.in_place(spark.createDataFrame(rows, "page int, at int"), "page", "at").collect()
    assert [(r.page, r.at) for r in sorted(got, key=lambda r: r.pos)] == sorted(rows) and sorted(r.pos for r in got) == list(range(9))
    assert registers.imported(spark.createDataFrame([("A", "KR", "x@y.z")], "name string, `국가` string, `이메일 (IR 우선순위)` string")).select(F.struct("key", "email")).first()[0] == ("name:kr:a", "x@y.z")
