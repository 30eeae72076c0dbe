"""Queries over runs that go on where the last one stopped: streams, register scans, search crawls, domain resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import dimensions as D
from rollcall.functions import identity
from rollcall.operators import enrichment, matching
from rollcall.plans.captures import _packed
from rollcall.plans.catalogue import _NORM, _SCORED, _TOKENS, _domain, _in, _values, query
from rollcall.plans.views import table
from rollcall.session import materialise, new_folder
from rollcall.sources import registers, scans, workbooks
from rollcall.streaming import first_come, lexical_index

# ---------------------------------------------------------------- streams

_ARRIVED = """SELECT d.*, epoch_us(e.ts) * 1000 + d.page_id * 2 + (d.key LIKE 'q%')::INT AS seq FROM v_discovered d JOIN events e ON e.event_id = d.page_id * 2 + (d.key LIKE 'q%')::INT"""


def _arrived(spark, sf_dir) -> DataFrame:
    """Discovered companies in the order of the events that brought them."""
    d, e = table(spark, sf_dir, "v_discovered"), table(spark, sf_dir, "events")
    number = F.col("page_id") * 2 + F.col("key").startswith("q").cast("int")
    return d.join(e.select("event_id", "ts"), number == F.col("event_id")).withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + number).drop("event_id", "ts")


def _in_runs(rows: DataFrame, run, n: int = 3) -> None:
    """Hands the rows over in n portions of their order: each is added to a folder, and then the stream over it runs."""
    spark = rows.sparkSession
    rows, path = materialise(rows, "arrived"), new_folder(spark, "arrivals")
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    low, high = low or 0, high or 0
    for k in range(n):
        lo, hi = low + (high - low + 1) * k // n, low + (high - low + 1) * (k + 1) // n
        rows.where((F.col("seq") >= lo) & (F.col("seq") < hi)).write.mode("append").parquet(path)
        stream = run(spark.readStream.schema(rows.schema).parquet(path))
        stream.awaitTermination()
        if stream.exception() is not None:
            raise stream.exception()


_OLD = "key LIKE 'p%' AND page_id % 3 = 0"
_LEXICAL = (
    f"WITH {_NORM}, arrived AS ({_ARRIVED}), pre AS (SELECT n.key, a.seq, concat_ws('|', lower(n.country), left(array_to_string(tok, ''), 6)) AS block, NOT (a.{_OLD}) AS fresh FROM norm n JOIN arrived a ON a.key = n.key WHERE array_to_string(tok, '') <> ''), "
    "ranked AS (SELECT *, CASE WHEN fresh THEN row_number() OVER (PARTITION BY block, fresh ORDER BY seq) ELSE 0 END AS n, count(*) FILTER (NOT fresh) OVER (PARTITION BY block) AS held FROM pre), "
    "prs AS (SELECT DISTINCT least(n.key, o.key) AS a, greatest(n.key, o.key) AS b FROM ranked n JOIN ranked o USING (block) WHERE n.fresh AND n.n + n.held <= 40 AND n.key <> o.key AND o.n < n.n), "
    + _SCORED[_SCORED.index("  sided AS") :].strip()
)


@query(f"{_LEXICAL} SELECT concat('name:', a) AS key_a, concat('name:', b) AS key_b, name_score, CASE WHEN name_score >= 900 THEN 'lexical' ELSE 'shortlist' END AS tier FROM scored WHERE name_score >= 840", "v_discovered")
def q_lexical_stream(spark, sf_dir):
    """A ledger and three portions of arrivals; blocks over forty rows take no more."""
    rows = _arrived(spark, sf_dir).select("seq", F.concat(F.lit("name:"), "key").alias("key"), "name", "country", F.expr(_OLD).alias("old"))
    sink, checkpoint = new_folder(spark, "pairs"), new_folder(spark, "checkpoint")
    ledger = rows.where("old").select("key", "name", "country")
    _in_runs(rows.where("not old").drop("old"), lambda s: lexical_index.lexical_candidates(s, sink, checkpoint, ledger, max_block=40))
    return lexical_index.read_lexical_candidates(spark, sink)


@query(
    f"""WITH rows_ AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM (SELECT seq, nullif(array_to_string({_TOKENS.format(x='name')}, ''), '') AS k, {_domain('domain')} AS domain FROM ({_ARRIVED}))),
    pass_ AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ks, []::VARCHAR[] AS ds, NULL::BIGINT AS seq, NULL::VARCHAR AS k, NULL::VARCHAR AS domain
      UNION ALL SELECT r.i, CASE WHEN ok AND r.k IS NOT NULL THEN list_append(ks, r.k) ELSE ks END, CASE WHEN ok AND r.domain IS NOT NULL THEN list_append(ds, r.domain) ELSE ds END,
        CASE WHEN ok THEN r.seq END, r.k, r.domain
      FROM (SELECT p.ks, p.ds, r.*, NOT (r.k IS NOT NULL AND list_contains(p.ks, r.k)) AND NOT (r.domain IS NOT NULL AND list_contains(p.ds, r.domain)) AS ok FROM pass_ p JOIN rows_ r ON r.i = p.i + 1) r)
    SELECT seq, k AS key, domain FROM pass_ WHERE seq IS NOT NULL""",
    "v_discovered",
)
def q_first_come_stream(spark, sf_dir):
    """Three portions; the SQL is a sequential pass over all."""
    rows = _arrived(spark, sf_dir).select("seq", F.nullif(identity.normal_name(F.col("name")), F.lit("")).alias("key"), identity.registered_domain(F.col("domain")).alias("domain"))
    sink, checkpoint = new_folder(spark, "kept"), new_folder(spark, "checkpoint")
    _in_runs(rows, lambda s: first_come.first_come(s, sink, checkpoint))
    return first_come.read_first_come(spark, sink).select("seq", "key", "domain")


# ---------------------------------------------------------------- scans of lists

_PLACES = [("US", "건설"), ("US", "제조"), ("US", "전체"), ("US", "자동차"), ("US", "바이오")]
_CAP = 4


def _prefixes(table_of: dict[str, tuple[str, ...]]) -> list[tuple[str, str, list[str] | None]]:
    return [(c, i, list(table_of[i]) if i in table_of else None) for c, i in _PLACES]


def _run_sql(n: int, before: str) -> str:
    """The n-th run over a list: all (segment, pos, found or not), begin (segment, position) of the run before."""
    return f"""
    b{n} AS (SELECT s.segment, s.lim, CASE WHEN coalesce(c.position, 0) BETWEEN 0 AND t.total - 1 THEN coalesce(c.position, 0) ELSE 0 END AS o, t.total FROM seg s LEFT JOIN {before} c ON c.segment = s.segment, tot t),
    f{n} AS (SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY g.segment ORDER BY g.pos) AS r FROM good g JOIN b{n} b ON b.segment = g.segment AND g.pos >= b.o AND g.pos < b.o + b.lim) WHERE r <= {_CAP}),
    e{n} AS (SELECT b.segment, coalesce(max(CASE WHEN f.r = {_CAP} THEN f.pos + 1 END), least(any_value(b.o + b.lim), any_value(b.total))) AS stop, any_value(b.total) AS total FROM b{n} b LEFT JOIN f{n} f ON f.segment = b.segment GROUP BY b.segment),
    c{n} AS (SELECT segment, (CASE WHEN stop >= total THEN 0 ELSE stop END)::BIGINT AS position FROM e{n})"""


_SIC = "CASE c_custkey % 5 WHEN 0 THEN '1531' WHEN 1 THEN '2834' WHEN 2 THEN '7372' WHEN 3 THEN '2011' ELSE '' END"
_LIST = f"""WITH seg AS (SELECT concat(c, '/', i, '/unknown') AS segment, i AS industry, p, CASE WHEN p IS NULL THEN {_CAP} ELSE {10 * _CAP} END AS lim FROM (VALUES
      {', '.join(f"('{c}', '{i}', {p if p else 'NULL::VARCHAR[]'})" for c, i, p in _prefixes(D.SIC))}) t(c, i, p)),
    uni AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, CASE c_custkey % 3 WHEN 0 THEN 'nyse' WHEN 1 THEN '' ELSE 'otc' END AS board FROM customer WHERE c_custkey % 9 <> 4),
    tot AS (SELECT count(*) AS total FROM uni), begun AS (SELECT NULL::VARCHAR AS segment, NULL::BIGINT AS position WHERE false),
    good AS (SELECT s.segment, s.industry, u.* FROM seg s, uni u WHERE c_custkey % 7 <> 2 AND (s.p IS NULL OR len(list_filter(s.p, lambda x: starts_with({_SIC}, x))) > 0)),
    {_run_sql(1, 'begun')}, {_run_sql(2, 'c1')}, {_run_sql(3, 'c2')}"""
_LABEL = "CASE c_custkey % 5 WHEN 0 THEN '건설·엔지니어링' WHEN 1 THEN '제약·바이오' WHEN 2 THEN 'IT·소프트웨어' END"


def _edgar_runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Three runs over the same list: what each took, with its number, and the cursors after the last."""
    c = table(spark, sf_dir, "customer")
    entry = "to_json(array(cast(c_custkey AS string), c_name, CASE WHEN c_custkey % 9 = 4 THEN 'LSE' WHEN c_custkey % 3 = 0 THEN 'NYSE' WHEN c_custkey % 3 = 1 THEN '' ELSE 'OTC' END))"
    universe = registers.edgar_tickers(_packed(c, "c_custkey", entry, '{"fields":["cik","name","exchange"],"data":[', "]}"))
    universe = materialise(registers.in_place(universe, "page", "at").select("pos", "cik", "name", "exchange"), "universe")
    said = c.where("c_custkey % 7 <> 2").selectExpr("c_custkey AS cik", f"to_json(named_struct('sic', {_SIC}, 'website', concat('https://c', c_custkey, '.com'), 'addresses', named_struct('business', named_struct('city', 'X', 'stateOrCountry', 'CA')))) AS payload")
    segs = spark.createDataFrame([("/".join((c, i, "unknown")), c, i, "unknown", p) for c, i, p in _prefixes(D.SIC)], "segment string, country string, industry string, seg_listed string, prefixes array<string>")
    segs = segs.withColumn("limit", scans.scan_limit(_CAP, F.col("prefixes")))
    from rollcall.functions import industry

    def accept(window: DataFrame) -> DataFrame:
        found = registers.edgar_companies(window.withColumnRenamed("segment", "label_of"), said, F.col("prefixes"))
        codes = found.select(F.concat_ws("|", "label_of", "registry_id").alias("id"), F.col("sic").alias("code"))
        named = industry.label_from_code(codes, D.SIC, "id").withColumnRenamed("label", "code_label")
        return found.join(named, F.concat_ws("|", "label_of", "registry_id") == F.col("id")).withColumnRenamed("label_of", "run_of").withColumnRenamed("code_label", "label").withColumn("segment_key", F.col("run_of")).drop("id")

    segs = segs.withColumnRenamed("segment", "segment_key")
    cursors = spark.createDataFrame([], "segment_key string, position long")
    out = None
    for n in (1, 2, 3):
        taken, after = scans.scan_list(universe, segs, cursors, _CAP, lambda w: accept(w.withColumn("segment", F.col("segment_key")).drop("segment_key")), "segment_key")
        cursors = materialise(after, "cursors")
        some = registers.built_companies(taken, "edgar", "sec").withColumn("run", F.lit(n))
        out = some if out is None else out.unionByName(some)
    return out, cursors


@query(
    f"""{_LIST} SELECT run, segment, key, name, industry, listed, region FROM (
      {' UNION ALL '.join(f"SELECT {n} AS run, segment AS s, CASE board WHEN '' THEN segment ELSE replace(segment, '/unknown', CASE board WHEN 'otc' THEN '/unlisted' ELSE '/listed' END) END AS segment, concat('reg:sec:', c_custkey) AS key, c_name AS name, CASE WHEN industry <> '전체' THEN industry ELSE coalesce({_LABEL}, '{D.UNCLASSIFIED}') END AS industry, CASE board WHEN '' THEN 'unknown' WHEN 'otc' THEN 'unlisted' ELSE 'listed' END AS listed, 'CA' AS region FROM f{n}" for n in (1, 2, 3))})"""
)
def q_edgar_scan(spark, sf_dir):
    return _edgar_runs(spark, sf_dir)[0].select("run", "segment", "key", "name", "industry", "listed", "region")


@query(f"{_LIST} SELECT * FROM c3")
def q_edgar_cursors(spark, sf_dir):
    return _edgar_runs(spark, sf_dir)[1].withColumnRenamed("segment_key", "segment")


# ---------------------------------------------------------------- scans of pages

_SIZE, _PAGES_CAP, _MOST = 5, 8, 3
_ITEMS = f"""items AS (SELECT c_nationkey AS nation, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_custkey % 4 <> 0 AS good FROM customer),
    sheets AS (SELECT nation, i // {_SIZE} AS k, count(*) AS n, count(*) FILTER (good) AS f FROM items GROUP BY ALL),
    ends AS (SELECT nation, max(k) + 1 AS k, 0 AS n, 0 AS f FROM sheets GROUP BY nation),
    pgs AS (SELECT * FROM sheets WHERE NOT (nation % 7 = 3 AND k = 1) UNION ALL SELECT * FROM ends)"""


def _walk_sql(n: int, before: str, by_items: bool) -> str:
    """The n-th run over the pages: w holds (nation, spot, got, step, done, ended), one row for each step."""
    start, at = (f"p.k * {_SIZE}", 0) if by_items else ("p.k + 1", 1)
    return f"""
    w{n} AS (SELECT g.nation, greatest(coalesce(c.position, {at}), {at})::BIGINT AS spot, 0::BIGINT AS got, 0 AS step, false AS done, false AS ended, NULL::BIGINT AS k FROM (SELECT DISTINCT nation FROM items) g LEFT JOIN {before} c ON c.nation = g.nation
      UNION ALL SELECT w.nation, CASE WHEN coalesce(p.n, 0) = 0 THEN w.spot ELSE w.spot + {'p.n' if by_items else '1'} END, w.got + coalesce(p.f, 0), w.step + 1, p.n IS NULL OR p.n = 0 OR w.got + p.f >= {_PAGES_CAP}, coalesce(p.n = 0, false), CASE WHEN p.n > 0 THEN p.k END
      FROM w{n} w LEFT JOIN pgs p ON p.nation = w.nation AND {start} = w.spot WHERE NOT w.done AND w.step < {_MOST}),
    c{n} AS (SELECT nation, CASE WHEN arg_max(ended, step) THEN 0 ELSE arg_max(spot, step) END AS position FROM w{n} GROUP BY nation),
    t{n} AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY x.nation ORDER BY x.i) AS r FROM items x JOIN w{n} w ON w.nation = x.nation AND w.k = x.i // {_SIZE} WHERE good) WHERE r <= {_PAGES_CAP})"""


def _runs_sql(by_items: bool) -> str:
    return f"WITH RECURSIVE {_ITEMS}, begun AS (SELECT NULL::INT AS nation, NULL::BIGINT AS position WHERE false), {_walk_sql(1, 'begun', by_items)}, {_walk_sql(2, 'c1', by_items)}, {_walk_sql(3, 'c2', by_items)}"


def _page_runs(spark, sf_dir, by_items: bool) -> tuple[DataFrame, DataFrame]:
    """Each nation's customers as pages of five: one register counts entries, the other pages. A page of some nations fails."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1)
    c = c.withColumn("k", F.floor(F.col("i") / _SIZE))
    if by_items:
        entry = "to_json(named_struct('company_number', cast(c_custkey AS string), 'company_name', c_name, 'company_status', CASE WHEN c_custkey % 4 = 0 THEN 'dissolved' ELSE 'active' END))"
        head, path = '{"items":[', "$.items"
    else:
        entry = "to_json(named_struct('id', cast(c_custkey AS string), 'attributes', named_struct('entity', named_struct('legalName', named_struct('name', c_name), 'status', CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE 'ACTIVE' END))))"
        head, path = '{"data":[', "$.data"
    lists = c.groupBy(F.col("c_nationkey").alias("nation"), "k").agg(F.array_sort(F.collect_list(F.struct("i", F.expr(entry).alias("e")))).alias("s"))
    pages = lists.select("nation", "k", F.concat(F.lit(head), F.array_join(F.transform("s", lambda x: x["e"]), ","), F.lit("]}")).alias("payload"))
    pages = pages.withColumn("payload", F.when((F.col("nation") % 7 == 3) & (F.col("k") == 1), F.lit("<html>503")).otherwise(F.col("payload")))
    pages = pages.union(c.groupBy("c_nationkey").agg(F.max("k") + 1).select("*", F.lit(head + "]}")))
    pages = pages.select("nation", (F.col("k") * _SIZE if by_items else F.col("k") + 1).alias("start"), "payload")
    pages = materialise(pages, "pages")
    items = registers.companies_house_items(pages) if by_items else registers.gleif_records(pages)
    sizes, cursors, out = registers.page_sizes(pages, path), spark.createDataFrame([], "nation int, position long"), None
    for n in (1, 2, 3):
        taken, after = scans.scan_pages(sizes, items, cursors, _PAGES_CAP, _MOST, by_items, "nation")
        cursors = materialise(after, "cursors")
        some = taken.select("nation", "registry_id", "name", F.lit(n).alias("run"))
        out = some if out is None else out.unionByName(some)
    return out, cursors


_TAKEN = " UNION ALL ".join(f"SELECT nation, c_custkey::VARCHAR AS registry_id, c_name AS name, {n} AS run FROM t{n}" for n in (1, 2, 3))


@query(f"{_runs_sql(True)} {_TAKEN}")
def q_companies_house_scan(spark, sf_dir):
    return _page_runs(spark, sf_dir, True)[0]


@query(f"{_runs_sql(True)} SELECT nation, position FROM c3")
def q_companies_house_cursors(spark, sf_dir):
    return _page_runs(spark, sf_dir, True)[1]


@query(f"{_runs_sql(False)} {_TAKEN}")
def q_gleif_scan(spark, sf_dir):
    return _page_runs(spark, sf_dir, False)[0]


@query(f"{_runs_sql(False)} SELECT nation, position FROM c3")
def q_gleif_cursors(spark, sf_dir):
    return _page_runs(spark, sf_dir, False)[1]


# ---------------------------------------------------------------- search

_LINK = """CASE c_custkey % 11 WHEN 0 THEN 'https://www.naver.com/x' WHEN 1 THEN concat('https://x', c_custkey % 5, '.go.kr') WHEN 2 THEN concat('http://y', c_custkey % 5, '.or.jp/a') WHEN 3 THEN 'nothing' WHEN 4 THEN concat('https://z.ne', c_custkey % 3, '.com') ELSE concat('https://www.s', c_custkey % 97, '.com/ir') END"""
_FOUND = f"""hit AS (SELECT segment, query, CAST(floor(i / 4) + 1 AS INT) AS page, CAST(i % 4 AS INT) AS rank, link, title FROM (
      SELECT c_nationkey % 5 AS segment, c_custkey % 3 AS query, row_number() OVER (PARTITION BY c_nationkey % 5, c_custkey % 3 ORDER BY c_custkey) - 1 AS i, {_LINK} AS link,
        CASE c_custkey % 4 WHEN 0 THEN concat('Investor Relations | ', c_name) WHEN 1 THEN ' ' WHEN 2 THEN 'Home' ELSE c_name END AS title FROM customer)
      WHERE NOT (segment = 2 AND query = 1 AND floor(i / 4) = 2))"""
_SEEN = "SELECT DISTINCT concat('s', c_custkey % 97, '.com') AS domain FROM customer WHERE c_custkey % 97 % 3 = 0"


@query(
    f"""WITH RECURSIVE {_FOUND}, seen AS ({_SEEN}), dom AS (SELECT *, {_domain('link')} AS domain FROM hit WHERE page <= 6),
    c AS (SELECT d.*, s.domain IS NULL AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY segment, query, domain ORDER BY page, rank) AS nth FROM dom WHERE domain IS NOT NULL AND domain NOT IN ({_in(scans.BLOCKED)})
      AND NOT list_has_any(string_split(domain, '.'), [{_in(scans.NO_COMPANY)}])) d LEFT JOIN seen s ON s.domain = d.domain WHERE nth = 1),
    w AS (SELECT DISTINCT segment, query, 0 AS page, 0::BIGINT AS got, false AS done FROM hit
      UNION ALL SELECT w.segment, w.query, w.page + 1, w.got + n.fresh, w.got + n.fresh >= 7 OR (n.n > 0 AND n.fresh < 0.2 * n.n)
      FROM w JOIN (SELECT p.segment, p.query, p.page, count(c.domain) AS n, count(*) FILTER (c.fresh) AS fresh FROM (SELECT DISTINCT segment, query, page FROM dom) p LEFT JOIN c USING (segment, query, page) GROUP BY ALL) n
        ON n.segment = w.segment AND n.query = w.query AND n.page = w.page + 1 WHERE NOT w.done),
    q AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.segment, c.query ORDER BY c.page, rank) AS r FROM c JOIN w ON w.segment = c.segment AND w.query = c.query AND w.page = c.page WHERE fresh) WHERE r <= 7),
    u AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY query, page, rank)::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY segment, domain ORDER BY query, page, rank) AS k FROM q) WHERE k = 1)
    SELECT segment, domain, CASE WHEN trim(title) = '' THEN domain WHEN title = 'Home' THEN concat(upper(left(domain, 1)), substr(split_part(domain, '.', 1), 2)) ELSE replace(title, 'Investor Relations | ', '') END AS name, query, position FROM u WHERE position <= 7"""
)
def q_search_crawl(spark, sf_dir):
    """Queries of which some stop early, some reach the cap and one misses a page."""
    c = table(spark, sf_dir, "customer")
    hits = spark.sql("WITH " + _FOUND.replace("FROM customer", "FROM {customer}") + " SELECT * FROM hit", customer=c)
    seen = spark.sql(_SEEN.replace("FROM customer", "FROM {customer}"), customer=c)
    return scans.crawl_search(hits, seen, cap=7, pages=6)


# ---------------------------------------------------------------- workbooks


@query(
    """SELECT CASE WHEN c_custkey % 3 = 0 THEN concat('name:kr:', lower(replace(c_name, '#', ''))) ELSE concat('dom:c', c_custkey, '.com') END AS key, CASE WHEN c_custkey % 11 = 1 THEN '' ELSE c_name END AS name,
      CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('https://www.c', c_custkey, '.com/x?a=1&b=2') END AS domain, CASE WHEN c_custkey % 2 = 0 THEN concat('ir@c', c_custkey, '.com') END AS email
    FROM customer WHERE c_custkey % 11 <> 1 OR c_custkey % 3 <> 0"""
)
def q_workbook(spark, sf_dir):
    """Customers written to a workbook of four sheets, read again and imported."""
    c, path = table(spark, sf_dir, "customer"), new_folder(spark, "workbook") + ".xlsx"
    sheet = c.selectExpr(
        "c_custkey AS at", "CASE WHEN c_custkey % 11 = 1 THEN ' ' ELSE c_name END AS `업체명`", "'대한민국' AS `국가`", "CASE WHEN c_custkey % 3 <> 0 THEN concat('https://www.c', c_custkey, '.com/x?a=1&b=2') END AS `사이트`",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('ir@c', c_custkey, '.com') END AS `이메일`", "c_acctbal",
    )
    workbooks.write_workbook(sheet, path, "at", links=("사이트",), sheet_rows=max(1, -(-c.count() // 4)))
    return workbooks.read_imported(spark, path).select("key", "name", "domain", "email")
