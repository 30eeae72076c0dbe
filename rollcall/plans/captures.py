"""Queries over captured register responses and over small rules, with payloads built from the generated tables.

Each query packs rows of a table into the text that a register would send, some fifty to a response, and
reads them back through the operator; its SQL states the result from the table, by the rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import dimensions as D
from rollcall.functions import identity, industry, verify
from rollcall.operators import enrichment, ledger, outreach
from rollcall.plans.catalogue import NOW, _in, query
from rollcall.plans.views import table
from rollcall.sources import registers


def _packed(rows: DataFrame, key: str, entry: str, before: str, after: str) -> DataFrame:
    """page, payload: the JSON texts `entry` of about fifty rows each, in their order, between two texts."""
    made = rows.select((F.col(key) / 50).cast("long").alias("page"), F.struct(F.col(key).alias("k"), F.expr(entry).alias("e")).alias("s"))
    lists = made.groupBy("page").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lists.select("page", F.concat(F.lit(before), F.array_join(F.transform("s", lambda x: x["e"]), ","), F.lit(after)).alias("payload"))


def _with_noise(pages: DataFrame) -> DataFrame:
    """The pages, and some that hold nothing: no text, no JSON, JSON of other shapes, lists with nulls and of other things."""
    texts = (None, "", "broken", "{}", "[1, 2]", '{"items": null, "data": [null], "results": {"bindings": [null, {}], "companies": [null, {"company": null}, {}]}}', '{"items": "x", "data": 5, "results": []}')
    more = pages.sparkSession.createDataFrame([(-1 - n, t) for n, t in enumerate(texts)], "page long, payload string")
    return pages.select(F.col("page").cast("long").alias("page"), "payload").union(more)


_BOARD = "CASE s_suppkey % 6 WHEN 0 THEN 'Nasdaq' WHEN 1 THEN 'NYSE' WHEN 2 THEN 'OTC' WHEN 3 THEN 'CBOE' WHEN 4 THEN '' ELSE 'LSE' END"


def _universe(spark, sf_dir) -> DataFrame:
    """Column names in other cases; CIKs that are no numbers, null names and exchanges, rows that end early."""
    entry = f"""CASE WHEN s_suppkey % 19 = 7 THEN to_json(array(cast(s_suppkey AS string))) ELSE
      to_json(array(CASE WHEN s_suppkey % 11 = 0 THEN 'x' ELSE cast(s_suppkey AS string) END, CASE WHEN s_suppkey % 17 = 3 THEN NULL ELSE s_name END, 'T', CASE WHEN s_suppkey % 13 = 5 THEN NULL ELSE {_BOARD} END)) END"""
    pages = _packed(table(spark, sf_dir, "supplier"), "s_suppkey", entry, '{"fields":["CIK","Name","ticker","Exchange"],"data":[', "]}")
    nameless = spark.createDataFrame([(-20, '{"fields":["name","exchange"],"data":[["x","nyse"]]}'), (-21, '{"fields":["exchange","CIK"],"data":[["LSE",900000001],["otc",900000002]]}')], "page long, payload string")
    return registers.edgar_tickers(_with_noise(pages).union(nameless))


_KNOWN = f"""(SELECT s_suppkey, CASE WHEN s_suppkey % 19 = 7 THEN '' WHEN s_suppkey % 17 = 3 THEN 'None' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 19 = 7 THEN '' ELSE lower({_BOARD}) END AS board
    FROM supplier WHERE s_suppkey % 19 = 7 OR (s_suppkey % 11 <> 0 AND s_suppkey % 6 <> 5 AND s_suppkey % 13 <> 5) UNION ALL SELECT 900000002, '', 'otc')"""


@query(f"SELECT s_suppkey::BIGINT AS cik, s_name AS name, board AS exchange FROM {_KNOWN}")
def q_edgar_tickers(spark, sf_dir):
    return _universe(spark, sf_dir).select("cik", "name", "exchange")


@query(
    f"""SELECT s_suppkey::BIGINT AS cik, s_name AS name, concat('s', s_suppkey, '.com') AS domain, CASE WHEN board = 'otc' THEN 'unlisted' WHEN board <> '' THEN 'listed' END AS listed,
      nullif(upper(board), '') AS market, concat(s_suppkey, ' Main St, Town', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ', CA' END) AS address, CASE WHEN s_suppkey % 3 <> 0 THEN 'CA' END AS region,
      CASE WHEN s_suppkey % 4 = 0 THEN concat('S', s_suppkey) END AS ticker FROM {_KNOWN} WHERE s_suppkey % 5 <> 1 AND s_suppkey % 2 = 0 AND s_suppkey < 900000000"""
)
def q_edgar_companies(spark, sf_dir):
    """Some companies have two submissions: that of the least text counts."""
    said = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 1").selectExpr(
        "s_suppkey AS cik",
        """to_json(named_struct('name', '', 'sic', CASE WHEN s_suppkey % 2 = 0 THEN '7372' ELSE '4911' END, 'website', 'https://other.org', 'investorWebsite', concat('https://www.s', s_suppkey, '.com/ir'),
        'tickers', CASE WHEN s_suppkey % 4 = 0 THEN array(concat('S', s_suppkey)) ELSE array() END,
        'addresses', named_struct('business', named_struct('street1', concat(s_suppkey, ' Main St'), 'street2', ' ', 'city', 'Town', 'stateOrCountry', CASE WHEN s_suppkey % 3 <> 0 THEN 'CA' END)))) AS payload""",
    )
    later = said.where("cik % 7 = 2").select("cik", F.lit('{"sic":"7372","name":"z"}').alias("payload"))
    found = registers.edgar_companies(_universe(spark, sf_dir), said.union(later), ("737",))
    return found.select("cik", "name", "domain", "listed", "market", "address", "region", "ticker")


@query(
    """SELECT printf('%08d', s_suppkey) AS registry_id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'KOSPI' WHEN 1 THEN 'KOSDAQ' END AS market, CASE s_suppkey % 4 WHEN 0 THEN 'listed' WHEN 1 THEN 'listed' WHEN 2 THEN 'unlisted' ELSE 'unknown' END AS listed,
      concat('s', s_suppkey, '.co.kr') AS domain, concat(s_suppkey, '-81') AS reg_no FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0"""
)
def q_dart_companies(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    entry = "concat('<list><corp_code>', lpad(s_suppkey, 8, '0'), '</corp_code><corp_name>', s_name, '</corp_name><stock_code>', CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE cast(s_suppkey AS string) END, '</stock_code></list>')"
    made = s.select((F.col("s_suppkey") / 50).cast("long").alias("page"), F.expr(entry).alias("e")).groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("e")), "").alias("e"))
    universe = registers.dart_universe(made.select("page", F.concat(F.lit("<result>"), "e", F.lit("</result>")).alias("payload")))
    said = s.selectExpr(
        "lpad(s_suppkey, 8, '0') AS corp_code",
        """to_json(named_struct('status', CASE WHEN s_suppkey % 5 = 0 THEN '013' ELSE '000' END, 'induty_code', CASE WHEN s_suppkey % 7 = 0 THEN '999' ELSE '4110' END, 'hm_url', concat('www.s', s_suppkey, '.co.kr'),
        'bizr_no', concat(s_suppkey, '-81'), 'corp_cls', CASE s_suppkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'K' WHEN 2 THEN 'E' ELSE '?' END)) AS payload""",
    )
    return registers.dart_companies(universe, said, ("41", "42")).select("registry_id", "name", "market", "listed", "domain", "reg_no")


@query(
    """SELECT concat('n', s_suppkey) AS registry_id, s_name AS name, concat(s_suppkey, ' St, ', CASE WHEN s_suppkey % 2 = 0 THEN 'Floor 2, ' ELSE '' END, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Leeds, ' END, 'LS1') AS address,
      CASE WHEN s_suppkey % 3 <> 0 THEN 'Leeds' END AS region, concat('n', s_suppkey) AS reg_no, '건설·엔지니어링' AS label
    FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 11 <> 1 AND s_suppkey % 13 <> 1"""
)
def q_companies_house(spark, sf_dir):
    entry = """to_json(named_struct('company_number', CASE WHEN s_suppkey % 11 = 1 THEN '' ELSE concat('n', s_suppkey) END, 'company_name', CASE WHEN s_suppkey % 13 = 1 THEN NULL ELSE s_name END,
      'company_status', CASE WHEN s_suppkey % 4 = 0 THEN 'dissolved' ELSE ' Active ' END, 'sic_codes', CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN array('99', NULL) ELSE array('99', '41100') END,
      'registered_office_address', named_struct('address_line_1', concat(s_suppkey, ' St'), 'address_line_2', CASE WHEN s_suppkey % 2 = 0 THEN 'Floor 2' ELSE ' ' END, 'locality', CASE WHEN s_suppkey % 3 <> 0 THEN ' Leeds ' END, 'postal_code', 'LS1')))"""
    found = registers.companies_house_items(_with_noise(_packed(table(spark, sf_dir, "supplier"), "s_suppkey", entry, '{"items":[', "]}")), ("41",))
    return found.drop("page", "at")


@query(
    """SELECT concat('L', s_suppkey) AS registry_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'DE' ELSE 'FR' END AS country, concat('Haus ', s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ', Hof' END, ', Bonn, 53') AS address, 'Bonn' AS region,
      CASE WHEN s_suppkey % 7 <> 0 THEN concat('HRB ', s_suppkey) END AS reg_no FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 11 <> 1 AND s_suppkey % 13 <> 1"""
)
def q_gleif(spark, sf_dir):
    entry = """to_json(named_struct('id', CASE WHEN s_suppkey % 2 = 0 THEN NULL WHEN s_suppkey % 11 = 1 THEN '' ELSE concat('L', s_suppkey) END, 'attributes', named_struct('lei', CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 11 <> 1 THEN concat('L', s_suppkey) END,
      'entity', named_struct('legalName', CASE WHEN s_suppkey % 13 <> 1 THEN named_struct('name', s_name) END, 'status', CASE WHEN s_suppkey % 3 = 0 THEN 'INACTIVE' ELSE 'active' END, 'registeredAs', CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE concat('HRB ', s_suppkey) END,
      'legalAddress', named_struct('addressLines', CASE WHEN s_suppkey % 5 = 0 THEN array(concat('Haus ', s_suppkey)) ELSE array(concat('Haus ', s_suppkey), ' ', 'Hof') END, 'city', 'Bonn', 'postalCode', '53', 'country', CASE WHEN s_suppkey % 2 = 0 THEN 'DE' ELSE 'FR' END)))))"""
    return registers.gleif_records(_with_noise(_packed(table(spark, sf_dir, "supplier"), "s_suppkey", entry, '{"data":[', "]}"))).drop("page", "at")


@query(
    """SELECT concat('Q', n) AS registry_id, f.name, f.domain, f.hq AS headquarters FROM (SELECT s_suppkey % 60 AS n, arg_min(struct_pack(name := s_name, domain := CASE WHEN s_suppkey % 5 <> 0 THEN concat('w', s_suppkey, '.co.uk') END,
      hq := CASE WHEN s_suppkey % 3 <> 0 THEN 'Quebec' END), s_suppkey) AS f FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 9 <> 4 GROUP BY n)"""
)
def q_wikidata(spark, sf_dir):
    """Items come several times, over several pages; the first row of each that has a label counts."""
    entry = """to_json(named_struct('item', named_struct('value', concat('http://w/entity/Q', s_suppkey % 60)), 'itemLabel', CASE WHEN s_suppkey % 4 = 0 THEN named_struct('value', concat('Q', s_suppkey % 60)) WHEN s_suppkey % 9 <> 4 THEN named_struct('value', s_name) END,
      'website', CASE WHEN s_suppkey % 5 <> 0 THEN named_struct('value', concat('https://www.w', s_suppkey, '.co.uk/en')) END, 'hqLabel', named_struct('value', CASE WHEN s_suppkey % 3 = 0 THEN 'Q90' ELSE 'Quebec' END)))"""
    return registers.wikidata_bindings(_with_noise(_packed(table(spark, sf_dir, "supplier"), "s_suppkey", entry, '{"results":{"bindings":[', "]}}")))


@query(
    """SELECT concat('gb/', s_suppkey) AS registry_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat(s_suppkey, ' Row') END AS address, CASE WHEN s_suppkey % 5 <> 0 THEN 'York' END AS region, s_suppkey::VARCHAR AS reg_no
    FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 11 <> 1 AND s_suppkey % 13 <> 1 AND s_suppkey % 17 <> 1"""
)
def q_opencorporates(spark, sf_dir):
    entry = """to_json(named_struct('company', named_struct('name', CASE WHEN s_suppkey % 11 = 1 THEN NULL ELSE s_name END, 'company_number', CASE WHEN s_suppkey % 13 <> 1 THEN cast(s_suppkey AS string) END, 'jurisdiction_code', CASE WHEN s_suppkey % 17 = 1 THEN '' ELSE 'gb' END,
      'inactive', CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, 'registered_address_in_full', CASE WHEN s_suppkey % 2 = 0 THEN concat(' ', s_suppkey, ' Row') ELSE ' ' END, 'registered_address', CASE WHEN s_suppkey % 5 <> 0 THEN named_struct('locality', 'York') END)))"""
    return registers.opencorporates_companies(_with_noise(_packed(table(spark, sf_dir, "supplier"), "s_suppkey", entry, '{"results":{"companies":[', "]}}"))).drop("page", "at")


@query("SELECT concat('X', s_suppkey % 60) AS symbol, arg_min(s_name, s_suppkey) AS name FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 1 GROUP BY 1")
def q_sgx_rows(spark, sf_dir):
    """Codes come several times; rows without a name, of other types, and with the type in another field or case don't count."""
    entry = """to_json(named_struct('type', CASE WHEN s_suppkey % 3 = 0 THEN CASE s_suppkey % 4 WHEN 0 THEN 'bonds' WHEN 1 THEN 'STOCKS' END WHEN s_suppkey % 3 = 1 THEN 'stocks' ELSE 'reits' END, 'category', 'stocks',
      'nc', CASE WHEN s_suppkey % 2 = 0 THEN concat('X', s_suppkey % 60) END, 'code', CASE WHEN s_suppkey % 2 = 1 THEN concat(' X', s_suppkey % 60) END, 'companyName', CASE WHEN s_suppkey % 7 = 1 THEN '' ELSE s_name END))"""
    return registers.sgx_rows(_with_noise(_packed(table(spark, sf_dir, "supplier"), "s_suppkey", entry, '{"data":{"prices":[', "]}}")))


@query("SELECT concat('I', s_suppkey % 70) AS symbol, arg_min(s_name, s_suppkey) AS name FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1")
def q_idx_rows(spark, sf_dir):
    entry = "to_json(named_struct('KodeEmiten', CASE WHEN s_suppkey % 2 = 0 THEN concat('I', s_suppkey % 70) END, 'code', concat('I', s_suppkey % 70), 'NamaEmiten', CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE s_name END))"
    return registers.idx_rows(_with_noise(_packed(table(spark, sf_dir, "supplier"), "s_suppkey", entry, '{"data":[', "]}")))


_BOARDS = ("pse", "hose", "set", "bursa", "hnx")


@query(
    " UNION ALL ".join(
        f"""SELECT '{x}' AS registry, concat('P', s_suppkey % 60) AS symbol, concat(arg_min(s_name, s_suppkey), ' & Cö’s') AS name, '{x.upper()}' AS market FROM supplier WHERE s_suppkey % {n + 3} <> 1 GROUP BY 2"""
        for n, x in enumerate(_BOARDS)
    )
)
def q_exchange_rows(spark, sf_dir):
    """Symbols come several times over several pages; a row with an empty name doesn't hide the next one."""
    s, out = table(spark, sf_dir, "supplier"), None
    for n, x in enumerate(_BOARDS):
        name = f"CASE WHEN s_suppkey % {n + 3} = 1 THEN '  ' ELSE concat(s_name, ' &amp; C&ouml;&#8217;s') END"
        if x == "pse":
            entry = f"""concat('<td><a onclick="cmDetail(''1'',''', s_suppkey, ''');return false;">', {name}, '</a></td> <td class="s"><a href="#">P', s_suppkey % 60, '</a></td>')"""
        else:
            entry = f"""concat('<tr><td><a href="#"> P', s_suppkey % 60, ' </a> </td> <td class="n"> ', {name}, ' </td></tr>')"""
        pages = _packed(s, "s_suppkey", entry, "<table>", "</table>").withColumnRenamed("payload", "html")
        some = registers.exchange_rows(pages, x).select("registry", "symbol", "name", "market")
        out = some if out is None else out.unionByName(some)
    return out


@query(
    """SELECT CASE WHEN s_suppkey % 3 = 0 THEN concat('name:kr:', lower(replace(s_name, '#', ''))) ELSE concat('dom:s', s_suppkey, '.com') END AS key, CASE WHEN s_suppkey % 11 = 1 THEN '' ELSE s_name END AS name,
      CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('https://www.s', s_suppkey, '.com/x') END AS domain, CASE WHEN s_suppkey % 2 = 0 THEN concat('ir@s', s_suppkey, '.com') END AS email
    FROM supplier WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 11 <> 1 OR s_suppkey % 3 <> 0)"""
)
def q_imported(spark, sf_dir):
    """Headers as sheets write them: with blanks around them, twice, and some that name no field though they look like it."""
    site = "CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 7 = 0 THEN NULL ELSE concat('https://www.s', s_suppkey, '.com/x') END"
    sheet = table(spark, sf_dir, "supplier").selectExpr(
        "CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 11 = 1 THEN ' ' ELSE s_name END AS ` 업체명 `", "'대한민국' AS `국가`", "'no.org' AS `홈페이지`", "'no.org' AS `Website`", f"{site} AS ` site `",
        "CASE WHEN s_suppkey % 2 = 0 THEN concat(' ir@s', s_suppkey, '.com ') ELSE ' ' END AS `이메일 (IR 우선순위)`", "1 AS other",
    )
    return registers.imported(sheet).select("key", "name", "domain", "email")


@query(
    f"""SELECT p_partkey, (CASE WHEN p_partkey % 5 = 0 THEN 550 WHEN p_partkey % 5 = 1 THEN 250 ELSE 451 END) AS code,
      CASE WHEN p_partkey % 5 = 0 THEN 'bad' WHEN p_partkey % 5 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'unknown' ELSE 'ok' END WHEN p_partkey % 3 = 0 THEN 'bad' WHEN p_partkey % 3 = 1 THEN 'ok' ELSE 'unknown' END AS smtp,
      CASE p_partkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad' WHEN 2 THEN 'unknown' WHEN 3 THEN 'bad' ELSE 'unknown' END AS vendor,
      CASE WHEN p_partkey % 4 = 0 THEN concat(repeat('k', {identity.KEY_LENGTH - 41}), ':', sha1(concat(repeat('k', 700), p_partkey))) ELSE concat('k', p_partkey) END AS key,
      CASE WHEN p_partkey % 6 = 0 THEN '{D.TAXONOMY[0]}' WHEN p_partkey % 6 = 1 THEN '{D.TAXONOMY[1]}' END AS label, p_partkey % 6 = 0 AS known
    FROM part"""
)
def q_small_rules(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    code = F.expr("CASE WHEN p_partkey % 5 = 0 THEN 550 WHEN p_partkey % 5 = 1 THEN 250 ELSE 451 END")
    second = F.expr("CASE p_partkey % 3 WHEN 0 THEN 553 WHEN 1 THEN 250 ELSE 421 END")
    word = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'Valid' WHEN 1 THEN 'spamtrap' WHEN 2 THEN 'catch-all' WHEN 3 THEN 'do_not_mail' ELSE 'other' END")
    raw = F.expr(f"CASE p_partkey % 6 WHEN 0 THEN '`{D.TAXONOMY[0]}`.' WHEN 1 THEN 'It is {D.TAXONOMY[1]} surely' ELSE 'none' END")
    key = F.expr("CASE WHEN p_partkey % 4 = 0 THEN concat(repeat('k', 700), p_partkey) ELSE concat('k', p_partkey) END")
    return p.select(
        "p_partkey", code.alias("code"), verify.smtp_verdict(F.array(code, second), F.array(F.col("p_partkey") % 2 == 0, F.lit(False))).alias("smtp"),
        verify.vendor_verdict(verify.ZEROBOUNCE, word).alias("vendor"), identity.clamp_key(key).alias("key"), industry.accept_label(raw).alias("label"),
        industry.is_taxonomy_label(F.when(F.col("p_partkey") % 6 == 0, F.lit(f" {D.TAXONOMY[0]} ")).otherwise("x")).alias("known"),
    )


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('https://www.f', p_partkey, '.com/a|https://m.f', p_partkey, '.com/a|https://f', p_partkey, '.com/a')
      WHEN 1 THEN concat('http://f', p_partkey, '.com|http://m.f', p_partkey, '.com') ELSE concat('https://shop.f', p_partkey, '.com/') END AS variants FROM part"""
)
def q_url_variants(spark, sf_dir):
    url = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('https://www.f', p_partkey, '.com/a') WHEN 1 THEN concat('http://f', p_partkey, '.com') ELSE concat('https://shop.f', p_partkey, '.com/') END")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(enrichment.url_variants(url), "|").alias("variants"))


@query(
    """SELECT s_suppkey AS id, concat(v, s_suppkey, '@x.com') AS email FROM supplier, (VALUES ('a'), ('b')) t(v) WHERE s_suppkey % 2 = 0
    UNION ALL SELECT s_suppkey, concat('p', s_suppkey, '@x.com') FROM supplier WHERE s_suppkey % 2 = 1"""
)
def q_finder_addresses(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        """CASE WHEN s_suppkey % 2 = 0 THEN concat('{"data":{"emails":[{"value":"a', s_suppkey, '@x.com"},{"value":""},{"value":"b', s_suppkey, '@x.com"}]}}')
        ELSE concat('{"people":[{"email":"email_not_unlocked@domain.com"},{"email":"p', s_suppkey, '@x.com"},{"email":null}]}') END AS payload""",
    )
    return enrichment.finder_addresses(s)


_JOBS = "SELECT concat('j', o_orderkey) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'failed' END AS status, o_orderdate AS started_at, CASE WHEN o_orderkey % 3 = 2 THEN 'e' END AS error FROM orders"


@query(f"SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'restart' ELSE error END AS error FROM ({_JOBS})")
def q_failed_jobs(spark, sf_dir):
    jobs = spark.sql(_JOBS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return ledger.finish_jobs(jobs, "restart").select("id", "status", "error")


@query(f"SELECT * FROM (SELECT 'any' AS which, id, status FROM ({_JOBS}) ORDER BY started_at DESC, id DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'running', id, status FROM ({_JOBS}) WHERE status = 'running' ORDER BY started_at DESC, id DESC LIMIT 1)")
def q_latest_jobs(spark, sf_dir):
    jobs = spark.sql(_JOBS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    pick = lambda name, status: ledger.latest_job(jobs, status).select(F.lit(name).alias("which"), "id", "status")
    return pick("any", None).union(pick("running", "running"))


@query(f"SELECT concat('t', o_orderkey) AS token, o_custkey AS user_id FROM orders WHERE o_orderdate > TIMESTAMP '{NOW}' AND o_custkey % 4 <> 0")
def q_live_sessions(spark, sf_dir):
    sessions = table(spark, sf_dir, "orders").selectExpr("concat('t', o_orderkey) AS token", "o_custkey AS user_id", "o_orderdate AS expires_at")
    users = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_custkey % 4 <> 0 AS is_active")
    return ledger.live_sessions(sessions, users, F.lit(NOW).cast("timestamp")).select("token", "user_id")


@query(
    """WITH m AS (SELECT DISTINCT concat('k', s_suppkey) AS o, concat('k', s_suppkey - 1) AS n FROM supplier WHERE s_suppkey % 2 = 1),
    p AS (SELECT concat('id', s_suppkey) AS id, concat('k', s_suppkey) AS a, concat('k', s_suppkey + 1) AS b FROM supplier),
    r AS (SELECT p.id, coalesce(x.n, p.a) AS a, coalesce(y.n, p.b) AS b FROM p LEFT JOIN m x ON x.o = p.a LEFT JOIN m y ON y.o = p.b)
    SELECT sha1(concat(least(a, b), chr(0), greatest(a, b))) AS id, least(a, b) AS key_a, greatest(a, b) AS key_b FROM r WHERE a <> b GROUP BY 1, 2, 3"""
)
def q_rekey_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    mapping = s.where("s_suppkey % 2 = 1").selectExpr("concat('k', s_suppkey) AS old", "concat('k', s_suppkey - 1) AS new")
    pairs = s.selectExpr("concat('id', s_suppkey) AS id", "concat('k', s_suppkey) AS key_a", "concat('k', s_suppkey + 1) AS key_b", "'domain' AS tier", "0 AS name_score", "'pending' AS status")
    return ledger.rekey_pairs(pairs, mapping).select("id", "key_a", "key_b")


@query("SELECT concat('e', o_orderkey) AS send_id, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'sent' END AS status FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT concat('e', o_orderkey), 'failed' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0")
def q_logged_sends(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    log = o.where("o_orderkey % 3 = 0").selectExpr("concat('e', o_orderkey) AS send_id", "'sent' AS status")
    return outreach.log_sends(log, o.where("o_orderkey % 5 = 0").selectExpr("concat('e', o_orderkey) AS send_id", "'failed' AS status"))


_TERMS = _in(sorted(D.EN_INDUSTRY_TERMS))


@query(f"SELECT company_id, lower(trim(industry)) IN ({_TERMS}) AS many FROM v_company", "v_company")
def q_search_terms(spark, sf_dir):
    c = table(spark, sf_dir, "v_company")
    return c.select("company_id", (F.size(industry.search_terms(F.col("industry"))) > 1).alias("many"))
