"""Queries over what a crawl leaves behind, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import dimensions as D
from rollcall.functions import identity
from rollcall.operators import crawl
from rollcall.plans.catalogue import NOW, _domain, _values, query
from rollcall.plans.views import table

_BOOK = "SELECT key, name, country, domain, reg_no, CASE WHEN page_id % 9 = 4 THEN 'p0' END AS duplicate_of FROM {src} WHERE key LIKE 'p%'"


def _book(spark, sf_dir):
    return spark.sql(_BOOK, src=table(spark, sf_dir, "v_discovered"))


@query(f"SELECT key, name, country, domain, reg_no FROM ({_BOOK.format(src='v_discovered')}) WHERE duplicate_of IS NULL", "v_discovered")
def q_ledger_records(spark, sf_dir):
    return crawl.records(_book(spark, sf_dir))


@query(f"SELECT DISTINCT 'key' AS kind, key AS value FROM v_discovered UNION SELECT 'domain', {_domain('domain')} FROM v_discovered WHERE {_domain('domain')} IS NOT NULL", "v_discovered")
def q_seen_values(spark, sf_dir):
    return crawl.seen(table(spark, sf_dir, "v_discovered"))


@query(
    f"""WITH b AS ({_BOOK.format(src='v_discovered')}), f AS (SELECT CASE WHEN page_id % 4 = 0 THEN concat('p', page_id) ELSE key END AS key, name, CASE WHEN page_id % 3 = 0 THEN concat('p', page_id) END AS survivor FROM v_discovered WHERE key LIKE 'q%')
    SELECT coalesce(b.key, f.key) AS key, CASE WHEN b.key IS NULL THEN f.name ELSE b.name END AS name,
      CASE WHEN f.survivor IS NOT NULL AND f.survivor <> f.key AND b.duplicate_of IS NULL THEN f.survivor ELSE b.duplicate_of END AS duplicate_of,
      CASE WHEN f.survivor IS NOT NULL AND f.survivor <> f.key AND b.duplicate_of IS NULL THEN 'inline:name+domain' END AS merge_reason
    FROM b FULL JOIN f ON f.key = b.key""",
    "v_discovered",
)
def q_inline_absorbed(spark, sf_dir):
    none = F.lit(None).cast("string")
    book = _book(spark, sf_dir).select("key", "name", "duplicate_of", none.alias("merge_reason"), none.alias("merged_by"), F.lit(None).cast("timestamp").alias("merged_at"))
    found = table(spark, sf_dir, "v_discovered").where("key like 'q%'").selectExpr(
        "CASE WHEN page_id % 4 = 0 THEN concat('p', page_id) ELSE key END AS key", "name", "CASE WHEN page_id % 3 = 0 THEN concat('p', page_id) END AS survivor"
    )
    return crawl.absorb_inline(book, found, F.lit(NOW).cast("timestamp")).select("key", "name", "duplicate_of", "merge_reason")


@query(
    f"""SELECT key, CASE WHEN page_id % 5 <> 0 AND page_id % 3 = 0 AND page_id % 2 = 0 THEN '은행' WHEN page_id % 3 = 0 THEN '{D.UNCLASSIFIED}' ELSE '건설' END AS industry,
      CASE page_id % 4 WHEN 0 THEN 'listed' WHEN 1 THEN 'unlisted' ELSE 'unknown' END AS listed, CASE WHEN domain IS NOT NULL THEN concat('https://', domain) END AS homepage, page_id % 5 <> 0 AS is_active,
      CASE WHEN page_id % 2 = 0 THEN concat('ir@', key, '.com,info@', key, '.com') ELSE concat('info@', key, '.com') END AS emails,
      CASE WHEN page_id % 2 = 0 THEN concat('ir@', key, '.com') ELSE concat('info@', key, '.com') END AS email, CASE WHEN page_id % 3 = 1 THEN '+82' END AS phone FROM v_discovered""",
    "v_discovered",
)
def q_built_leads(spark, sf_dir):
    d = table(spark, sf_dir, "v_discovered")
    found = d.selectExpr("key", "name", "country", f"CASE WHEN page_id % 3 = 0 THEN '{D.UNCLASSIFIED}' ELSE '건설' END AS industry", "CASE page_id % 4 WHEN 0 THEN 'listed' WHEN 1 THEN 'unlisted' WHEN 2 THEN 'odd' END AS listed", "domain")
    contacts = (
        d.where("page_id % 2 = 0").selectExpr("key", "1 AS ord", "'email' AS type", "concat('ir@', key, '.com') AS value", "true AS accepted")
        .union(d.selectExpr("key", "2", "'email'", "concat('info@', key, '.com')", "true")).union(d.selectExpr("key", "0", "'email'", "'jobs@x.com'", "false"))
        .union(d.where("page_id % 3 = 1").selectExpr("key", "3", "'phone'", "'+82'", "true"))
    )
    existence = d.where("page_id % 5 <> 0").selectExpr("key", "true AS is_active", "page_id % 2 = 0 AS site_alive", "0.7D AS confidence")
    labels = d.selectExpr("key", "CASE WHEN page_id % 2 = 0 THEN '은행' END AS label")
    made = crawl.build_leads(found, contacts, existence, labels)
    return made.select("key", "industry", "listed", "homepage", "is_active", F.array_join("email_candidates", ",").alias("emails"), "email", "phone")


@query(
    f"""SELECT company_id, CASE WHEN is_active AND c_custkey % 3 <> 0 AND c_custkey % 4 < 2 AND c_custkey % 2 = 0 THEN '은행' WHEN c_custkey % 4 = 0 THEN '{D.UNCLASSIFIED}' WHEN c_custkey % 4 = 1 THEN '기타 제조' ELSE industry END AS industry FROM v_company""",
    "v_company",
)
def q_backfilled_industries(spark, sf_dir):
    c = table(spark, sf_dir, "v_company").withColumn("key", F.col("company_id")).withColumn("industry", F.expr(f"CASE c_custkey % 4 WHEN 0 THEN '{D.UNCLASSIFIED}' WHEN 1 THEN '기타 제조' ELSE industry END"))
    said = c.selectExpr("company_id", "CASE WHEN c_custkey % 2 = 0 THEN '은행' END AS label")
    return crawl.backfill_industries(c, c.where("c_custkey % 3 <> 0").select("key"), said).select("company_id", "industry")


_RENAMED = "SELECT concat('old', c_custkey) AS old, concat('new', c_custkey) AS new FROM {src} WHERE c_custkey % 3 = 0"


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN concat('new', c_custkey) ELSE concat('old', c_custkey) END AS key, CASE WHEN c_custkey % 3 = 0 THEN concat('c_', left(sha1(concat('new', c_custkey)), 30)) ELSE concat('c', c_custkey) END AS company_id FROM customer")
def q_rekeyed_companies(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    company = c.selectExpr("concat('c', c_custkey) AS company_id", "concat('old', c_custkey) AS key")
    after, child = crawl.rekey_companies(company, c.selectExpr("concat('c', c_custkey) AS company_id", "c_custkey"), spark.sql(_RENAMED, src=c))
    return after.select("key", "company_id")


@query(
    """SELECT review_id, CASE WHEN lost THEN '[]' ELSE candidates END AS candidates, CASE WHEN lost AND candidates <> '[]' THEN NULL ELSE selected END AS selected, CASE WHEN lost AND candidates <> '[]' THEN false ELSE selected_by_human END AS selected_by_human
    FROM (SELECT *, CAST(substr(company_id, 2) AS BIGINT) % 3 = 0 AS lost FROM v_queue)""",
    "v_queue",
)
def q_cleared_reviews(spark, sf_dir):
    q = table(spark, sf_dir, "v_queue")
    lost = q.where("cast(substr(company_id, 2) AS bigint) % 3 = 0").select("company_id")
    return crawl.clear_reviews(q, lost).select("review_id", "candidates", "selected", "selected_by_human")


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true ELSE false END AS same, CASE p_partkey % 4 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
      CASE p_partkey % 4 WHEN 0 THEN 'same firm' WHEN 1 THEN '(근거 미제공)' WHEN 2 THEN 'LLM 응답에 JSON 없음(파싱 실패)' ELSE 'LLM JSON 파싱 실패' END AS reason, 'm1' AS model FROM part"""
)
def q_parsed_verdicts(spark, sf_dir):
    said = """CASE p_partkey % 4 WHEN 0 THEN 'Sure: {"same": true, "confidence": 0.75, "reason": " same firm "} ok' WHEN 1 THEN '{"same": false, "confidence": 7}' WHEN 2 THEN 'no answer' ELSE '{"same": tru}' END"""
    return table(spark, sf_dir, "part").select("p_partkey", crawl.parse_verdict(F.expr(said), "m1").alias("v")).select("p_partkey", "v.*")


@query(
    "SELECT iso, label, count(company_id) AS companies FROM (VALUES " + _values(sorted(D.korean_names().items())) + """) AS t(iso, label)
    LEFT JOIN v_company ON iso = CASE country WHEN 'KR' THEN 'KR' WHEN '대한민국' THEN 'KR' WHEN 'US' THEN 'US' WHEN 'Japan' THEN 'JP' END GROUP BY ALL""",
    "v_company",
)
def q_supported_countries(spark, sf_dir):
    """The countries that can be searched, with the companies that are known there."""
    known = table(spark, sf_dir, "v_company").select(F.upper(identity.known_country(F.col("country"))).alias("iso"), "company_id")
    counts = known.groupBy("iso").agg(F.count("company_id").alias("n"))
    return crawl.supported_countries(spark).join(counts, "iso", "left").select("iso", "label", F.coalesce("n", F.lit(0)).alias("companies"))


@query(
    "WITH n AS (SELECT * FROM (VALUES " + _values(sorted(D.korean_names().items())) + """) AS t(iso, label))
    SELECT company_id, (SELECT label FROM n WHERE iso = CASE country WHEN 'KR' THEN 'KR' WHEN '대한민국' THEN 'KR' WHEN 'US' THEN 'US' WHEN 'Japan' THEN 'JP' END) AS label FROM v_company""",
    "v_company",
)
def q_korean_labels(spark, sf_dir):
    return table(spark, sf_dir, "v_company").select("company_id", crawl.korean_label(F.col("country")).alias("label"))


@query("SELECT concat('j', o_orderkey) AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS started_at, o_orderkey = 33 AND o_orderkey % 3 = 0 AS cancel_requested FROM orders")
def q_job_items(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").selectExpr(
        "concat('j', o_orderkey) AS id", "CASE o_orderkey % 3 WHEN 0 THEN 'running' ELSE 'done' END AS status", "o_orderdate AS started_at", "o_orderdate AS updated_at", "false AS cancel_requested"
    )
    return crawl.job_items(crawl.request_cancel(jobs, "j33", F.lit(NOW).cast("timestamp"))).select("id", "started_at", "cancel_requested")
