"""Queries over the reviewers' desk and over what runs leave behind, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import verify
from rollcall.operators import crawl, ledger, queue
from rollcall.plans.catalogue import NOW, query
from rollcall.plans.views import table

_TYPED = """SELECT o_orderkey AS seq, concat('r', o_orderkey % 997) AS review_id, CASE o_orderkey % 7 WHEN 0 THEN 'no address' WHEN 1 THEN concat(' b', o_orderkey % 90, '@x.com ') WHEN 2 THEN concat('a', o_orderkey % 300, '@x.com') ELSE concat('typed', o_orderkey % 5, '@firm.com') END AS email FROM {orders} WHERE o_orderkey % 3 = 0"""
_DESK = f"""t AS (SELECT seq, review_id, trim(email) AS email, regexp_matches(trim(email), '^[^@\\s]+@[^@\\s]+[.][^@\\s]+$') AS ok FROM ({_TYPED.replace('{orders}', 'orders')})),
    q AS (SELECT *, CASE WHEN candidates = 'broken' THEN [] ELSE from_json(candidates, '["VARCHAR"]') END AS vals FROM v_queue),
    n AS (SELECT t.*, q.company_id FROM (SELECT *, row_number() OVER (PARTITION BY review_id, email ORDER BY seq) AS k FROM t WHERE ok) t JOIN q ON q.review_id = t.review_id WHERE k = 1 AND NOT list_contains(vals, email))"""


def _typed(spark, sf_dir):
    contact = table(spark, sf_dir, "v_contact").select("contact_id", "company_id", "type", "value", "role", F.lit("static").alias("extract_method"), (F.col("tenths") / 10).alias("confidence"))
    return queue.register_typed(table(spark, sf_dir, "v_queue"), contact, spark.sql(_TYPED, orders=table(spark, sf_dir, "orders")))


@query(
    f"""WITH {_DESK}, m AS (SELECT review_id, list(email ORDER BY seq) AS more FROM n GROUP BY review_id)
    SELECT q.review_id, CASE WHEN more IS NULL THEN candidates ELSE concat('["', array_to_string(list_concat(vals, more), '","'), '"]') END AS candidates FROM q LEFT JOIN m ON m.review_id = q.review_id""",
    "v_queue",
)
def q_typed_candidates(spark, sf_dir):
    return _typed(spark, sf_dir)[0].select("review_id", "candidates")


@query(f"WITH {_DESK} SELECT DISTINCT company_id, email AS value, concat('k_', left(sha1(concat(company_id, '|email|', email)), 30)) AS contact_id FROM n", "v_queue")
def q_typed_contacts(spark, sf_dir):
    return _typed(spark, sf_dir)[1].where("extract_method = 'manual' and role = 'ir' and type = 'email' and confidence = 1").select("company_id", "value", "contact_id")


@query(f"WITH {_DESK} SELECT t.seq, CASE WHEN t.ok THEN n.seq IS NOT NULL END AS registered FROM t LEFT JOIN n ON n.seq = t.seq", "v_queue")
def q_typed_answers(spark, sf_dir):
    return _typed(spark, sf_dir)[2]


@query(
    """WITH held AS (SELECT q.*, c.name, c.listed, CASE WHEN candidates = 'broken' THEN [] ELSE from_json(candidates, '["VARCHAR"]') END AS vals FROM v_queue q JOIN v_company c USING (company_id) WHERE claimed_by IS NOT NULL AND status = 'pending')
    SELECT claimed_by AS user_id, review_id, row_number() OVER (PARTITION BY claimed_by ORDER BY name, review_id)::INT AS place, array_to_string(vals, ',') AS vals, CASE WHEN list_contains(vals, selected) THEN selected ELSE vals[1] END AS effective, listed FROM held""",
    "v_queue", "v_company",
)
def q_my_work(spark, sf_dir):
    contact = table(spark, sf_dir, "v_contact").withColumn("confidence", F.col("tenths") / 10)
    rows = queue.my_work(table(spark, sf_dir, "v_queue"), table(spark, sf_dir, "v_company"), contact, table(spark, sf_dir, "v_validation"))
    return rows.select("user_id", "review_id", "place", F.array_join("values", ",").alias("vals"), "effective", "listed")


@query(
    """SELECT page_id, CASE WHEN code = 0 OR code >= 400 THEN 'blocked' WHEN contains(lower(body), 'just a moment...') OR abs(length(body) - 5000) <= 20 THEN 'challenge' WHEN asked AND page_id % 11 = 0 THEN 'weak_ok' WHEN asked THEN 'strong_ok' WHEN NOT asked THEN 'challenge'
      WHEN length(body) < 3000 THEN 'challenge' ELSE 'weak_ok' END AS verdict
    FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 403 ELSE 200 END AS code, CASE page_id % 4 WHEN 0 THEN contains(html, '<article>') WHEN 1 THEN false END AS asked,
      CASE page_id % 5 WHEN 0 THEN 'Just a Moment...' WHEN 1 THEN left(html, 5010) ELSE html END AS body FROM pages)"""
)
def q_response_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CASE page_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 403 ELSE 200 END AS code", "CASE page_id % 4 WHEN 0 THEN contains(html, '<article>') WHEN 1 THEN false END AS asked",
        "CASE page_id % 5 WHEN 0 THEN 'Just a Moment...' WHEN 1 THEN left(html, 5010) ELSE html END AS body",
    )
    return rows.select("page_id", verify.response_verdict(F.col("code"), F.col("body"), F.col("asked"), F.col("page_id") % 11 == 0, bad_sizes=(5000,)).alias("verdict"))


@query("SELECT count(*) AS discovered, (SELECT count(*) FROM v_lead WHERE has_email OR has_phone OR has_form) AS enriched, (SELECT count(*) FROM v_lead WHERE is_active) AS saved FROM v_discovered", "v_discovered", "v_lead")
def q_progress(spark, sf_dir):
    leads = table(spark, sf_dir, "v_lead").selectExpr("CASE WHEN has_email THEN array(email) ELSE array() END AS email_candidates", "CASE WHEN has_phone THEN phone END AS phone", "CASE WHEN has_form THEN form_url END AS form", "is_active")
    return crawl.progress(table(spark, sf_dir, "v_discovered"), leads)


@query(
    f"""SELECT concat('dom:s', s_suppkey, '.com') AS key, CASE WHEN s_suppkey % 3 = 0 THEN concat('Old ', s_suppkey) ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '1990-01-01 00:00:00' ELSE TIMESTAMP '{NOW}' END AS last_crawled_at FROM supplier"""
)
def q_ensured_discovered(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    book = s.where("s_suppkey % 3 = 0").selectExpr("concat('dom:s', s_suppkey, '.com') AS key", "concat('Old ', s_suppkey) AS name", "TIMESTAMP '1990-01-01 00:00:00' AS last_crawled_at")
    leads = s.selectExpr("concat('dom:s', s_suppkey, '.com') AS key", "s_name AS name", "'x' AS homepage")
    return crawl.ensure_discovered(book, leads.union(leads), F.lit(NOW).cast("timestamp"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS target FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 40 = 0")
def q_upserted_targets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    changes = c.where("c_custkey % 4 = 0").selectExpr("c_custkey AS id", "'new' AS target").union(c.where("c_custkey % 40 = 0").selectExpr("-c_custkey", "'new'"))
    return ledger.upsert(c.selectExpr("c_custkey AS id", "'old' AS target"), changes, "id")
