"""Company-record views over the generated tables, as SQL that Spark and DuckDB both run.

Each view is a text with the names of its inputs in braces. Spark gets frames for them; for DuckDB the
views become common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_page": """
        SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
               regexp_extract(url, '^https?://[^/]+/([a-z][a-z])/', 1) AS lang,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
        FROM {pages}""",
    "v_base": """
        SELECT page_id, lower(title) AS name, replace(host, '.', '-') AS slug,
               CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' ELSE 'ES' END AS country
        FROM {v_page}""",
    "v_discovered": """
        SELECT concat('p', page_id) AS key, page_id, name, country, concat('https://www.', slug, '.com/ir') AS domain,
               CASE WHEN page_id % 5 = 0 THEN concat(page_id % 50, '-00') END AS reg_no
        FROM {v_base}
        UNION ALL
        SELECT concat('q', page_id) AS key, page_id, concat(name, ' Inc.') AS name, country,
               CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN concat(slug, '.com') ELSE concat('alt', page_id, '.co.kr') END AS domain,
               CASE WHEN page_id % 10 = 0 THEN concat(page_id % 50, '00') WHEN page_id % 5 = 0 THEN concat('z', page_id) END AS reg_no
        FROM {v_base} WHERE page_id % 2 = 0 OR page_id % 5 = 0""",
    "v_member": """
        SELECT key, name, country, domain, CASE WHEN page_id % 4 = 0 THEN 'sec' END AS registry,
               CASE WHEN page_id % 4 = 0 THEN key END AS registry_id
        FROM {v_discovered}""",
    "v_company": """
        SELECT concat('c', c_custkey) AS company_id, c_custkey, c_name AS name,
               CASE c_nationkey % 5 WHEN 0 THEN 'KR' WHEN 1 THEN '대한민국' WHEN 2 THEN 'US' WHEN 3 THEN 'Japan' ELSE '' END AS country,
               CASE c_mktsegment WHEN 'BUILDING' THEN '건설' WHEN 'AUTOMOBILE' THEN '자동차' WHEN 'MACHINERY' THEN '제조'
                    WHEN 'HOUSEHOLD' THEN '전체' ELSE '기타' END AS industry,
               CASE c_custkey % 3 WHEN 0 THEN 'listed' WHEN 1 THEN 'unlisted' ELSE 'unknown' END AS listed,
               CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN '서울' ELSE '부산' END AS region,
               c_custkey % 7 <> 0 AS is_active
        FROM {customer}""",
    "v_queue": """
        SELECT concat('r', o_orderkey) AS review_id, concat('c', o_custkey) AS company_id, 'email' AS field,
               CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'confirmed' ELSE 'rejected' END AS status,
               CASE o_orderkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN 'broken'
                    WHEN 2 THEN concat('["a', o_custkey, '@x.com"]')
                    ELSE concat('["a', o_custkey, '@x.com","b', o_orderkey % 90, '@x.com"]') END AS candidates,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN concat('u', o_orderkey % 6) END AS claimed_by,
               CASE o_orderkey % 5 WHEN 2 THEN concat('a', o_custkey, '@x.com') WHEN 3 THEN concat('b', o_orderkey % 90, '@x.com')
                    WHEN 4 THEN concat('B', o_orderkey % 90, '@x.com ') END AS selected,
               o_orderkey % 3 = 0 AS selected_by_human, o_orderkey
        FROM {orders}""",
    "v_contact": """
        SELECT concat('k', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(l_quantity AS int)) AS contact_id, concat('c', l_suppkey) AS company_id,
               CASE l_linenumber % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE 'form' END AS type,
               CASE l_linenumber % 3 WHEN 0 THEN concat('a', l_suppkey, '@x.com') WHEN 1 THEN concat('+82-2-', l_partkey)
                    ELSE concat('https://x.com/contact/', l_partkey) END AS value,
               CASE l_partkey % 4 WHEN 0 THEN 'ir' WHEN 1 THEN 'general' WHEN 2 THEN 'hr' ELSE 'press' END AS role,
               l_partkey % 10 AS tenths, l_partkey, l_orderkey, l_linenumber
        FROM {lineitem}""",
    "v_validation": """
        SELECT contact_id, CASE l_partkey % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'risky' ELSE 'invalid' END AS status,
               l_partkey % 2 = 0 AS mx, CASE l_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS smtp
        FROM {v_contact} WHERE type = 'email'""",
    "v_lead": """
        SELECT s.s_suppkey, s.s_name AS name, c.country, c.industry, c.listed, c.is_active,
               s.s_suppkey % 4 <> 0 AS has_email, s.s_suppkey % 3 = 0 AS has_phone, s.s_suppkey % 5 <> 0 AS has_form,
               CASE WHEN s.s_suppkey % 4 <> 0 THEN CASE s.s_suppkey % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'risky' ELSE 'invalid' END END AS status,
               CASE s.s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS smtp,
               CASE WHEN s.s_suppkey % 6 <> 0 THEN concat('https://s', s.s_suppkey, '.com') END AS homepage,
               CASE WHEN s.s_suppkey % 7 <> 0 THEN concat('s', s.s_suppkey, '.com') END AS domain, s.s_suppkey % 8 <> 0 AS site_alive,
               CASE WHEN s.s_suppkey % 4 <> 0 THEN concat('ir@s', s.s_suppkey, '.com') END AS email,
               CASE WHEN s.s_suppkey % 3 = 0 THEN concat('+82', s.s_suppkey) END AS phone,
               CASE WHEN s.s_suppkey % 5 <> 0 THEN concat('https://s', s.s_suppkey, '.com/contact') END AS form_url
        FROM {supplier} s JOIN {v_company} c ON c.c_custkey = s.s_suppkey""",
    "v_cost_event": """
        SELECT event_id, CASE event_type WHEN 'click' THEN 'serper' WHEN 'view' THEN 'hunter' WHEN 'purchase' THEN 'zerobounce'
                    WHEN 'signup' THEN 'vision' ELSE 'nobody' END AS provider,
               CAST(event_id % 7 AS int) - 1 AS units, ts, user_id
        FROM {events}""",
    "v_audit": """
        SELECT concat('e', event_id) AS audit_id, concat('r', event_id) AS review_id,
               CASE event_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'reclaim' END AS action,
               concat('u', user_id % 9) AS actor_id, ts
        FROM {events}""",
    "v_user": "SELECT DISTINCT concat('u', event_id % 12) AS user_id FROM {events}",
    "v_log": """
        SELECT concat('b', o_orderkey % 45, '@x.com') AS email, 'sent' AS status, o_orderdate AS sent_at, o_orderkey
        FROM {orders} WHERE o_orderkey % 40 = 7""",
    "v_failure": "SELECT event_id, user_id, CAST(event_id * 37 % 100000 AS bigint) AS second FROM {events} WHERE event_id % 3 = 0",
    "v_html": """
        SELECT page_id, url, concat(html, '<a href="mailto:IR.Team', page_id % 40, '@firm', page_id % 30, '.com?subject=x">mail</a>',
               CASE WHEN page_id % 3 = 0 THEN concat('<a href="tel:+82-2-', 1000000 + page_id, '">call</a>') ELSE '' END,
               CASE WHEN page_id % 4 = 0 THEN '<span data-cfemail="4a23243c2f393e25380a2b29272f64292527">x</span>' ELSE '' END,
               CASE WHEN page_id % 5 = 0 THEN concat('<p>info (at) acme', page_id % 20, ' [dot] com or recruit@acme.com</p>') ELSE '' END,
               CASE WHEN page_id % 6 = 0 THEN '<a href="/ir/about">IR</a><a href="/contact">contact</a><a href="https://other.org/contact">x</a>' ELSE '' END,
               CASE WHEN page_id % 7 = 0 THEN '<form action="/inquiry"><textarea name="m"></textarea></form>'
                    WHEN page_id % 7 = 1 THEN '<form action="/contact"><input name="e"></form>'
                    WHEN page_id % 7 = 2 THEN '<form action="/search" class="contact"><input type="search"></form>'
                    WHEN page_id % 7 = 3 THEN '<iframe src="https://forms.gle/abc"></iframe>' ELSE '' END,
               CASE WHEN page_id % 8 = 0 THEN '<img src="/img/mail.png"><img src="/logo.gif"><img src="data:x">' ELSE '' END) AS html
        FROM {pages}""",
    "v_probe": """
        SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL ELSE concat('firm', page_id, '.com') END AS domain,
               page_id % 3 <> 0 AS site_ok, page_id % 4 <> 0 AS dns_ok,
               CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS registry_active
        FROM {pages}""",
    "v_mail_probe": """
        SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'broken@@x.com' WHEN 1 THEN concat('ir@sub.firm', page_id, '.com') ELSE concat('info@firm', page_id, '.com') END AS email,
               CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'www.other.com' ELSE concat('https://firm', page_id, '.com') END AS company_domain,
               page_id % 6 <> 0 AS has_mx, CASE page_id % 5 WHEN 0 THEN 'undeliverable' WHEN 1 THEN 'deliverable' ELSE 'unknown' END AS smtp_result,
               CASE page_id % 7 WHEN 0 THEN 'bad' WHEN 1 THEN 'ok' ELSE 'unknown' END AS vendor_result
        FROM {pages}""",
    "v_address": """
        SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'kr' WHEN 1 THEN 'KR ' ELSE 'US' END AS country,
               CASE c_custkey % 6 WHEN 0 THEN '부산광역시 해운대구' WHEN 1 THEN '경기도 성남시' WHEN 2 THEN ' 제주시 ' WHEN 3 THEN '전라북도 전주시'
                    WHEN 4 THEN NULL ELSE 'Main St. 1' END AS address
        FROM {customer}""",
    "v_code": """
        SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '4210' WHEN 1 THEN '7372' WHEN 2 THEN '4911' WHEN 3 THEN '2834' WHEN 4 THEN '52'
                    WHEN 5 THEN '6209' WHEN 6 THEN '87310' WHEN 7 THEN '' ELSE CAST(p_size AS varchar(10)) END AS code
        FROM {part}""",
}
_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a generated table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    inputs = {n: table(spark, sf_dir, n) for n in sorted(set(_NAME.findall(text)))}
    return spark.sql(text, **inputs)


def with_views(body: str, *names: str) -> str:
    """The DuckDB query `body` with the views it needs before it; body may begin with further expressions after WITH."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _NAME.findall(VIEWS[name]):
                add(n)
            order.append(name)

    for n in names:
        add(n)
    if not order:
        return body.strip()
    parts = [f"{n} AS ({_NAME.sub(r'\1', VIEWS[n])})" for n in order]
    head, rest = ("WITH RECURSIVE ", body.strip())
    if rest.upper().startswith("WITH "):
        return head + ",\n".join(parts) + ",\n" + rest[5:]
    return head + ",\n".join(parts) + "\n" + rest
