"""Every query by name, and the SQL that checks it.

A query takes (spark, sf_dir) and returns a frame over whole tables; its SQL, where there is one, runs
in DuckDB on the same files and is written from the rule, not from the Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import dimensions as D
from rollcall.functions import identity, industry, mail, pages, verify
from rollcall.operators import enrichment, golden, greedy, leads, ledger, matching, outreach, queue, reporting, workbench
from rollcall.plans.views import table, with_views
from rollcall.sources import registers, scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

MONTH, BUDGET, NOW, SEND_NOW = "2024-01", 20_000, "1995-06-17 12:00:00", "2001-07-25 12:00:00"


def query(sql: str | None = None, *views: str):
    """Registers a function under its name, with its SQL over the views it names."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return f

    return add


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


# ---------------------------------------------------------------- SQL of the identity rules

_TOKENS = "list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z가-힣]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN (" + _in(D.LEGAL_SUFFIXES) + "))"
_HOST = "regexp_replace(regexp_extract(regexp_extract(regexp_replace(lower(trim({x})), '^[^/]*//', ''), '^([^/?#]*)', 1), '^(?:.*@)?([^:]*)', 1), '^www[.]', '')"


def _tokens(x: str) -> str:
    return _TOKENS.replace("{x}", x)


def _domain(x: str) -> str:
    labels = f"string_split({_HOST.replace('{x}', x)}, '.')"
    two = _in(D.TWO_LEVEL_LABELS)
    return (
        f"(CASE WHEN len({labels}) < 2 THEN NULL WHEN len({labels}) >= 3 AND {labels}[-2] IN ({two}) AND length({labels}[-1]) = 2 "
        f"THEN array_to_string({labels}[-3:], '.') ELSE array_to_string({labels}[-2:], '.') END)"
    )


def _reg(x: str) -> str:
    return f"nullif(regexp_replace(lower(trim({x})), '[^0-9a-z가-힣]+', '', 'g'), '')"


_ALIASES = "alias AS (SELECT * FROM (VALUES " + _values([(a, iso.lower()) for iso, _, al in D.COUNTRIES for a in al]) + ") AS t(alias, iso))"


@query(
    f"""WITH {_ALIASES}, n AS (
        SELECT m.key AS rec, registry, registry_id, {_domain('domain')} AS dom, array_to_string({_tokens('name')}, '') AS plain,
               coalesce(a.iso, lower(trim(coalesce(country, '')))) AS c
        FROM v_member m LEFT JOIN alias a ON a.alias = lower(trim(country)))
    SELECT rec, CASE WHEN coalesce(registry, '') <> '' AND coalesce(registry_id, '') <> '' THEN concat('reg:', lower(trim(registry)), ':', lower(trim(registry_id)))
                WHEN dom IS NOT NULL THEN concat('dom:', dom) WHEN plain <> '' THEN concat('name:', c, ':', plain) END AS canonical_key
    FROM n""",
    "v_member",
)
def q_canonical_key(spark, sf_dir):
    m = table(spark, sf_dir, "v_member")
    return m.select(F.col("key").alias("rec"), identity.canonical_key(*(F.col(c) for c in ("registry", "registry_id", "domain", "name", "country"))).alias("canonical_key"))


@query(f"SELECT key, {_domain('domain')} AS dom, {_reg('reg_no')} AS reg, array_to_string({_tokens('name')}, ' ') AS tokens FROM v_discovered", "v_discovered")
def q_normalized(spark, sf_dir):
    n = matching.normalised(table(spark, sf_dir, "v_discovered"))
    return n.select("key", "dom", "reg", F.array_join("tokens", " ").alias("tokens"))


@query(
    """SELECT company_id, concat('c_', left(sha1(company_id), 30)) AS cid, concat('k_', left(sha1(concat(company_id, '|email|', lower(name))), 30)) AS kid,
       concat('r_', left(sha1(concat(company_id, '|email')), 30)) AS rid, concat('e_', left(sha1(lower(name)), 38)) AS eid,
       sha1(concat(least(company_id, name), chr(0), greatest(company_id, name))) AS pid, left(name, 12) AS clipped,
       CASE WHEN is_active THEN 'O' ELSE 'X' END AS mark, concat(country, '/', industry, '/', listed) AS label FROM v_company""",
    "v_company",
)
def q_surrogate_ids(spark, sf_dir):
    c = table(spark, sf_dir, "v_company")
    i, n = F.col("company_id"), F.col("name")
    return c.select(
        "company_id", identity.company_id(i).alias("cid"), identity.contact_id(i, F.lit("email"), F.lower(n)).alias("kid"), identity.review_id(i, F.lit("email")).alias("rid"),
        identity.send_id(F.lower(n)).alias("eid"), identity.pair_id(i, n).alias("pid"), F.substring(n, 1, 12).alias("clipped"), F.when(F.col("is_active"), "O").otherwise("X").alias("mark"),
        F.concat("country", F.lit("/"), "industry", F.lit("/"), "listed").alias("label"),
    )


@query(
    "WITH r AS (SELECT * FROM (VALUES " + _values([(n, a, b) for n, (a, b) in enumerate(D.KR_REGIONS)]) + ") AS t(ord, alias, label)) "
    "SELECT c_custkey, CASE WHEN upper(trim(country)) = 'KR' THEN (SELECT arg_min(label, ord) FROM r WHERE starts_with(trim(address), alias)) END AS region FROM v_address",
    "v_address",
)
def q_region(spark, sf_dir):
    return table(spark, sf_dir, "v_address").select("c_custkey", identity.korean_region(F.col("country"), F.col("address")).alias("region"))


@query(f"WITH {_ALIASES} SELECT company_id, coalesce(a.iso, lower(trim(country))) AS iso FROM v_company LEFT JOIN alias a ON a.alias = lower(trim(country))", "v_company")
def q_country(spark, sf_dir):
    return table(spark, sf_dir, "v_company").select("company_id", identity.normal_country(F.col("country")).alias("iso"))


# ---------------------------------------------------------------- duplicates

_NORM = f"""norm AS MATERIALIZED (SELECT key, name, country, {_tokens('name')} AS tok, {_domain('domain')} AS dom, {_reg('reg_no')} AS reg FROM v_discovered)"""
_BLOCKS = """blk AS MATERIALIZED (
    SELECT key, 'reg' AS kind, country, reg AS bucket FROM norm WHERE reg IS NOT NULL
    UNION ALL SELECT key, 'dom', country, dom FROM norm WHERE dom IS NOT NULL
    UNION ALL SELECT key, 'name', country, left(array_to_string(tok, ''), 6) FROM norm WHERE array_to_string(tok, '') <> ''),
  sizes AS (SELECT kind, country, bucket, count(*) AS size FROM blk GROUP BY ALL HAVING count(*) > 1)"""


@query(f"WITH {_NORM}, {_BLOCKS} SELECT key, kind, country, bucket FROM blk", "v_discovered")
def q_blocks(spark, sf_dir):
    return matching.blocks(matching.normalised(table(spark, sf_dir, "v_discovered")))


@query(f"WITH {_NORM}, {_BLOCKS} SELECT * FROM sizes WHERE size > 10", "v_discovered")
def q_skipped_blocks(spark, sf_dir):
    return matching.skipped_blocks(table(spark, sf_dir, "v_discovered"), max_block=10)


def _round(part: str, whole: str) -> str:
    return f"((1000 * ({part})) // ({whole}) + CASE WHEN 2 * ((1000 * ({part})) % ({whole})) > ({whole}) OR (2 * ((1000 * ({part})) % ({whole})) = ({whole}) AND ((1000 * ({part})) // ({whole})) % 2 = 1) THEN 1 ELSE 0 END)"


_LCS = """list_last(list_reduce(list_transform(string_split(x, ''), lambda ch: [ch]), lambda r, ch:
    list_reduce(list_transform(range(1, length(y) + 1), lambda j: [j::VARCHAR]), lambda acc, j:
      list_append(acc, CASE WHEN substr(y, j[1]::INT, 1) = ch[1] THEN (r[j[1]::INT]::INT + 1)::VARCHAR
                            ELSE greatest(r[j[1]::INT + 1]::INT, acc[j[1]::INT]::INT)::VARCHAR END), ['0']),
    list_transform(range(0, length(y) + 1), lambda z: '0')))::INT"""
_SCORED = f"""
  prs AS (SELECT DISTINCT a.key AS a, b.key AS b FROM blk a JOIN blk b ON a.kind = b.kind AND a.country = b.country AND a.bucket = b.bucket AND a.key < b.key
          JOIN sizes s ON s.kind = a.kind AND s.country = a.country AND s.bucket = a.bucket WHERE s.size <= 1000),
  sided AS (SELECT p.a, p.b, l.country, l.dom AS da, r.dom AS db, l.reg AS ra, r.reg AS rb, l.country = r.country AS same_country, len(l.tok) AS na, len(r.tok) AS nb,
            array_to_string(list_sort(list_intersect(l.tok, r.tok)), ' ') AS i,
            array_to_string(list_sort(list_filter(list_distinct(l.tok), lambda t: NOT list_contains(r.tok, t))), ' ') AS x,
            array_to_string(list_sort(list_filter(list_distinct(r.tok), lambda t: NOT list_contains(l.tok, t))), ' ') AS y
            FROM prs p JOIN norm l ON l.key = p.a JOIN norm r ON r.key = p.b),
  lcs AS MATERIALIZED (SELECT *, length(i) AS ni, length(x) AS nx, length(y) AS ny, CASE WHEN i <> '' THEN 1 ELSE 0 END AS g,
            CASE WHEN x = '' OR y = '' THEN 0 ELSE {_LCS} END AS l FROM sided),
  scored AS MATERIALIZED (SELECT *, (CASE WHEN na = 0 OR nb = 0 THEN 0 WHEN ni > 0 AND (nx = 0 OR ny = 0) THEN 1000
            WHEN ni > 0 THEN greatest({_round('2 * ni + 2 * g + 2 * l', '2 * ni + 2 * g + nx + ny')}, {_round('2 * ni', '2 * ni + g + nx')}, {_round('2 * ni', '2 * ni + g + ny')})
            ELSE {_round('2 * l', 'greatest(nx + ny, 1)')} END)::INT AS name_score FROM lcs),
  tiers AS MATERIALIZED (SELECT a AS key_a, b AS key_b, country, da AS domain_a, db AS domain_b, name_score,
            CASE WHEN ra IS NOT NULL AND rb IS NOT NULL AND same_country AND ra = rb THEN 'reg_no'
                 WHEN ra IS NOT NULL AND rb IS NOT NULL AND same_country THEN CASE WHEN name_score >= 900 OR coalesce(da = db, false) THEN 'keep_both' END
                 WHEN da = db THEN CASE WHEN name_score >= 900 THEN 'auto' ELSE 'domain' END
                 WHEN da IS NOT NULL AND db IS NOT NULL THEN CASE WHEN name_score >= 900 THEN 'keep_both' END
                 WHEN name_score >= 900 THEN 'lexical' WHEN name_score >= 840 THEN 'shortlist' END AS tier FROM scored)"""
_TIERS = f"WITH {_NORM}, {_BLOCKS}, {_SCORED}"


def _candidates(spark, sf_dir) -> DataFrame:
    return matching.duplicate_candidates(table(spark, sf_dir, "v_discovered"))


@query(f"{_TIERS} SELECT * FROM tiers WHERE tier IS NOT NULL", "v_discovered")
def q_candidate_tiers(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(f"{_TIERS} SELECT tier, count(*) AS n FROM tiers WHERE tier IS NOT NULL GROUP BY tier", "v_discovered")
def q_tier_histogram(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


@query(
    f"{_TIERS} SELECT count(*) AS candidates, count(*) FILTER (tier IN ('reg_no', 'auto')) AS removable, count(*) FILTER (tier = 'keep_both') AS keep_both, "
    "count(*) FILTER (tier IN ('domain', 'lexical', 'shortlist')) AS to_judge FROM tiers WHERE tier IS NOT NULL",
    "v_discovered",
)
def q_dedup_report(spark, sf_dir):
    return matching.report(_candidates(spark, sf_dir))


@query(
    f"""{_TIERS}, ranked AS (SELECT *, row_number() OVER (ORDER BY CASE tier WHEN 'domain' THEN 1 WHEN 'lexical' THEN 2 ELSE 3 END, name_score DESC, key_a, key_b) AS rank
      FROM tiers WHERE tier IN ('domain', 'lexical', 'shortlist'))
    SELECT key_a, key_b, tier, rank, coalesce(domain_a = domain_b, false) AS same FROM ranked WHERE rank <= 50 AND (rank - 1) * 5 < 180""",
    "v_discovered",
)
def q_judged_pairs(spark, sf_dir):
    return matching.judged(_candidates(spark, sf_dir), cap=50, budget=180).select("key_a", "key_b", "tier", "rank", "same")


_COMPONENTS = f"""{_TIERS}, edge AS (SELECT key_a AS a, key_b AS b FROM tiers WHERE tier IN ('reg_no', 'auto') UNION SELECT key_b, key_a FROM tiers WHERE tier IN ('reg_no', 'auto')),
  walk AS (SELECT a AS k, b AS r FROM edge UNION SELECT w.k, e.b FROM walk w JOIN edge e ON e.a = w.r),
  comp AS MATERIALIZED (SELECT k AS key, least(min(r), k) AS cluster FROM walk GROUP BY k)"""


@query(f"{_COMPONENTS} SELECT * FROM comp", "v_discovered")
def q_components(spark, sf_dir):
    return golden.clusters(table(spark, sf_dir, "v_member"), golden.confirmed_pairs(_candidates(spark, sf_dir)))


_GOLDEN = f"""{_COMPONENTS}, mem AS (
    SELECT c.cluster, m.key, trim(m.name) AS name, (coalesce(registry, '') = '' OR coalesce(registry_id, '') = '')::INT AS no_reg, {_domain('m.domain')} AS dom,
           len({_tokens('m.name')}) AS nt, (NOT regexp_matches(m.name, '[^\\x00-\\x7F]'))::INT AS plain FROM comp c JOIN v_member m ON m.key = c.key),
  gold AS MATERIALIZED (SELECT cluster, first(key ORDER BY no_reg, (dom IS NULL)::INT, -nt, key) AS survivor_key, first(name ORDER BY no_reg, -nt, plain, key) AS canonical_name,
           first(dom ORDER BY no_reg, key) FILTER (dom IS NOT NULL) AS canonical_domain, list(key) AS keys FROM mem GROUP BY cluster)"""


def _golden(spark, sf_dir) -> DataFrame:
    return golden.golden_records(table(spark, sf_dir, "v_member"), golden.confirmed_pairs(_candidates(spark, sf_dir)))


@query(
    f"{_GOLDEN} SELECT survivor_key, canonical_name, canonical_domain, array_to_string(list_sort(list_filter(keys, lambda k: k <> survivor_key)), ',') AS absorbed FROM gold",
    "v_discovered", "v_member",
)
def q_golden(spark, sf_dir):
    return _golden(spark, sf_dir).select("survivor_key", "canonical_name", "canonical_domain", F.array_join("absorbed_keys", ",").alias("absorbed"))


#: A ledger with earlier merges: every ninth base row has been absorbed by the one before it, which has a canonical name.
_EARLIER = """earlier AS (SELECT key, CASE WHEN page_id % 6 = 5 THEN '' ELSE domain END AS domain,
      CASE WHEN key LIKE 'p%' AND page_id % 9 = 4 THEN concat('p', page_id - 1) END AS duplicate_of, CASE WHEN key LIKE 'p%' AND page_id % 9 = 4 THEN 'manual' END AS merge_reason,
      CASE WHEN key LIKE 'p%' AND page_id % 9 = 3 THEN concat('Earlier ', page_id) END AS canonical_name
    FROM v_member JOIN (SELECT key, page_id FROM v_discovered) USING (key))"""


@query(
    f"""{_GOLDEN}, {_EARLIER}, ok AS (SELECT g.* FROM gold g JOIN earlier e ON e.key = g.survivor_key WHERE e.duplicate_of IS NULL),
    ab AS (SELECT e.key, ok.survivor_key AS target FROM (SELECT survivor_key, unnest(keys) AS key FROM ok) ok JOIN earlier e ON e.key = ok.key WHERE e.key <> ok.survivor_key AND e.duplicate_of IS NULL)
    SELECT e.key, coalesce(ab.target, up.target, e.duplicate_of) AS duplicate_of,
      CASE WHEN ab.target IS NOT NULL THEN 'auto' WHEN up.target IS NOT NULL THEN 'auto (rechained)' ELSE e.merge_reason END AS merge_reason,
      CASE WHEN ok.survivor_key IS NOT NULL THEN ok.canonical_name ELSE e.canonical_name END AS canonical_name,
      CASE WHEN ok.canonical_domain IS NOT NULL AND coalesce(e.domain, '') = '' THEN ok.canonical_domain ELSE e.domain END AS domain
    FROM earlier e LEFT JOIN ab ON ab.key = e.key LEFT JOIN ab up ON up.key = e.duplicate_of LEFT JOIN ok ON ok.survivor_key = e.key""",
    "v_discovered", "v_member",
)
def q_merge_apply(spark, sf_dir):
    absorbed = "key like 'p%' AND page_id % 9 = 4"
    before = table(spark, sf_dir, "v_member").join(table(spark, sf_dir, "v_discovered").select("key", "page_id"), "key").selectExpr(
        "key", "CASE WHEN page_id % 6 = 5 THEN '' ELSE domain END AS domain", f"CASE WHEN {absorbed} THEN concat('p', page_id - 1) END AS duplicate_of",
        f"CASE WHEN {absorbed} THEN 'manual' END AS merge_reason", "CAST(NULL AS string) AS merged_by", "CAST(NULL AS timestamp) AS merged_at",
        "CASE WHEN key like 'p%' AND page_id % 9 = 3 THEN concat('Earlier ', page_id) END AS canonical_name",
    )
    after = golden.apply_golden(before, _golden(spark, sf_dir), "auto", F.lit(NOW).cast("timestamp"))
    return after.select("key", "duplicate_of", "merge_reason", "canonical_name", "domain")


_INLINE = f"WITH {_NORM}, prs AS (SELECT n.key AS a, o.key AS b FROM norm n JOIN norm o ON lower(n.country) = lower(o.country) AND n.dom = o.dom WHERE n.key LIKE 'q%' AND o.key LIKE 'p%'), " + _SCORED[_SCORED.index("  sided AS") :].strip()


@query(f"{_INLINE} SELECT a AS key, min(b) AS survivor FROM scored WHERE da = db AND name_score >= 900 GROUP BY a", "v_discovered")
def q_inline_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "v_discovered")
    return matching.inline_duplicates(d.where("key like 'q%'"), d.where("key like 'p%'"))


_LEXICAL = (
    f"WITH {_NORM}, pre AS (SELECT key, concat_ws('|', lower(country), left(array_to_string(tok, ''), 6)) AS block, key LIKE 'q%' AS fresh FROM norm WHERE array_to_string(tok, '') <> '' AND right(key, 1) <> '3'), "
    "ranked AS (SELECT *, CASE WHEN fresh THEN row_number() OVER (PARTITION BY block, fresh ORDER BY key) ELSE 0 END AS n, count(*) FILTER (NOT fresh) OVER (PARTITION BY block) AS held FROM pre), "
    "prs AS (SELECT DISTINCT least(n.key, o.key) AS a, greatest(n.key, o.key) AS b FROM ranked n JOIN ranked o USING (block) WHERE n.fresh AND n.n + n.held <= 1000 AND n.key <> o.key AND o.n < n.n), "
    + _SCORED[_SCORED.index("  sided AS") :].strip()
)


@query(
    f"{_LEXICAL} SELECT concat('name:', a) AS key_a, concat('name:', b) AS key_b, name_score, CASE WHEN name_score >= 900 THEN 'lexical' ELSE 'shortlist' END AS tier FROM scored WHERE name_score >= 840",
    "v_discovered",
)
def q_inline_lexical(spark, sf_dir):
    # rows whose id ends in 3 are known by domain, and so take no part
    d = table(spark, sf_dir, "v_discovered").withColumn("key", F.concat(F.when(F.col("key").rlike("3$"), "dom:").otherwise("name:"), "key"))
    return matching.inline_lexical(d.where("key rlike ':q'"), d.where("key rlike ':p'"))


def _discovery(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "v_discovered").select((F.col("page_id") * 2 + F.col("key").startswith("q").cast("int")).alias("seq"), identity.normal_name(F.col("name")).alias("k"), "domain")


@query(
    f"""WITH rows_ AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM (SELECT page_id * 2 + (key LIKE 'q%')::INT AS seq, nullif(array_to_string({_TOKENS.format(x='name')}, ''), '') AS k, domain FROM v_discovered)),
    pass_ AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS ks, []::VARCHAR[] AS ds, NULL::BIGINT AS seq, NULL::VARCHAR AS k, NULL::VARCHAR AS domain
      UNION ALL SELECT r.i, CASE WHEN ok AND r.k IS NOT NULL THEN list_append(ks, r.k) ELSE ks END, CASE WHEN ok AND r.domain IS NOT NULL THEN list_append(ds, r.domain) ELSE ds END,
        CASE WHEN ok THEN r.seq END, r.k, r.domain
      FROM (SELECT p.ks, p.ds, r.*, NOT (r.k IS NOT NULL AND list_contains(p.ks, r.k)) AND NOT (r.domain IS NOT NULL AND list_contains(p.ds, r.domain)) AS ok FROM pass_ p JOIN rows_ r ON r.i = p.i + 1) r)
    SELECT seq, k, domain FROM pass_ WHERE seq IS NOT NULL""",
    "v_discovered",
)
def q_greedy_discovery(spark, sf_dir):
    """Each row depends on which earlier ones stayed: the SQL is a sequential pass."""
    return greedy.greedy_distinct(_discovery(spark, sf_dir), "seq", ("k", "domain"))


# ---------------------------------------------------------------- the queue

_KR = queue.country_match_set(["KR"])


@query(
    f"SELECT review_id, status, name FROM v_queue q JOIN v_company c USING (company_id) WHERE claimed_by IS NULL AND lower(country) IN ({_in(_KR)}) AND listed = 'listed' "
    "ORDER BY status, name, review_id LIMIT 50 OFFSET 20",
    "v_queue", "v_company",
)
def q_queue_page(spark, sf_dir):
    return queue.page(table(spark, sf_dir, "v_queue"), table(spark, sf_dir, "v_company"), 50, 20, countries=["KR"], listed="listed").select("review_id", "status", "name")


@query(
    "SELECT status, count(*) AS n FROM v_queue q JOIN v_company c USING (company_id) WHERE claimed_by IS NULL AND industry IN ('건설', '제조') AND region IN ('서울') GROUP BY status",
    "v_queue", "v_company",
)
def q_queue_count(spark, sf_dir):
    rows = queue.unclaimed(table(spark, sf_dir, "v_queue"), table(spark, sf_dir, "v_company"), industries=["건설", "제조"], regions=["서울"])
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT region FROM v_company WHERE coalesce(trim(region), '') <> ''", "v_company")
def q_regions(spark, sf_dir):
    return table(spark, sf_dir, "v_company").where("coalesce(trim(region), '') <> ''").select("region").distinct()


@query(
    """WITH cand AS (SELECT *, CASE WHEN candidates = 'broken' THEN [] ELSE from_json(candidates, '["VARCHAR"]') END AS vals FROM v_queue),
    sig AS (SELECT company_id, value, arg_min(v.status, c.contact_id) AS st FROM v_contact c JOIN v_validation v USING (contact_id) WHERE type = 'email' GROUP BY ALL),
    form AS (SELECT company_id, arg_min(value, contact_id) AS form_url, arg_min(tenths, contact_id) AS t FROM v_contact WHERE type = 'form' GROUP BY company_id)
    SELECT review_id, status, array_to_string(vals, ',') AS vals, CASE WHEN list_contains(vals, selected) THEN selected ELSE vals[1] END AS effective, coalesce(listed, 'unknown') AS listed,
      form_url, coalesce(t < 4, false) AS low_confidence,
      coalesce((SELECT string_agg(coalesce(s.st, 'unverified'), ',' ORDER BY u.n) FROM (SELECT unnest(vals) AS v, unnest(range(len(vals))) AS n) u LEFT JOIN sig s ON s.company_id = cand.company_id AND s.value = u.v), '') AS statuses
    FROM cand LEFT JOIN v_company USING (company_id) LEFT JOIN form USING (company_id)""",
    "v_queue", "v_company", "v_contact", "v_validation",
)
def q_queue_items(spark, sf_dir):
    contact = table(spark, sf_dir, "v_contact").withColumn("confidence", F.col("tenths") / 10)
    shown = queue.items(table(spark, sf_dir, "v_queue"), table(spark, sf_dir, "v_company"), contact, table(spark, sf_dir, "v_validation"))
    return shown.select("review_id", "status", F.array_join("values", ",").alias("vals"), "effective", "listed", "form_url", "low_confidence", F.array_join("statuses", ",").alias("statuses"))


_REQUESTS = [(1, "u1", 15), (2, "u2", 300), (3, "u77", 30)]


@query(
    f"""WITH req AS (SELECT * FROM (VALUES {_values(_REQUESTS)}) AS t(ord, user_id, batch)),
    want AS (SELECT ord, r.user_id, greatest(0, least(batch, 100 - coalesce(h.n, 0))) AS want FROM req r LEFT JOIN
             (SELECT claimed_by, count(*) AS n FROM v_queue WHERE claimed_by IS NOT NULL AND status = 'pending' GROUP BY 1) h ON h.claimed_by = r.user_id),
    iv AS (SELECT user_id, sum(want) OVER (ORDER BY ord) AS hi, sum(want) OVER (ORDER BY ord) - want AS lo FROM want),
    free AS (SELECT review_id, row_number() OVER (ORDER BY review_id) AS n FROM v_queue WHERE claimed_by IS NULL AND status = 'pending')
    SELECT review_id, user_id FROM free JOIN iv ON n > lo AND n <= hi""",
    "v_queue",
)
def q_claim_alloc(spark, sf_dir):
    requests = spark.createDataFrame(_REQUESTS, "ord int, user_id string, batch int")
    return queue.allocate_claims(table(spark, sf_dir, "v_queue"), requests, cap=100)


@query(
    """WITH off AS (SELECT review_id, company_id, ['n@x.com', concat('a', o_custkey, '@x.com')] AS vals, concat('a', o_custkey, '@x.com') AS preferred FROM v_queue JOIN orders USING (o_orderkey) WHERE o_orderkey % 3 <> 1
      UNION ALL SELECT concat('new', review_id), company_id, ['z@x.com'], 'nobody@x.com' FROM v_queue WHERE o_orderkey % 50 = 0)
    SELECT coalesce(q.review_id, o.review_id) AS review_id, coalesce(q.status, 'pending') AS status,
      CASE WHEN o.review_id IS NULL THEN q.selected WHEN q.review_id IS NOT NULL AND selected_by_human AND coalesce(list_contains(vals, q.selected), false) THEN q.selected
           WHEN list_contains(vals, preferred) THEN preferred ELSE vals[1] END AS selected,
      CASE WHEN o.review_id IS NULL THEN q.selected_by_human ELSE q.review_id IS NOT NULL AND selected_by_human AND coalesce(list_contains(vals, q.selected), false) END AS selected_by_human
    FROM v_queue q FULL JOIN off o ON o.review_id = q.review_id""",
    "v_queue",
)
def q_enqueue_state(spark, sf_dir):
    q = table(spark, sf_dir, "v_queue")
    a = F.concat(F.lit("a"), F.expr("substring(company_id, 2)"), F.lit("@x.com"))
    known = q.where("o_orderkey % 3 <> 1").select("review_id", "company_id", F.array(F.lit("n@x.com"), a).alias("values"), a.alias("preferred"))
    fresh = q.where("o_orderkey % 50 = 0").select(F.concat(F.lit("new"), "review_id").alias("review_id"), "company_id", F.array(F.lit("z@x.com")).alias("values"), F.lit("nobody@x.com").alias("preferred"))
    return queue.enqueue(q, known.unionByName(fresh)).select("review_id", "status", "selected", "selected_by_human")


_DECISIONS = """d AS (SELECT review_id, CASE WHEN o_orderkey % 16 = 1 THEN 'gone' WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'pending' END AS st, CASE WHEN o_orderkey % 5 <> 0 THEN 'u4' END AS usr,
      CASE WHEN o_orderkey % 3 = 0 THEN vals[1] WHEN o_orderkey % 7 = 0 THEN 'x@y.z' END AS sel FROM (SELECT *, CASE WHEN json_valid(candidates) THEN from_json(candidates, '["VARCHAR"]') ELSE [] END AS vals FROM v_queue WHERE o_orderkey % 8 < 3)),
    j AS (SELECT q.*, d.st, d.sel, d.usr, coalesce(d.st IN ('pending', 'confirmed', 'rejected'), false) AND (claimed_by IS NULL OR coalesce(claimed_by = usr, false))
      AND (sel IS NULL OR coalesce(list_contains(CASE WHEN json_valid(candidates) THEN from_json(candidates, '["VARCHAR"]') ELSE [] END, sel), false)) AS ok FROM v_queue q LEFT JOIN d ON d.review_id = q.review_id)"""


def _decided(spark, sf_dir):
    q = table(spark, sf_dir, "v_queue")
    d = q.where("o_orderkey % 8 < 3").withColumn("vals", queue.parse_candidates(F.col("candidates"))).selectExpr(
        "review_id", "CASE WHEN o_orderkey % 16 = 1 THEN 'gone' WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'pending' END AS status", "CASE WHEN o_orderkey % 5 <> 0 THEN 'u4' END AS user_id",
        "CAST(NULL AS string) AS user_name", "CASE WHEN o_orderkey % 3 = 0 THEN get(vals, 0) WHEN o_orderkey % 7 = 0 THEN 'x@y.z' END AS selected",
    )
    return queue.decide(q, d, F.lit(NOW).cast("timestamp"))


@query(
    f"""WITH {_DECISIONS} SELECT review_id, CASE WHEN ok THEN st ELSE status END AS status, CASE WHEN ok AND st = 'confirmed' THEN NULL ELSE claimed_by END AS claimed_by,
      CASE WHEN ok THEN coalesce(sel, selected) ELSE selected END AS selected, CASE WHEN ok AND sel IS NOT NULL THEN true ELSE selected_by_human END AS selected_by_human FROM j""",
    "v_queue",
)
def q_set_status(spark, sf_dir):
    return _decided(spark, sf_dir)[0].select("review_id", "status", "claimed_by", "selected", "selected_by_human")


@query(f"WITH {_DECISIONS} SELECT review_id, usr AS actor_id, st AS action, coalesce(sel, selected) AS selected FROM j WHERE ok AND usr IS NOT NULL", "v_queue")
def q_decision_audit(spark, sf_dir):
    return _decided(spark, sf_dir)[1].select("review_id", "actor_id", "action", "selected")


@query("SELECT review_id, CASE WHEN claimed_by = 'u4' AND status = 'pending' THEN NULL ELSE claimed_by END AS claimed_by FROM v_queue", "v_queue")
def q_reclaim(spark, sf_dir):
    return queue.reclaim(table(spark, sf_dir, "v_queue"), "u4")[0].select("review_id", "claimed_by")


@query(
    """WITH a AS (SELECT actor_id AS user_id, count(*) FILTER (action = 'confirmed') AS confirmed, count(*) FILTER (action = 'rejected') AS rejected, max(ts) AS last_at FROM v_audit GROUP BY 1),
    h AS (SELECT claimed_by AS user_id, count(*) AS claimed FROM v_queue WHERE status = 'pending' AND claimed_by IS NOT NULL GROUP BY 1)
    SELECT user_id, coalesce(confirmed, 0) AS confirmed, coalesce(rejected, 0) AS rejected, last_at, coalesce(claimed, 0) AS claimed FROM v_user LEFT JOIN a USING (user_id) LEFT JOIN h USING (user_id)""",
    "v_user", "v_audit", "v_queue",
)
def q_user_stats(spark, sf_dir):
    return reporting.user_statistics(table(spark, sf_dir, "v_user"), table(spark, sf_dir, "v_audit"), table(spark, sf_dir, "v_queue"))


@query(
    """SELECT audit_id, a.review_id, action, actor_id, c.name AS company, ts FROM v_audit a JOIN v_queue q ON q.review_id = a.review_id LEFT JOIN v_company c ON c.company_id = q.company_id
    ORDER BY ts DESC, audit_id LIMIT 100""",
    "v_audit", "v_queue", "v_company",
)
def q_recent_audit(spark, sf_dir):
    return reporting.recent_audit(table(spark, sf_dir, "v_audit"), table(spark, sf_dir, "v_queue"), table(spark, sf_dir, "v_company"))


# ---------------------------------------------------------------- costs, statistics, mailings

_PRICED = "priced AS (SELECT e.*, coalesce(p.price, 0) AS unit_cost, greatest(units, 0) * coalesce(p.price, 0) AS cost, strftime(ts, '%Y-%m') AS month FROM v_cost_event e LEFT JOIN (VALUES " + _values(sorted(D.UNIT_PRICES.items())) + ") AS p(provider, price) ON p.provider = e.provider)"


def _costs(spark, sf_dir) -> DataFrame:
    return reporting.priced(table(spark, sf_dir, "v_cost_event"))


@query(f"WITH {_PRICED} SELECT month, sum(cost)::BIGINT AS cost, count(*) AS n FROM priced GROUP BY month", "v_cost_event")
def q_month_cost(spark, sf_dir):
    return _costs(spark, sf_dir).groupBy("month").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))


@query(f"WITH {_PRICED} SELECT provider, sum(cost)::BIGINT AS cost, sum(units)::BIGINT AS units FROM priced WHERE month = '{MONTH}' GROUP BY provider", "v_cost_event")
def q_provider_breakdown(spark, sf_dir):
    return reporting.cost_breakdown(_costs(spark, sf_dir), MONTH)


@query(
    f"WITH {_PRICED}, t AS (SELECT coalesce(sum(cost), 0)::BIGINT AS total FROM priced WHERE month = '{MONTH}') "
    f"SELECT '{MONTH}' AS month, total, {BUDGET}::BIGINT AS budget, greatest(0, {BUDGET} - total) AS remaining, round_even(total / {BUDGET} * 100, 1) AS pct, total >= {BUDGET} AS over FROM t",
    "v_cost_event",
)
def q_budget_report(spark, sf_dir):
    return reporting.budget_report(_costs(spark, sf_dir), MONTH, BUDGET)


@query(
    f"WITH {_PRICED}, s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY month ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM priced) "
    f"SELECT event_id, cost, spent FROM s WHERE spent < {BUDGET}",
    "v_cost_event",
)
def q_running_budget_stop(spark, sf_dir):
    return reporting.spent_until_budget(_costs(spark, sf_dir), BUDGET).select("event_id", "cost", "spent")


@query(
    """SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (has_email) AS with_email, count(*) FILTER (has_phone) AS with_phone,
    count(*) FILTER (has_form AND NOT has_email) AS with_form, count(*) FILTER (has_email AND status = 'valid') AS valid, count(*) FILTER (has_email AND status = 'risky') AS risky,
    count(*) FILTER (has_email AND status = 'invalid') AS invalid, count(*) FILTER (has_email AND smtp) AS smtp_ok FROM v_lead""",
    "v_lead",
)
def q_lead_stats(spark, sf_dir):
    return reporting.lead_statistics(table(spark, sf_dir, "v_lead"))


@query("SELECT coalesce(nullif(country, ''), '?') AS label, count(*) AS n FROM v_lead GROUP BY 1", "v_lead")
def q_lead_countries(spark, sf_dir):
    return reporting.histogram(table(spark, sf_dir, "v_lead"), "country")


@query(
    """SELECT country AS a, name AS b, coalesce(phone, '') AS c, CASE WHEN has_email THEN email ELSE '' END AS d, CASE WHEN has_form THEN form_url ELSE 'X' END AS e,
    coalesce(homepage, domain, '') AS f, '' AS g, '' AS h, industry AS i, CASE WHEN has_email THEN CASE WHEN status = 'valid' THEN 'O' ELSE 'X' END WHEN has_form THEN '사이트 내 문의폼' ELSE 'X' END AS j,
    CASE WHEN site_alive THEN 'O' ELSE 'X' END AS k, '' AS l FROM v_lead""",
    "v_lead",
)
def q_export_rows(spark, sf_dir):
    return reporting.export_rows(table(spark, sf_dir, "v_lead"))


_RECIPIENTS = """rec AS (SELECT lower(trim(selected)) AS email, min(company_id) AS company_id FROM v_queue JOIN v_company USING (company_id)
    WHERE status = 'confirmed' AND industry IN ('건설', '자동차', '전체') AND coalesce(trim(selected), '') <> '' GROUP BY 1),
  todo AS (SELECT * FROM rec WHERE email NOT IN (SELECT email FROM v_log WHERE status = 'sent'))"""


def _recipients(spark, sf_dir) -> DataFrame:
    return outreach.recipients(table(spark, sf_dir, "v_queue"), table(spark, sf_dir, "v_company"), table(spark, sf_dir, "v_log"), industries=["건설", "자동차", "전체"])


@query(f"WITH {_RECIPIENTS} SELECT * FROM todo", "v_queue", "v_company", "v_log")
def q_recipients(spark, sf_dir):
    return _recipients(spark, sf_dir)


_SENT = f"(SELECT count(*) FROM v_log WHERE status = 'sent' AND sent_at >= date_trunc('day', TIMESTAMP '{SEND_NOW}'))"


@query(f"WITH {_RECIPIENTS} SELECT *, concat('e_', left(sha1(email), 38)) AS send_id FROM todo ORDER BY email LIMIT greatest(0, 120 - {_SENT})", "v_queue", "v_company", "v_log")
def q_send_batch(spark, sf_dir):
    return outreach.batch(_recipients(spark, sf_dir), table(spark, sf_dir, "v_log"), F.lit(SEND_NOW).cast("timestamp"), quota=120)


@query(
    f"WITH {_RECIPIENTS} SELECT (SELECT count(*) FROM todo) AS recipients, greatest(0, 400 - {_SENT}) AS remaining, (SELECT string_agg(email, ',' ORDER BY email) FROM (SELECT email FROM todo ORDER BY email LIMIT 10)) AS sample",
    "v_queue", "v_company", "v_log",
)
def q_send_preview(spark, sf_dir):
    found = outreach.preview(_recipients(spark, sf_dir), table(spark, sf_dir, "v_log"), F.lit(SEND_NOW).cast("timestamp"))
    return found.withColumn("sample", F.array_join("sample", ","))


@query(
    """WITH f AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) AS n, min(second) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) AS oldest FROM v_failure)
    SELECT event_id, n, (CASE WHEN n >= 5 THEN greatest(1, oldest + 900 - second) ELSE 0 END)::BIGINT AS retry_after FROM f""",
    "v_failure",
)
def q_login_throttle(spark, sf_dir):
    return reporting.throttle(table(spark, sf_dir, "v_failure")).select("event_id", "n", "retry_after")


# ---------------------------------------------------------------- contacts and pages

@query(
    """SELECT company_id, string_agg(value || ':' || contact_id, ',' ORDER BY CASE role WHEN 'ir' THEN 0 ELSE 1 END, -tenths, value, contact_id) AS emails FROM v_contact
    WHERE type = 'email' AND role IN ('ir', 'general') GROUP BY company_id""",
    "v_contact",
)
def q_accepted_emails(spark, sf_dir):
    c = table(spark, sf_dir, "v_contact").where("type = 'email'")
    entry = F.struct(F.concat_ws(":", "value", "contact_id").alias("value"), "role", F.col("tenths").alias("confidence"))
    ranked = c.groupBy("company_id").agg(mail.rank_accepted(F.collect_list(entry)).alias("r")).where(F.size("r") > 0)
    return ranked.select("company_id", F.array_join("r.value", ",").alias("emails"))


_ROLE_LOCAL = "lower(split_part(coalesce(m, ''), '@', 1))"
_ROLE_TOKENS = "list_filter(string_split_regex(regexp_replace(regexp_replace(" + _ROLE_LOCAL + ", '([a-z])([0-9])', '\\1_\\2', 'g'), '([0-9])([a-z])', '\\1_\\2', 'g'), '[._-]+'), lambda t: t <> '')"


def _role_sql(m: str) -> str:
    out = "CASE "
    for name, keys in mail.ROLE_KEYS[:3]:
        ascii_keys, other = [k for k in keys if k.isascii()], [k for k in keys if not k.isascii()]
        hits = [f"list_has_any({_ROLE_TOKENS}, [{_in(ascii_keys)}])"] + [f"contains({_ROLE_LOCAL}, '{k}')" for k in other]
        out += f"WHEN {' OR '.join(hits)} THEN '{name}' "
    return (out + "ELSE 'general' END").replace("coalesce(m,", f"coalesce({m},")


@query(
    f"WITH a AS (SELECT p_partkey, concat(replace(lower(p_name), ' ', '.'), CASE p_partkey % 6 WHEN 0 THEN '.ir' WHEN 1 THEN 'hr-2' WHEN 2 THEN '_press' WHEN 3 THEN '투자' WHEN 4 THEN '.채용' ELSE '' END, '@x.com') AS m FROM part) SELECT p_partkey, {_role_sql('m')} AS role FROM a"
)
def q_role_classify(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat(replace(lower(p_name), ' ', '.'), CASE p_partkey % 6 WHEN 0 THEN '.ir' WHEN 1 THEN 'hr-2' WHEN 2 THEN '_press' WHEN 3 THEN '투자' WHEN 4 THEN '.채용' ELSE '' END, '@x.com') AS m"
    )
    return rows.select("p_partkey", mail.role(F.col("m")).alias("role"))


_ADDR = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}"
_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_DEOB = r"regexp_replace(regexp_replace(replace({x}, '＠', '@'), '(?i)\s*[(\[{{]\s*(?:at|골뱅이)\s*[)\]}}]\s*', '@', 'g'), '(?i)\s*[(\[{{]\s*(?:dot|닷|점)\s*[)\]}}]\s*', '.', 'g')"


_MAILS = rf"""WITH raw AS (
      SELECT page_id, 0 AS pass, 9 AS confidence, unnest(regexp_extract_all(unnest_link, '({_ADDR})', 1)) AS r FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']mailto:([^"''?]*)', 1)) AS unnest_link FROM v_html)
      UNION ALL SELECT page_id, 1, 9, 'ir@dsrob.example' FROM v_html WHERE false
      UNION ALL SELECT page_id, 1, 9, unnest(regexp_extract_all(d, '({_ADDR})', 1)) FROM (SELECT page_id, (SELECT string_agg(chr(xor(('0x' || substr(h, i * 2 + 1, 2))::INT, ('0x' || substr(h, 1, 2))::INT)), '' ORDER BY i) FROM (SELECT unnest(range(1, length(h) // 2)) AS i)) AS d
            FROM (SELECT page_id, unnest(regexp_extract_all(html, 'data-cfemail=["'']([0-9a-fA-F]*)["'']', 1)) AS h FROM v_html))
      UNION ALL SELECT page_id, 2, 6, unnest(regexp_extract_all({_DEOB.format(x=f'left({_VISIBLE}, 200000)')}, '({_ADDR})', 1)) FROM v_html
      UNION ALL SELECT page_id, 3, 4, unnest(regexp_extract_all(left(html, 200000), '({_ADDR})', 1)) FROM v_html),
    a AS (SELECT page_id, pass, confidence, lower(trim(trim(r), '.')) AS value FROM raw),
    g AS (SELECT *, {_role_sql('value')} AS role, split_part(value, '@', -1) AS dom FROM a WHERE value <> '')
    SELECT page_id, value, role, arg_min(confidence, pass) AS confidence FROM g
    WHERE role IN ('ir', 'general') AND split_part(dom, '.', -1) NOT IN ({_in(mail.ASSET_ENDINGS)}) AND NOT ({' OR '.join(f"dom = '{d}' OR ends_with(dom, '.{d}')" for d in mail.PLACEHOLDER_DOMAINS)})
    GROUP BY page_id, value, role"""


@query(_MAILS, "v_html")
def q_extract_emails(spark, sf_dir):
    return pages.page_emails(table(spark, sf_dir, "v_html"))


_CALLS = r"""WITH r AS (SELECT page_id, unnest(l) AS value, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']tel:([^"'']*)', 1) AS l FROM v_html)),
    d AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM r)
    SELECT page_id, digits, trim(arg_min(value, pos)) AS value FROM d WHERE length(digits) BETWEEN 8 AND 15 GROUP BY page_id, digits"""


@query(_CALLS, "v_html")
def q_phones(spark, sf_dir):
    return pages.page_phones(table(spark, sf_dir, "v_html"))


# Links, images and forms: every page gets some more of them, written in ways that are easy to misread.
_TRICKS = """concat(html, '<!-- <a href="/contact/hidden">c</a> --><script>var a = "<a href=/ir/hidden>x</a><img src=/hidden-mail.png><form action=/contact><textarea>";</script>',
    '<a class="x>y" href=/ir/plain>one</a><a data-x="href=/no" title=''a "b"'' href = "https://www.ir-site.com/x">other</a><a href="../about/', page_id % 4, '?a=1&amp;b=2">who <b>we</b> are</a><a HREF="/pdf/ir.PDF">ir</a><a href="#ir">i</a>',
    '<a href="javascript:ir()">i</a><a name="ir">no link</a><a href="">ir</a><a href="/ir/plain">again</a><a href="/news">a<a href="/company', page_id % 3, '">b</a><img src=/pic', page_id % 5, '.jpg?v=1><img alt="E-MAIL" src="b.webp"><img src="/c.svg">',
    '<img data-src="/no.png"><iframe title="x" src="', CASE WHEN page_id % 9 = 1 THEN 'https://a.typeform.com/to/x' ELSE 'https://ads.com/?u=typeform.com' END, '"></iframe><form class="q"><input type="text" name="q"><input type=hidden></form>',
    '<form action=''/newsletter'' name="Contact"><input type="email"></form><form role="search" id="contact"><input><input></form><form action="./ask?to=', page_id % 6, '"><p>', CASE WHEN page_id % 3 = 0 THEN '견적문의' ELSE 'words' END, '</p><input><select></select></form>')"""
_MARKUP = """regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '<!>', 'g'), '(?is)<script[\\s>].*?</script', '<!', 'g'), '(?is)<style[\\s>].*?</style', '<!', 'g')"""
_PIECES = "list_filter(list_transform(range(2, len(w) + 1), lambda i: w[i]), lambda x: true)"


def _attr_sql(x: str, name: str) -> str:
    """An attribute from the text of a start tag, whose other quoted values were emptied of the name."""
    found = f"regexp_extract({x}, '(?is)(?:^|\\s)' || '{name}' || '\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))', ['a', 'b', 'c'])"
    return f"replace(concat({found}.a, {found}.b, {found}.c), '&amp;', '&')"


def _elements_sql(name: str, of: str, *attrs: str) -> str:
    """Rows (page_id, url, pos, body and attributes) of the elements of a name of the table `of` with a column m."""
    return f"""(SELECT page_id, url, pos, {''.join(_attr_sql('head', a) + f' AS "{a}", ' for a in attrs)} string_split_regex(rest, '(?i)</{name}[\\s/>]')[1] AS body FROM (SELECT page_id, url, pos, regexp_extract(p, '(?s)^((?:[^>"'']|"[^"]*"|''[^'']*'')*)>?(.*)$', 1) AS head, regexp_extract(p, '(?s)^((?:[^>"'']|"[^"]*"|''[^'']*'')*)>?(.*)$', 2) AS rest
      FROM (SELECT page_id, url, unnest(w[2:]) AS p, unnest(range(1, len(w))) AS pos FROM (SELECT page_id, url, string_split_regex(m, '(?i)<{name}[\\s/>]') AS w FROM {of}))))"""


_BASE = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_FOLDER = "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/(?:[^?#]*/)?)', 1), ''), '/')"
#: Of ../ and ./ before the first segment; the pages have no others.
_UP = "regexp_replace(regexp_replace(concat({f}, {x}), '/\\./', '/'), '/(?:[^/?#]*/)?\\.\\./', '/')"


def _joined_sql(x: str) -> str:
    return f"""(CASE WHEN regexp_matches({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {x} WHEN starts_with({x}, '//') THEN concat(split_part(url, '//', 1), {x}) WHEN starts_with({x}, '?') THEN concat(regexp_extract(url, '^([^?#]*)', 1), {x})
      WHEN starts_with({x}, '/') THEN concat({_BASE}, {x}) ELSE concat({_BASE}, {_UP.replace('{f}', _FOLDER).replace('{x}', x)}) END)"""


def _pages_sql(h: str) -> str:
    return f"t AS (SELECT page_id, url, {h} AS h FROM v_html), pg AS MATERIALIZED (SELECT page_id, url, {_MARKUP} AS m FROM t)"


_PAGES_M = _pages_sql(_TRICKS)


def _tricky(spark, sf_dir) -> DataFrame:
    return spark.sql(f"SELECT page_id, url, {_TRICKS} AS html FROM {{v_html}}", v_html=table(spark, sf_dir, "v_html"))


def _hints(x: str, hints: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{h}')" for h in hints) + ")"


@query(
    f"""WITH {_PAGES_M}, a AS (SELECT page_id, url, pos, trim(href) AS href, lower(concat(trim(href), ' ', regexp_replace(body, '<[^>]+>', '', 'g'))) AS hint FROM {_elements_sql('a', 'pg', 'href')}),
    l AS (SELECT *, {_joined_sql('href')} AS link FROM a WHERE href <> '' AND NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#)')),
    s AS (SELECT *, CASE WHEN {_hints('hint', pages.IR_HINTS)} THEN 0 WHEN {_hints('hint', pages.CONTACT_HINTS)} THEN 1 END AS kind, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS nth FROM l
      WHERE regexp_matches(link, '^https?://') AND NOT regexp_matches(lower(link), '({"|".join(e.replace(".", "[.]") for e in pages.SKIPPED_ENDINGS)})$') AND {_domain('link')} = {_domain('url')}),
    f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM s WHERE nth = 1 AND kind IS NOT NULL)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY kind, pos) - 1)::INT AS ord, link, kind::INT AS kind FROM f WHERE n <= 20""",
    "v_html",
)
def q_candidate_links(spark, sf_dir):
    return pages.candidate_links(_tricky(spark, sf_dir))


@query(
    f"""WITH {_PAGES_M}, i AS (SELECT page_id, url, pos, trim(src) AS src, alt FROM {_elements_sql('img', 'pg', 'src', 'alt')}),
    l AS (SELECT *, {_joined_sql('src')} AS link FROM i WHERE src <> '' AND NOT starts_with(src, 'data:')),
    s AS (SELECT *, CASE WHEN {_hints("lower(concat(src, ' ', alt))", pages.MAIL_IMAGE_HINTS)} THEN 0 ELSE 1 END AS plain, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS nth FROM l
      WHERE regexp_matches(link, '^https?://') AND regexp_matches(lower(split_part(link, '?', 1)), '({"|".join(e.replace(".", "[.]") for e in pages.IMAGE_ENDINGS)})$')),
    f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM s WHERE nth = 1)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY plain, pos) - 1)::INT AS ord, link FROM f WHERE n <= 5""",
    "v_html",
)
def q_candidate_images(spark, sf_dir):
    return pages.candidate_images(_tricky(spark, sf_dir))


_QUIET = "('hidden', 'submit', 'button', 'checkbox', 'radio', 'image', 'reset')"
_FORMS = f"""fr AS (SELECT page_id, url, pos, {_joined_sql('trim(src)')} AS link FROM {_elements_sql('iframe', 'pg', 'src')} WHERE trim(src) <> ''),
    em AS (SELECT page_id, arg_min(link, pos) AS link FROM fr WHERE regexp_matches(lower(link), '^https?://([^/?#]*[.])?({"|".join(h.replace(".", "[.]") for h in pages.FORM_HOSTS)})([/?#]|$)') GROUP BY page_id),
    fo AS MATERIALIZED (SELECT page_id, url, pos, action, lower("role") AS rl, lower(concat_ws(' ', action, id, "class", "name", "aria-label")) AS names, body, lower(regexp_replace(body, '<[^>]+>', '', 'g')) AS txt, regexp_matches(body, '(?i)<textarea[\\s/>]') AS msg FROM {_elements_sql('form', 'pg', 'action', 'id', 'class', 'name', 'aria-label', 'role')}),
    inp AS (SELECT page_id, url AS fat, lower(coalesce(nullif("type", ''), 'text')) AS ty FROM {_elements_sql('input', '(SELECT page_id, pos AS url, body AS m FROM fo)', 'type')}),
    cnt AS (SELECT fo.page_id, fo.pos, count(*) FILTER (ty = 'password') AS pw, count(*) FILTER (ty = 'search') AS se, count(*) FILTER (ty NOT IN {_QUIET}) + any_value(len(regexp_extract_all(body, '(?i)<(?:textarea|select)[\\s/>]'))) AS n FROM fo LEFT JOIN inp ON inp.page_id = fo.page_id AND inp.fat = fo.pos GROUP BY ALL),
    ok AS (SELECT fo.*, CASE WHEN msg THEN 60 ELSE 45 END AS conf FROM fo JOIN cnt ON cnt.page_id = fo.page_id AND cnt.pos = fo.pos
      WHERE ({_hints('names', pages.FORM_HINTS)} OR {_hints('txt', pages.FORM_HINTS)}) AND NOT (pw > 0 OR rl = 'search' OR (se > 0 AND n <= 1) OR (NOT msg AND n <= 1 AND {_hints('names', pages.FORM_EXCLUDED)}))),
    best AS (SELECT page_id, first(CASE WHEN action = '' THEN url ELSE {_joined_sql('action')} END ORDER BY conf DESC, pos) AS form_url, max(conf) AS conf FROM ok GROUP BY page_id),
    formed AS (SELECT coalesce(em.page_id, best.page_id) AS page_id, coalesce(em.link, best.form_url) AS form_url, CASE WHEN em.link IS NOT NULL THEN 70 ELSE best.conf END::INT AS confidence FROM em FULL JOIN best ON best.page_id = em.page_id)"""


@query(f"WITH {_PAGES_M}, {_FORMS} SELECT * FROM formed", "v_html")
def q_forms(spark, sf_dir):
    return pages.page_form(_tricky(spark, sf_dir))


@query(
    f"""SELECT page_id, trim(coalesce(html, '')) = '' OR (({' OR '.join(f"contains(t, '{m}')" for m in pages.PARKED_MARKERS)}) AND length(t) < 200)
       OR (length(t) < 20 AND NOT regexp_matches(bare, '(?i)<(a[ >]|img)')) AS parked
    FROM (SELECT page_id, html, lower({_VISIBLE}) AS t, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS bare FROM
      (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<p>Buy this domain</p>' WHEN 1 THEN '<script>x</script><p>hi</p>' WHEN 2 THEN '<img src=a>' ELSE html END AS html FROM pages))"""
)
def q_parked(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id", "CASE page_id % 4 WHEN 0 THEN '<p>Buy this domain</p>' WHEN 1 THEN '<script>x</script><p>hi</p>' WHEN 2 THEN '<img src=a>' ELSE html END AS html")
    return p.select("page_id", pages.looks_parked(F.col("html")).alias("parked"))


@query(
    r"""WITH p AS (SELECT page_id, lower(regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path, lower(concat_ws(' ', regexp_extract(html, '(?is)<title>(.*?)</title>', 1), array_to_string(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ' '))) AS heads
        FROM (SELECT page_id, html, CASE page_id % 5 WHEN 0 THEN concat(url, '/contact') WHEN 1 THEN 'https://x.com/contact-us/a' WHEN 2 THEN 'https://x.com/문의하기' ELSE url END AS u FROM pages))
    SELECT page_id, list_has_any(string_split_regex(path, '[/_.\-]+'), ['contact', 'contactus', 'inquiry', 'enquiry']) OR contains(path, '문의')
      OR contains(heads, '문의') OR contains(heads, 'contact us') OR contains(heads, 'contactus') OR contains(heads, 'inquiry') OR contains(heads, 'enquiry') AS contact FROM p"""
)
def q_contact_page(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id", "html", "CASE page_id % 5 WHEN 0 THEN concat(url, '/contact') WHEN 1 THEN 'https://x.com/contact-us/a' WHEN 2 THEN 'https://x.com/문의하기' ELSE url END AS u")
    return p.select("page_id", pages.is_contact_page(F.col("u"), F.col("html")).alias("contact"))


@query(f"SELECT page_id, left({_VISIBLE}, 2000) AS text FROM pages")
def q_page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.summary_text(F.col("html")).alias("text"))


# ---------------------------------------------------------------- ladders

@query(
    """SELECT page_id, coalesce(registry_active, alive) AS is_active, alive AS site_alive,
      CASE WHEN registry_active IS NOT NULL THEN 90 WHEN alive AND coalesce(dns_ok, false) THEN 85 WHEN alive THEN 70 ELSE 0 END AS hundredths
    FROM (SELECT *, coalesce(domain, '') <> '' AND coalesce(site_ok, false) AS alive FROM v_probe)""",
    "v_probe",
)
def q_existence(spark, sf_dir):
    p = table(spark, sf_dir, "v_probe")
    return p.select("page_id", verify.existence(F.col("domain"), F.col("site_ok"), F.col("dns_ok"), F.col("registry_active")).alias("r")).select("page_id", "r.*")


@query(
    f"""WITH a AS (SELECT *, len(string_split(email, '@')) = 2 AND contains(split_part(email, '@', 2), '.') AS good, {_domain("split_part(email, '@', -1)")} AS own, {_domain('company_domain')} AS wanted FROM v_mail_probe),
    b AS (SELECT *, good AND has_mx AS mx, good AND coalesce(company_domain, '') <> '' AND own IS NOT DISTINCT FROM wanted AS domain_match FROM a),
    c AS (SELECT *, CASE WHEN NOT mx THEN 'invalid' WHEN domain_match OR coalesce(company_domain, '') = '' THEN 'valid' ELSE 'risky' END AS base, CASE WHEN mx AND smtp_result = 'deliverable' THEN true WHEN mx AND smtp_result = 'undeliverable' THEN false END AS smtp FROM b),
    d AS (SELECT *, CASE WHEN smtp = false THEN 'invalid' WHEN smtp AND base = 'risky' THEN 'valid' ELSE base END AS after FROM c)
    SELECT page_id, CASE WHEN after <> 'invalid' AND vendor_result = 'bad' THEN 'invalid' WHEN after = 'risky' AND vendor_result = 'ok' THEN 'valid' ELSE after END AS status, domain_match, smtp,
      CASE WHEN NOT good THEN NULL WHEN after <> 'invalid' AND vendor_result IN ('bad', 'ok') THEN 'zerobounce' WHEN smtp IS NOT NULL THEN 'smtp' ELSE 'mx' END AS provider FROM d""",
    "v_mail_probe",
)
def q_email_validation(spark, sf_dir):
    p = table(spark, sf_dir, "v_mail_probe")
    r = verify.email_validation(*(F.col(c) for c in ("email", "company_domain", "has_mx", "smtp_result", "vendor_result")), vendor="zerobounce")
    return p.select("page_id", r.alias("r")).select("page_id", "r.*")


#: Words of a register, by o_orderkey % 12.
_STATES = ("active", "registered", "open", "dissolved", "liquidation", "receivership", "administration", "converted-closed", "insolvency-proceedings", "removed", "closed", "voluntary-arrangement")


@query(
    f"""SELECT o_orderkey, CASE reg WHEN 'companies_house' THEN CASE WHEN o_orderkey % 12 < 3 THEN true WHEN o_orderkey % 12 < 11 THEN false END WHEN 'opencorporates' THEN NOT gone END AS active
    FROM (SELECT o_orderkey, CASE o_orderkey % 7 % 3 WHEN 0 THEN 'companies_house' WHEN 1 THEN 'opencorporates' ELSE 'other' END AS reg,
          CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS gone FROM orders)"""
)
def q_registry_active(spark, sf_dir):
    states = ", ".join(f"' {x.title()} '" for x in _STATES)
    p = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE o_orderkey % 7 % 3 WHEN 0 THEN 'Companies_House' WHEN 1 THEN 'opencorporates' ELSE 'other' END AS reg", f"get(array({states}), cast(o_orderkey % 12 as int)) AS st",
        "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS gone",
    )
    return p.select("o_orderkey", verify.registry_status(F.col("reg"), F.col("st"), F.col("gone")).alias("active"))


def _prefix_sql(t: dict[str, tuple[str, ...]]) -> str:
    pairs = sorted({(D.TO_TAXONOMY[k], p) for k, v in t.items() if k in D.TO_TAXONOMY for p in v if p not in D.DENIED_PREFIXES})
    return f"""WITH pre AS (SELECT * FROM (VALUES {_values(pairs)}) AS t(label, prefix)),
      hit AS (SELECT p_partkey, length(prefix) AS n, list(DISTINCT label) AS ls FROM v_code JOIN pre ON starts_with(code, prefix) GROUP BY 1, 2),
      best AS (SELECT p_partkey, arg_max(ls, n) AS ls FROM hit GROUP BY 1)
      SELECT p_partkey, CASE WHEN len(ls) = 1 THEN ls[1] END AS label FROM v_code LEFT JOIN best USING (p_partkey)"""


@query(_prefix_sql(D.SIC), "v_code")
def q_industry_sic(spark, sf_dir):
    return industry.label_from_code(table(spark, sf_dir, "v_code"), D.SIC, "p_partkey")


@query(_prefix_sql(D.KSIC), "v_code")
def q_industry_ksic(spark, sf_dir):
    return industry.label_from_code(table(spark, sf_dir, "v_code"), D.KSIC, "p_partkey")


@query(_prefix_sql(D.UK_SIC), "v_code")
def q_industry_uk_sic(spark, sf_dir):
    return industry.label_from_code(table(spark, sf_dir, "v_code"), D.UK_SIC, "p_partkey")


@query(
    f"""SELECT company_id, lower(trim(industry)) IN ({_in(D.BROAD_INDUSTRY)}) AS broad, CASE WHEN lower(trim(industry)) IN ({_in(D.BROAD_INDUSTRY)}) THEN CASE WHEN c_custkey % 2 = 0 THEN '은행' ELSE '{D.UNCLASSIFIED}' END ELSE industry END AS label,
      coalesce(e.term, trim(industry)) AS term FROM v_company LEFT JOIN (VALUES {_values(D.EN_INDUSTRY.items())}) AS e(k, term) ON e.k = lower(trim(industry))""",
    "v_company",
)
def q_industry_label(spark, sf_dir):
    c = table(spark, sf_dir, "v_company")
    code = F.when(F.col("c_custkey") % 2 == 0, "은행")
    return c.select("company_id", industry.is_broad(F.col("industry")).alias("broad"), industry.resolve_label(F.col("industry"), code).alias("label"), industry.search_term(F.col("industry")).alias("term"))


@query(
    "WITH kw AS (SELECT * FROM (VALUES " + _values([(n, w, x) for n, (w, x) in enumerate(D.KEYWORD_LABELS)]) + ") AS t(ord, word, label)) "
    "SELECT p_partkey, (SELECT arg_min(label, ord) FROM kw WHERE contains(hay, word)) AS label FROM (SELECT p_partkey, lower(concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' Bank of Steel' WHEN 1 THEN ' Foods' WHEN 2 THEN ' 반도체 display' ELSE '' END)) AS hay FROM part)"
)
def q_industry_keywords(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' Bank of Steel' WHEN 1 THEN ' Foods' WHEN 2 THEN ' 반도체 display' ELSE '' END) AS hay")
    return p.select("p_partkey", industry.label_from_words(F.col("hay")).alias("label"))


# ---------------------------------------------------------------- ledger changes and sources

@query(
    f"""SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN n.name ELSE o.name END AS name, CASE WHEN o.key IS NULL THEN n.domain ELSE o.domain END AS domain, CASE WHEN n.key IS NOT NULL THEN TIMESTAMP '{NOW}' END AS last_crawled_at
    FROM (SELECT * FROM v_member WHERE key LIKE 'p%') o FULL JOIN (SELECT replace(key, 'q', CASE WHEN page_id % 4 = 0 THEN 'p' ELSE 'q' END) AS key, name, domain FROM v_discovered WHERE key LIKE 'q%') n ON n.key = o.key""",
    "v_member", "v_discovered",
)
def q_upsert_discovered(spark, sf_dir):
    old = table(spark, sf_dir, "v_member").where("key like 'p%'").select("key", "name", "domain", F.lit(None).cast("timestamp").alias("last_crawled_at"))
    new = table(spark, sf_dir, "v_discovered").where("key like 'q%'").selectExpr("replace(key, 'q', CASE WHEN page_id % 4 = 0 THEN 'p' ELSE 'q' END) AS key", "name", "domain")
    return ledger.save_discovered(old, new, F.lit(NOW).cast("timestamp"))


@query(
    """WITH r AS (SELECT concat('d', page_id % 60) AS key, page_id AS seq, name FROM v_base)
    SELECT key, min(seq) AS seq, arg_min(name, seq) AS name FROM r WHERE key NOT IN (SELECT concat('d', page_id) FROM v_base WHERE page_id < 20) GROUP BY key""",
    "v_base",
)
def q_import_seed(spark, sf_dir):
    b = table(spark, sf_dir, "v_base")
    rows = b.select(F.concat(F.lit("d"), (F.col("page_id") % 60).cast("string")).alias("key"), F.col("page_id").alias("seq"), "name")
    return ledger.insert_only(b.where("page_id < 20").select(F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("key")), rows, "seq")


@query(
    """WITH d AS (SELECT DISTINCT concat('c', s_suppkey) AS company_id, 'email' AS type, concat('new', s_suppkey, '@x.com') AS value FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT contact_id, company_id, type, value FROM v_contact WHERE company_id NOT IN (SELECT company_id FROM d)
    UNION ALL SELECT concat('k_', left(sha1(concat(company_id, '|', type, '|', value)), 30)), company_id, type, value FROM d""",
    "v_contact",
)
def q_replace_contacts(spark, sf_dir):
    desired = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").selectExpr("concat('c', s_suppkey) AS company_id", "'email' AS type", "concat('new', s_suppkey, '@x.com') AS value")
    return ledger.replace_contacts(table(spark, sf_dir, "v_contact").select("contact_id", "company_id", "type", "value"), desired)


@query(
    f"""WITH {_ALIASES}, k AS (SELECT DISTINCT concat('name:', lower(country), ':', lower(replace(name, '#', ''))) AS key FROM v_company),
    m AS (SELECT key AS old, concat('name:', coalesce(a.iso, split_part(key, ':', 2)), ':', split_part(key, ':', 3)) AS new FROM k LEFT JOIN alias a ON a.alias = split_part(key, ':', 2))
    SELECT * FROM m WHERE old <> new""",
    "v_company",
)
def q_rekey_country(spark, sf_dir):
    keys = table(spark, sf_dir, "v_company").selectExpr("concat('name:', lower(country), ':', lower(replace(name, '#', ''))) AS key").distinct()
    return ledger.rekey_map(keys)


@query("SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 0 AND 999 THEN o_custkey ELSE 0 END::BIGINT AS position FROM orders")
def q_cursor_advance(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ledger.advance_cursor(F.col("o_custkey"), F.lit(1000)).cast("long").alias("position"))


@query(
    f"""{_TIERS}, n AS (SELECT sha1(concat(least(key_a, key_b), chr(0), greatest(key_a, key_b))) AS id, * FROM tiers WHERE tier IN ('domain', 'lexical', 'shortlist'))
    SELECT id, key_a, key_b, CASE WHEN left(id, 1) < '4' AND left(id, 1) >= '2' THEN 'old' ELSE tier END AS tier, CASE WHEN left(id, 1) < '2' THEN 'pending' WHEN left(id, 1) < '4' THEN 'separated' ELSE 'pending' END AS status FROM n""",
    "v_discovered",
)
def q_populate_candidates(spark, sf_dir):
    found = _candidates(spark, sf_dir)
    ids = found.where(F.col("tier").isin("domain", "lexical", "shortlist")).withColumn("id", identity.pair_id(F.col("key_a"), F.col("key_b")))
    known = ids.where("left(id, 1) < '4'").select("id", "key_a", "key_b", F.lit("old").alias("tier"), F.lit(0).alias("name_score"), F.when(F.expr("left(id, 1) < '2'"), "pending").otherwise("separated").alias("status"))
    return ledger.populate_candidates(known, found).drop("name_score")


# ---------------------------------------------------------------- workbench and leads

#: The uncertain candidates as a workbench: a third each pending, merged and separated; some keys have left the ledger.
_BENCH = f"""{_TIERS}, bench AS (SELECT sha1(concat(least(key_a, key_b), chr(0), greatest(key_a, key_b))) AS id, least(key_a, key_b) AS key_a, greatest(key_a, key_b) AS key_b, tier, name_score FROM tiers
      WHERE tier IN ('domain', 'lexical', 'shortlist')),
    work AS (SELECT *, CASE WHEN left(id, 1) < '9' THEN 'pending' WHEN left(id, 1) < 'd' THEN 'merged' ELSE 'separated' END AS status FROM bench),
    book AS (SELECT key, name, country, domain FROM v_discovered WHERE page_id % 7 <> 3)"""


def _bench(spark, sf_dir) -> DataFrame:
    found = _candidates(spark, sf_dir).where(F.col("tier").isin("domain", "lexical", "shortlist"))
    a, b = F.least("key_a", "key_b"), F.greatest("key_a", "key_b")
    first = F.substring("id", 1, 1)
    rows = found.select(identity.pair_id(F.col("key_a"), F.col("key_b")).alias("id"), a.alias("key_a"), b.alias("key_b"), "tier", "name_score")
    return rows.withColumn("status", F.when(first < "9", "pending").when(first < "d", "merged").otherwise("separated"))


def _book(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "v_discovered").where("page_id % 7 <> 3").select("key", "name", "country", "domain")


_ITEM = """SELECT w.id, w.key_a, w.key_b, w.tier, w.name_score, w.status, a.name AS name_a, b.name AS name_b, coalesce(nullif(a.country, ''), nullif(b.country, ''), '') AS country,
      a.domain AS domain_a, b.domain AS domain_b, a.key IS NULL OR b.key IS NULL AS stale"""


@query(f"{_BENCH} {_ITEM} FROM work w LEFT JOIN book a ON a.key = w.key_a LEFT JOIN book b ON b.key = w.key_b", "v_discovered")
def q_candidate_items(spark, sf_dir):
    return workbench.candidate_items(_bench(spark, sf_dir), _book(spark, sf_dir))


@query(
    f"{_BENCH}, pg AS (SELECT * FROM work WHERE status = 'pending' ORDER BY name_score DESC, id LIMIT 50 OFFSET 10) {_ITEM} FROM pg w LEFT JOIN book a ON a.key = w.key_a LEFT JOIN book b ON b.key = w.key_b",
    "v_discovered",
)
def q_candidate_page(spark, sf_dir):
    return workbench.list_candidates(_bench(spark, sf_dir), _book(spark, sf_dir), offset=10)


@query(
    f"{_BENCH} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'merged') AS merged, count(*) FILTER (status = 'separated') AS separated, count(*) AS total FROM work",
    "v_discovered",
)
def q_candidate_summary(spark, sf_dir):
    return workbench.summary(_bench(spark, sf_dir))


@query(
    f"""{_BENCH} SELECT id, key_a, key_b, tier, name_score, status, CASE WHEN said THEN tier = 'domain' END AS llm_same, CASE WHEN said THEN name_score / 1000 END AS llm_confidence,
      CASE WHEN said THEN concat('seen ', left(id, 4)) END AS llm_reason, CASE WHEN said THEN 'm1' END AS llm_model FROM (SELECT *, status = 'pending' AND right(id, 1) < '8' AS said FROM work)""",
    "v_discovered",
)
def q_candidate_verdicts(spark, sf_dir):
    w = _bench(spark, sf_dir)
    said = w.where("right(id, 1) < '8'").select("id", (F.col("tier") == "domain").alias("same"), (F.col("name_score") / 1000).alias("confidence"), F.concat(F.lit("seen "), F.substring("id", 1, 4)).alias("reason"), F.lit("m1").alias("model"))
    return workbench.add_verdicts(w, said)


@query(
    f"""{_BENCH} SELECT id, key_a, key_b, tier, name_score, CASE WHEN status = 'pending' AND right(id, 1) < '4' THEN 'separated' ELSE status END AS status,
      CASE WHEN status = 'pending' AND right(id, 1) < '4' THEN concat('u', right(id, 1)) END AS decided_by FROM work""",
    "v_discovered",
)
def q_candidate_separate(spark, sf_dir):
    w = _bench(spark, sf_dir).withColumn("decided_by", F.lit(None).cast("string"))
    return workbench.decide_separate(w, w.where("right(id, 1) < '4'").select("id", F.concat(F.lit("u"), F.expr("right(id, 1)")).alias("decided_by")), F.lit(NOW).cast("timestamp"))


@query(
    """WITH d AS (SELECT company_id AS key, listed, concat('s', c_custkey, '.com') AS domain FROM v_company WHERE c_custkey % 6 <> 0),
    q AS (SELECT company_id, r.candidates, r.selected FROM (SELECT company_id, arg_min({'candidates': candidates, 'selected': selected}, o_orderkey) AS r FROM v_queue GROUP BY company_id)),
    c AS (SELECT company_id, vals, CASE WHEN coalesce(list_contains(vals, selected), false) THEN selected ELSE vals[1] END AS chosen FROM (SELECT *, CASE WHEN json_valid(candidates) THEN from_json(candidates, '["VARCHAR"]') ELSE [] END AS vals FROM q)),
    e AS (SELECT k.company_id, k.contact_id, k.value, row_number() OVER (PARTITION BY k.company_id ORDER BY coalesce(k.value = c.chosen, false) DESC,
        CASE WHEN coalesce(k.value = c.chosen, false) THEN '' ELSE CASE role WHEN 'ir' THEN 'a' WHEN 'general' THEN 'b' ELSE 'c' END END,
        CASE WHEN coalesce(k.value = c.chosen, false) OR role NOT IN ('ir', 'general') THEN 0 ELSE -tenths END, CASE WHEN coalesce(k.value = c.chosen, false) OR role NOT IN ('ir', 'general') THEN '' ELSE k.value END, k.contact_id) AS r
      FROM v_contact k LEFT JOIN c ON c.company_id = k.company_id WHERE k.type = 'email'),
    p AS (SELECT company_id, arg_min(value, contact_id) AS phone FROM v_contact WHERE type = 'phone' GROUP BY 1), f AS (SELECT company_id, arg_min(value, contact_id) AS form_url FROM v_contact WHERE type = 'form' GROUP BY 1)
    SELECT co.company_id, co.name, coalesce(d.listed, 'unknown') AS listed, d.domain, e.value AS email, p.phone, f.form_url, CASE WHEN e.value IS NOT NULL THEN coalesce(v.status, 'unknown') END AS status, v.mx, v.smtp
    FROM v_company co LEFT JOIN d ON d.key = co.company_id LEFT JOIN e ON e.company_id = co.company_id AND e.r = 1 LEFT JOIN p ON p.company_id = co.company_id LEFT JOIN f ON f.company_id = co.company_id
      LEFT JOIN v_validation v ON v.contact_id = e.contact_id""",
    "v_company", "v_queue", "v_contact", "v_validation",
)
def q_load_leads(spark, sf_dir):
    c = table(spark, sf_dir, "v_company").withColumn("key", F.col("company_id"))
    d = c.where("c_custkey % 6 <> 0").select("key", "listed", F.concat(F.lit("s"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain"))
    q = table(spark, sf_dir, "v_queue").groupBy("company_id").agg(F.min_by(F.struct("candidates", "selected"), "o_orderkey").alias("r")).select("company_id", "r.*")
    contacts = table(spark, sf_dir, "v_contact").withColumn("confidence", F.col("tenths"))
    found = leads.load_leads(c, d, contacts, q, table(spark, sf_dir, "v_validation"))
    return found.select("company_id", "name", "listed", "domain", "email", "phone", "form_url", "status", "mx", "smtp")


#: The segments that companies are in, and how their countries are known.
_SEGMENTS = "seg AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY country, industry, listed) - 1)::INT AS ord, country, industry, listed FROM (SELECT DISTINCT country, industry, listed FROM v_company))"


@query(f"WITH {_SEGMENTS} SELECT ord, concat(country, '/', industry, '/', listed) AS label FROM seg", "v_company")
def q_segments(spark, sf_dir):
    return registers.segments_of(table(spark, sf_dir, "v_company")).select("ord", "label")


@query(
    f"""WITH {_SEGMENTS}, s AS (SELECT ord, CASE country WHEN '대한민국' THEN 'kr' WHEN 'Japan' THEN 'jp' ELSE lower(country) END AS iso, country <> '' AS known, industry NOT IN ('전체', '기타') AS specific FROM seg),
    t AS (SELECT * FROM (VALUES """ + _values([(n, a, b or "", int(c)) for n, (a, b, c) in enumerate(registers.SOURCES)]) + """) AS t(priority, source, serves, broad_only))
    SELECT ord, source, priority FROM s JOIN t ON (serves = '*' OR (serves <> '' AND lower(serves) = iso) OR (serves = '' AND known)) AND NOT (broad_only = 1 AND specific)""",
    "v_company",
)
def q_source_matrix(spark, sf_dir):
    return registers.source_matrix(spark, registers.segments_of(table(spark, sf_dir, "v_company")))


_SEG = "(SELECT *, CASE WHEN trim(country) = '' THEN 'xx' ELSE lower(trim(country)) END AS cc FROM seg) s, (VALUES (0), (1)) n(i)"


@query(
    f"""WITH {_SEGMENTS} SELECT source, ord, name, domain, coalesce(registry, '') AS registry, listed, coalesce(market, '') AS market, CASE WHEN registry IS NULL THEN concat('dom:', regexp_extract(domain, '[^.]+[.][^.]+$')) ELSE concat('reg:', registry, ':', lower(registry_id)) END AS key FROM (
      SELECT 'edgar' AS source, ord, concat(industry, ' EDGAR Corp ', i) AS name, concat('us-edgar', i, '.com') AS domain, 'sec' AS registry, printf('CIK%07d', i) AS registry_id, listed, NULL AS market FROM {_SEG}
      UNION ALL SELECT 'dart', ord, concat(industry, ' 디에이알티 ', i), concat('kr-dart', i, '.co.kr'), 'dart', printf('KR%08d', i), listed, NULL FROM {_SEG}
      UNION ALL SELECT 'companies_house', ord, concat(industry, ' CH Ltd ', i), concat('gb-ch', i, '.co.uk'), 'companies_house', printf('GB%08d', i), listed, NULL FROM {_SEG}
      UNION ALL SELECT 'gleif', ord, concat(industry, ' GLEIF Co ', i), concat(cc, '-lei', i, '.com'), 'lei', concat('LEI-', cc, '-', i), listed, NULL FROM {_SEG}
      UNION ALL SELECT 'wikidata', ord, concat(industry, ' 위키데이터 ', i), concat(cc, '-wiki', i, '.com'), 'wikidata', concat('Q-', cc, '-', i), listed, NULL FROM {_SEG}
      UNION ALL SELECT 'opencorporates', ord, concat(industry, ' OpenCorp ', i), concat(cc, '-oc', i, '.com'), 'opencorporates', concat(cc, '/', printf('%06d', i)), listed, NULL FROM {_SEG}
      UNION ALL SELECT 'search', ord, concat(industry, ' 서치기업 ', i), concat(cc, '-search', i, '.com'), NULL, NULL, listed, NULL FROM {_SEG}
      UNION ALL SELECT 'sgx', ord, concat(industry, ' SGX 상장사 ', i), concat(cc, '-sgx', i, '.com'), 'sgx', printf('SGX%04d', i), 'listed', 'SGX' FROM {_SEG}
      UNION ALL SELECT 'dummy', ord, concat(industry, ' 더미기업 ', i), concat(cc, '-firm', i, '.com'), NULL, NULL, listed, NULL FROM {_SEG})""",
    "v_company",
)
def q_dry_rows(spark, sf_dir):
    segs = registers.segments_of(table(spark, sf_dir, "v_company"))
    out = None
    for source in ("edgar", "dart", "companies_house", "gleif", "wikidata", "opencorporates", "search", "sgx", "dummy"):
        some = registers.dry_rows(segs, source).select(F.lit(source).alias("source"), "ord", "name", "domain", F.coalesce("registry", F.lit("")).alias("registry"), "listed", F.coalesce("market", F.lit("")).alias("market"), "key")
        out = some if out is None else out.unionByName(some)
    return out


# ---------------------------------------------------------------- enrichment

_SLUG = "array_to_string(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN (" + _in(enrichment.NAME_STOPWORDS) + ")), '')"
_COMPANY = """SELECT p_partkey AS key, CASE p_partkey % 9 WHEN 4 THEN '주식회사 한글' WHEN 5 THEN 'A&B' ELSE concat(split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2), CASE p_partkey % 4 WHEN 0 THEN ' Group' WHEN 1 THEN ' Fund' ELSE ', Inc.' END) END AS name,
    CASE WHEN p_partkey % 7 = 0 THEN 'Some UCITS' WHEN p_partkey % 9 = 4 AND p_partkey % 2 = 0 THEN concat(split_part(p_name, ' ', 1), ' Global Ltd') END AS name_eng, CASE p_partkey % 5 WHEN 0 THEN '대한민국' WHEN 1 THEN 'kr' WHEN 2 THEN 'Germany' WHEN 3 THEN 'Nowhere' ELSE 'US' END AS country,
    CASE WHEN p_partkey % 6 = 0 THEN 'has.com' WHEN p_partkey % 6 = 1 THEN '' END AS domain, p_partkey * 7919 % 1000003 AS came FROM part"""
_HITS = """SELECT p_partkey AS key, 'default' AS provider, 0 AS rank, 'https://www.facebook.com/x' AS link, '' AS display_link FROM part
    UNION ALL SELECT p_partkey, 'default', 1, concat('https://www.', replace(lower(p_name), ' ', ''), '.com/a'), '' FROM part UNION ALL SELECT p_partkey, 'default', 2, '', concat(lower(split_part(p_name, ' ', 1)), 'x.de') FROM part WHERE p_partkey % 4 <> 2
    UNION ALL SELECT p_partkey, 'naver', 1, concat('https://', lower(split_part(p_name, ' ', 1)), '.com'), '' FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'naver', 2, concat('https://www.', lower(split_part(p_name, ' ', 1)), 'y.co.kr/'), '' FROM part
    UNION ALL SELECT p_partkey, 'naver', 3, 'https://news.example.org', NULL FROM part"""
_FUND = "regexp_matches(coalesce({x}, ''), '(?i)\\bFUNDS?\\b|\\bUCITS\\b')"


@query(
    f"""WITH comp AS ({_COMPANY}), hit AS ({_HITS}),
    s AS (SELECT key, came, CASE WHEN length({_SLUG.replace('{x}', 'name')}) >= 3 OR coalesce(name_eng, '') = '' THEN {_SLUG.replace('{x}', 'name')} ELSE {_SLUG.replace('{x}', 'name_eng')} END AS slug,
      CASE country WHEN '대한민국' THEN '.kr' WHEN 'kr' THEN '.kr' WHEN 'Germany' THEN '.de' WHEN 'US' THEN '.us' ELSE '' END AS tld FROM comp WHERE coalesce(domain, '') = '' AND NOT {_FUND.replace('{x}', 'name')} AND NOT {_FUND.replace('{x}', 'name_eng')}),
    w AS (SELECT *, CASE tld WHEN '.kr' THEN 'naver' ELSE 'default' END AS provider FROM s WHERE length(slug) >= 3 ORDER BY came LIMIT 300),
    d AS (SELECT w.*, h.rank, {_domain("CASE WHEN link <> '' THEN link ELSE display_link END")} AS dom FROM hit h JOIN w ON w.key = h.key AND w.provider = h.provider),
    b AS (SELECT *, regexp_replace(split_part(dom, '.', 1), '[^a-z0-9]', '', 'g') AS brand FROM d WHERE dom NOT IN ({_in(scans.BLOCKED)})),
    f AS (SELECT key, first(dom ORDER BY (tld = '' OR NOT ends_with(dom, tld))::INT, rank) AS domain FROM b
      WHERE length(brand) >= 3 AND (brand = slug OR (length(slug) >= 4 AND starts_with(brand, slug)) OR (length(brand) >= 4 AND starts_with(slug, brand))) GROUP BY key)
    SELECT w.key, w.provider, f.domain FROM w JOIN f ON f.key = w.key"""
)
def q_resolve_domain(spark, sf_dir):
    """Companies in the order in which they came, of which the quota lets 300 be searched for."""
    part = table(spark, sf_dir, "part")
    companies, hits = (spark.sql(q.replace("FROM part", "FROM {part}"), part=part) for q in (_COMPANY, _HITS))
    return enrichment.resolve_domains(companies, hits, "came", 300, ("default", "naver"))


@query("SELECT key, unnest(['email', 'phone', 'form']) AS type, unnest([concat('ir@', d), '+82-2-0000-0000', concat('https://', d, '/contact')]) AS value, unnest([9, 6, 8]) AS tenths FROM (SELECT page_id AS key, coalesce(domain, 'example.com') AS d FROM v_probe)", "v_probe")
def q_dry_contacts(spark, sf_dir):
    return enrichment.dry_contacts(table(spark, sf_dir, "v_probe").withColumnRenamed("page_id", "key"))


@query(
    f"""WITH {_pages_sql('html')}, {_FORMS}, mails AS ({_MAILS}), calls AS ({_CALLS}), of AS (SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS company FROM v_html),
    em2 AS (SELECT company, string_agg(value, ',' ORDER BY -c, value) AS emails FROM (SELECT company, value, max(confidence) AS c FROM mails JOIN of USING (page_id) GROUP BY ALL) GROUP BY company),
    ph AS (SELECT company, string_agg(DISTINCT value, ',' ORDER BY value) AS phones FROM (SELECT company, digits, arg_min(value, page_id) AS value FROM calls JOIN of USING (page_id) GROUP BY ALL) GROUP BY company),
    fm AS (SELECT company, arg_min(form_url, page_id) AS form FROM formed JOIN of USING (page_id) GROUP BY company),
    heads AS (SELECT *, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path, lower(concat_ws(' ', regexp_extract(html, '(?is)<title>(.*?)</title>', 1), array_to_string(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ' '))) AS t FROM of),
    cp AS (SELECT company, arg_min(url, page_id) AS contact_page FROM heads WHERE list_has_any(string_split_regex(path, '[/_.\\-]+'), ['contact', 'contactus', 'inquiry', 'enquiry']) OR contains(path, '문의') OR {_hints('t', pages.CONTACT_TITLES)} GROUP BY company)
    SELECT company, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, CASE WHEN emails IS NULL AND form IS NULL THEN contact_page ELSE form END AS form, contact_page, emails IS NULL AND form IS NULL AND contact_page IS NOT NULL AS fallback
    FROM (SELECT DISTINCT company FROM of) LEFT JOIN em2 USING (company) LEFT JOIN ph USING (company) LEFT JOIN fm USING (company) LEFT JOIN cp USING (company)""",
    "v_html",
)
def q_company_contacts(spark, sf_dir):
    captured = table(spark, sf_dir, "v_html").withColumn("company", F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    found = enrichment.escalate(enrichment.company_contacts(captured))
    return found.withColumns({"emails": F.array_join("emails", ","), "phones": F.array_join("phones", ",")})
