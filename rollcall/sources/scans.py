"""Scans that stop early and go on in the next run, over captured responses.

The registers' readers stop after so many rows, accepted companies or pages, and a cursor tells the next run where to
begin. Here a scan is a table: cursors say where each key's window begins, running counts within the window say
where it ends, and the result is the rows taken and the cursors of the next run. A window is bounded by its
limit, so counting within one key is too; keys are worked on side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import identity
from rollcall.sources.registers import company_name

# Entries of a list that one scan looks at when it has an industry to find, over its cap and at most.
WIDER, MOST_SCANNED = 10, 2000


def scan_limit(cap: int, prefixes: Column) -> Column:
    """Entries to look at: the cap, or more where only some of the entries count."""
    return F.when(prefixes.isNull(), cap).otherwise(min(cap * WIDER, MOST_SCANNED))


def scan_list(
    universe: DataFrame, segments: DataFrame, cursors: DataFrame, cap: int, accept: Callable[[DataFrame], DataFrame], key: str = "segment"
) -> tuple[DataFrame, DataFrame]:
    """One run over an ordered list for each segment: (rows taken, cursors of the next run).

    universe: pos (0, 1, ... without gaps) and its columns. segments: the key, `limit` (entries to look at) and more.
    cursors: the key and `position`; a segment without one, or with one outside the list, begins at 0. accept
    takes the windows' rows and gives those that count, with their key and pos. A segment's run ends at its cap-th
    accepted row or at the end of its window; the next one begins after that, or at 0 where the list ends.
    """
    total = universe.agg(F.count("*").alias("total"))  # one row
    bounds = segments.join(cursors.select(key, "position"), key, "left").crossJoin(total)
    inside = (F.col("position") >= 0) & (F.col("position") < F.col("total"))
    bounds = bounds.withColumn("offset", F.when(inside, F.col("position")).otherwise(0)).drop("position")
    bounds = bounds.withColumn("end", F.least(F.col("offset") + F.col("limit"), F.col("total")))
    asked = bounds.where("end > offset").withColumn("pos", F.explode(F.sequence("offset", F.col("end") - 1)))
    found = accept(asked.drop("total", "offset", "end", "limit").join(universe, "pos"))
    ranked = found.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_rank") <= cap)
    last = ranked.where(F.col("_rank") == cap).select(key, (F.col("pos") + 1).alias("_stop"))
    after = bounds.where("total > 0").join(last, key, "left").withColumn("_stop", F.coalesce("_stop", "end"))
    after = after.select(key, F.when(F.col("_stop") >= F.col("total"), 0).otherwise(F.col("_stop")).cast("long").alias("position"))
    return ranked.drop("_rank"), _merged(cursors, after, key)


def scan_pages(
    pages: DataFrame, items: DataFrame, cursors: DataFrame, cap: int, max_pages: int, by_items: bool, key: str = "segment"
) -> tuple[DataFrame, DataFrame]:
    """One run over a register's pages for each key of `pages`: (items taken, cursors of the next run).

    pages: the key, `start` and n, the page's entries: 0 for a page beyond the end, null for a failed request. A page
    that isn't there at all is a failed request too. items: the accepted entries, with key, start and at. Pages follow one another
    by the number of their entries (by_items, from 0) or one by one (from 1). A run ends with the page that reaches
    the cap, after max_pages, at a failure (the next run tries it again) or at the end, which sets the cursor to 0.
    """
    first = 0 if by_items else 1
    keys = pages.select(key).distinct().join(cursors.select(key, "position"), key, "left")
    begin = keys.select(key, F.greatest(F.coalesce("position", F.lit(first)), F.lit(first)).cast("long").alias("_begin"))
    counted = items.groupBy(key, "start").agg(F.count("*").alias("_found"))
    reach = pages.groupBy(key).agg(F.max(F.coalesce("n", F.lit(0))).alias("_most"))
    near = pages.join(begin, key).join(reach, key)
    step = F.col("_most") if by_items else F.lit(1)
    near = near.where((F.col("start") >= F.col("_begin")) & (F.col("start") <= F.col("_begin") + step * max_pages))
    near = near.join(counted, [key, "start"], "left")
    entry = F.struct(F.col("start").cast("long").alias("s"), F.struct(F.col("n").cast("long").alias("n"), F.coalesce("_found", F.lit(0)).cast("long").alias("f")).alias("v"))
    maps = near.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # at most the window's pages
    state = begin.join(maps, key, "left").selectExpr(
        key, "_begin",
        f"""aggregate(sequence(1, {max_pages}),
              struct(_begin AS at, 0L AS got, cast(array() AS array<bigint>) AS taken, false AS done, false AS ended),
              (z, i) -> CASE WHEN z.done THEN z
                WHEN try_element_at(m, z.at).n IS NULL THEN struct(z.at AS at, z.got AS got, z.taken AS taken, true AS done, false AS ended)
                WHEN try_element_at(m, z.at).n = 0 THEN struct(z.at AS at, z.got AS got, z.taken AS taken, true AS done, true AS ended)
                ELSE struct(z.at + {'try_element_at(m, z.at).n' if by_items else '1'} AS at, z.got + try_element_at(m, z.at).f AS got, array_append(z.taken, z.at) AS taken,
                            z.got + try_element_at(m, z.at).f >= {cap} AS done, false AS ended) END) AS z""",
    )
    after = state.select(key, F.when(F.col("z.ended"), 0).otherwise(F.col("z.at")).cast("long").alias("position"))
    taken = items.join(state.select(key, F.explode("z.taken").alias("start")), [key, "start"])
    ranked = taken.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("start", "at"))).where(F.col("_rank") <= cap).drop("_rank")
    return ranked, _merged(cursors, after, key)


def _merged(cursors: DataFrame, after: DataFrame, key: str) -> DataFrame:
    kept = cursors.select(key, "position").join(after.select(key), key, "left_anti")
    return kept.select(key, F.col("position").cast("long").alias("position")).unionByName(after)


# Labels that no company's domain has, and domains of portals, directories, news and networks.
NO_COMPANY = ("gov", "edu", "ac", "mil", "go", "or", "ne", "gob")
BLOCKED = (
    "naver.com", "daum.net", "nate.com", "google.com", "youtube.com", "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com",
    "tistory.com", "blogspot.com", "wordpress.com", "wikipedia.org", "hankyung.com", "mk.co.kr", "chosun.com", "donga.com", "joins.com",
    "korcham.net", "kita.net", "saramin.co.kr", "jobkorea.co.kr",
    "crunchbase.com", "f6s.com", "lusha.com", "zoominfo.com", "dnb.com", "pitchbook.com", "opencorporates.com", "glassdoor.com", "indeed.com",
    "jobstreet.com", "listedcompany.com", "tradingview.com", "marketscreener.com", "bloomberg.com", "reuters.com", "yahoo.com", "yelp.com", "trustpilot.com",
    "biopharmguy.com", "bionity.com", "medium.com", "github.com", "apollo.io", "threads.net", "tiktok.com", "pinterest.com", "amazon.com",
)
#: Companies that one segment's search may give at most.
MOST_OF_A_SEARCH = 100


def hit_domain(hits: DataFrame) -> Column:
    """The registered domain of a hit's link, or of the link that was displayed, unless it is a portal's."""
    link = F.nullif(F.col("link"), F.lit(""))
    domain = identity.registered_domain(F.coalesce(link, F.col("display_link")) if "display_link" in hits.columns else link)
    return F.when(~domain.isin(*BLOCKED), domain)


def crawl_search(hits: DataFrame, seen: DataFrame, cap: int = MOST_OF_A_SEARCH, least_new: float = 0.2, pages: int = 10, segment: str = "segment") -> DataFrame:
    """segment, domain, name, query, position of the companies that a search of each segment gives.

    hits: segment, query (its place among the segment's queries), page (from 1), rank, title, link, and display_link if there is
    one. seen: domain, known before. A query reads its pages in order, up to the first that is missing. A page's candidates are
    the company domains that the query had on no earlier page; those not in `seen` are new. It stops after the page that
    reaches the cap, and after a page with candidates of which less than least_new are new. The queries' companies
    are united in their order, each domain once, up to the cap. What is counted here is one query's pages and one
    segment's queries, both bounded by the pages and the cap.
    """
    cap = min(cap, MOST_OF_A_SEARCH)
    one = [segment, "query"]
    rows = hits.where(F.col("page").between(1, pages)).withColumn("domain", hit_domain(hits))
    there = rows.select(*one, "page").distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*one).orderBy("page"))).where("_n = page").drop("_n")
    company = F.col("domain").isNotNull() & ~F.arrays_overlap(F.split("domain", r"\."), F.array(*map(F.lit, NO_COMPANY)))
    first = rows.where(company).groupBy(*one, "domain").agg(F.min_by(F.struct("page", "rank", "title"), F.struct("page", "rank")).alias("h")).select(*one, "domain", "h.*")
    known = seen.select("domain").distinct().withColumn("_seen", F.lit(True))
    first = first.join(there, [*one, "page"]).join(known, "domain", "left").withColumn("_new", F.col("_seen").isNull())
    sizes = first.groupBy(*one, "page").agg(F.count("*").alias("_all"), F.count_if("_new").alias("_fresh"))
    sizes = there.join(sizes, [*one, "page"], "left").na.fill(0, ["_all", "_fresh"])
    before = Window.partitionBy(*one).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    poor = ((F.col("_all") > 0) & (F.col("_fresh") < least_new * F.col("_all"))).cast("int")
    stopped = (F.coalesce(F.max(poor).over(before), F.lit(0)) > 0) | (F.coalesce(F.sum("_fresh").over(before), F.lit(0)) >= cap)
    read = sizes.withColumn("_stopped", stopped).where("not _stopped").select(*one, "page")
    new = first.where("_new").join(read, [*one, "page"])
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*one).orderBy("page", "rank"))).where(F.col("_n") <= cap)
    place = F.struct("query", "page", "rank")
    united = new.groupBy(segment, "domain").agg(F.min_by(F.struct("query", "page", "rank", "title"), place).alias("h"))
    united = united.withColumn("position", F.row_number().over(Window.partitionBy(segment).orderBy("h.query", "h.page", "h.rank"))).where(F.col("position") <= cap)
    title = F.trim(F.coalesce("h.title", F.lit("")))
    name = F.when(title != "", company_name(title, F.col("domain"))).otherwise(F.col("domain"))
    return united.select(segment, "domain", name.alias("name"), "h.query", "position")
