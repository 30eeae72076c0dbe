"""Registers as tables: what a captured response holds, and the deterministic rows of a dry run.

Nothing here opens a connection. A reader takes a frame of captured payloads (segment columns and a
JSON or HTML text) and gives discovered companies.
"""

from __future__ import annotations

import html as html_entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import identity, industry
from rollcall.functions.dimensions import COUNTRIES, UK_SIC

# Sources in the order of trust, and the countries they serve (none: any).
SOURCES = (
    ("edgar", "US", False), ("dart", "KR", False), ("companies_house", "GB", False), ("pse", "PH", True), ("set", "TH", True),
    ("sgx", "SG", True), ("idx", "ID", True), ("bursa", "MY", True), ("hose", "VN", True), ("hnx", "VN", True),
    ("gleif", None, True), ("wikidata", None, True), ("opencorporates", None, False), ("search", "*", False),
)
# The rows of a dry run. Name, domain, registry and its id; {i} counts from 0, {cc} is the country as it is
# given, in lower case.
DRY_ROWS = {
    "edgar": ("{industry} EDGAR Corp {i}", "us-edgar{i}.com", "sec", "CIK{i:7}"),
    "dart": ("{industry} 디에이알티 {i}", "kr-dart{i}.co.kr", "dart", "KR{i:8}"),
    "companies_house": ("{industry} CH Ltd {i}", "gb-ch{i}.co.uk", "companies_house", "GB{i:8}"),
    "gleif": ("{industry} GLEIF Co {i}", "{cc}-lei{i}.com", "lei", "LEI-{cc}-{i}"),
    "wikidata": ("{industry} 위키데이터 {i}", "{cc}-wiki{i}.com", "wikidata", "Q-{cc}-{i}"),
    "opencorporates": ("{industry} OpenCorp {i}", "{cc}-oc{i}.com", "opencorporates", "{cc}/{i:6}"),
    "search": ("{industry} 서치기업 {i}", "{cc}-search{i}.com", None, None),
    "dummy": ("{industry} 더미기업 {i}", "{cc}-firm{i}.com", None, None),
}
EXCHANGES = ("pse", "set", "sgx", "idx", "bursa", "hose", "hnx")
DRY_ROWS |= {x: ("{industry} " + x.upper() + " 상장사 {i}", "{cc}-" + x + "{i}.com", x, x.upper() + "{i:4}") for x in EXCHANGES}


def segments(spark: SparkSession, countries: list[str], industries: list[str], listed: list[str]) -> DataFrame:
    """ord, country, industry, listed, label: every combination, in order. The lists are the caller's."""
    rows = [(c, i, x) for c in countries for i in industries for x in listed]
    return spark.createDataFrame([(n, *r, "/".join(r)) for n, r in enumerate(rows)], "ord int, country string, industry string, listed string, label string")


def segments_of(companies: DataFrame) -> DataFrame:
    """ord, country, industry, listed, label: the segments that companies are in, in the order of their fields. One row for each
    segment is numbered in one task."""
    found = companies.select("country", "industry", "listed").distinct()
    numbered = found.withColumn("ord", F.row_number().over(Window.orderBy("country", "industry", "listed")) - 1)
    return numbered.select("ord", "country", "industry", "listed", F.concat_ws("/", "country", "industry", "listed").alias("label"))


def source_matrix(spark: SparkSession, segs: DataFrame) -> DataFrame:
    """ord, source, priority: the sources that apply to each segment; exchanges and aggregators not to a specific industry."""
    table = spark.createDataFrame([(n, *s) for n, s in enumerate(SOURCES)], "priority int, source string, serves string, broad_only boolean")
    known = F.lower("country").isin([a for _, _, aliases in COUNTRIES for a in aliases])
    iso = F.upper(identity.normal_country(F.col("country")))
    serves = F.coalesce(F.when(F.col("serves") == "*", True).otherwise(F.col("serves") == iso), known)
    return segs.join(F.broadcast(table), serves & ~(F.col("broad_only") & industry.is_specific(F.col("industry")))).select("ord", "source", "priority")


def _filled(shape: str | None, **values: Column) -> Column:
    """A shape with its fields filled in; {i:7} is i with leading zeros, seven digits at least."""
    if shape is None:
        return F.lit(None).cast("string")
    out = []
    for plain, field, width in re.findall(r"([^{}]+)|\{(\w+)(?::(\d+))?\}", shape):
        value = values[field].cast("string") if field else F.lit(plain)
        out.append(F.when(F.length(value) < int(width), F.lpad(value, int(width), "0")).otherwise(value) if width else value)
    return F.concat(*out)


def dry_rows(segs: DataFrame, source: str, n: int = 2) -> DataFrame:
    """n deterministic companies for each segment, as a dry run of the source gives: ord, name, country, listed, registry,
    registry_id, domain, market, key. An exchange's companies are listed, and their market is the exchange."""
    rows = segs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    cc = F.lower(F.trim(F.coalesce(F.nullif("country", F.lit("")), F.lit("xx"))))
    exchange = source in EXCHANGES
    name, domain, registry, number = DRY_ROWS[source]
    fill = lambda shape: _filled(shape, industry=F.col("industry"), i=F.col("i"), cc=cc)
    made = rows.select(
        "ord", fill(name).alias("name"), "country", (F.lit("listed") if exchange else F.col("listed")).alias("listed"), F.lit(registry).cast("string").alias("registry"),
        fill(number).alias("registry_id"), fill(domain).alias("domain"), F.lit(source.upper() if exchange else None).cast("string").alias("market"),
    )
    return made.withColumn("key", identity.canonical_key(*(F.col(c) for c in ("registry", "registry_id", "domain", "name", "country"))))


def first_text(row: Column, *fields: str) -> Column:
    """The first of the fields of a JSON text that isn't empty, trimmed; empty where there is none."""
    return F.trim(F.coalesce(*(F.nullif(F.get_json_object(row, f"$.{f}"), F.lit("")) for f in fields), F.lit("")))


def _filled_in(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""


def _text(c: str | Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html_entities.unescape, na_action="ignore")


def in_place(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with `pos`, their place (from 0) in the order of a page and of their place in it: order is (page, at).

    A page's rows are numbered by themselves; only the pages' sizes, one row for each, are summed up in one task.
    """
    page, at = order
    own = rows.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy(at)) - 1)
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(F.col(page).alias("_page")).agg(F.count("*").alias("_size")).select("_page", before.alias("_before"))
    joined = own.join(sizes, F.col(page) == F.col("_page"))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_n")).cast("long").alias("pos"))


def _pages(captured: DataFrame, payload: str) -> DataFrame:
    """Captured responses with a page number: 0 where there is none."""
    return captured if "page" in captured.columns else captured.withColumn("page", F.lit(0))


def edgar_tickers(captured: DataFrame, payload: str = "payload") -> DataFrame:
    """page, at, cik, name, exchange (lower case) of the columnar universe list, one response or several by `page`.

    Columns are found by their names in lower case. A row stays if its CIK is a whole number and its exchange is
    one of those known or is not in the row at all (then ''); without a cik column there are no rows. A null
    in a row reads as the text None, as the register's own rows do.
    """
    shape = "fields array<string>, data array<array<string>>"
    parsed = _pages(captured, payload).select("page", F.from_json(payload, shape).alias("j"))
    place = lambda n: F.array_position(F.transform("j.fields", F.lower), n).cast("int") - 1
    rows = parsed.select("page", *(place(n).alias(f"_{n}") for n in ("cik", "name", "exchange")), F.posexplode("j.data").alias("at", "row"))
    here = lambda n: (F.col(f"_{n}") >= 0) & (F.col(f"_{n}") < F.size("row"))
    said = lambda n: F.when(here(n), F.coalesce(F.get("row", F.greatest(F.col(f"_{n}"), F.lit(0))), F.lit("None"))).otherwise("")
    rows = rows.where(F.coalesce(here("cik"), F.lit(False)))
    rows = rows.select("page", "at", F.trim(said("cik")).try_cast("long").alias("cik"), said("name").alias("name"), F.lower(said("exchange")).alias("exchange"))
    return rows.where(F.col("cik").isNotNull() & F.col("exchange").isin("", "nasdaq", "nyse", "cboe", "otc"))


def edgar_companies(universe: DataFrame, submissions: DataFrame, prefixes: tuple[str, ...] | Column | None = None, payload: str = "payload") -> DataFrame:
    """The universe (cik, name, exchange, and what else it holds) joined with the companies' captured submissions (cik, payload).

    Adds registry_id, domain, listed (null where no exchange is named), market, address, region (the state), phone, ir_url,
    ticker, sic. Companies without a submission, or whose SIC code has none of the prefixes, are left out. Of several
    submissions of one CIK that of the least text counts.
    """
    street = "struct<street1: string, street2: string, city: string, stateOrCountry: string, zipCode: string>"
    shape = f"name string, sic string, website string, investorWebsite string, phone string, tickers array<string>, addresses struct<business: {street}>"
    said = submissions.groupBy("cik").agg(F.min(payload).alias("_said")).select("cik", F.from_json("_said", shape).alias("s")).where("s is not null")
    rows = universe.join(said, "cik").where(industry.matches_prefix(F.col("s.sic"), prefixes))
    exchange = F.lower(F.coalesce("exchange", F.lit("")))
    business = [F.col(f"s.addresses.business.{f}") for f in ("street1", "street2", "city", "stateOrCountry", "zipCode")]
    return rows.select(
        *(c for c in universe.columns if c not in ("name", "exchange")), F.col("cik").cast("string").alias("registry_id"), F.coalesce(F.nullif("s.name", F.lit("")), "name").alias("name"),
        identity.registered_domain(F.coalesce(F.nullif("s.investorWebsite", F.lit("")), "s.website")).alias("domain"),
        F.when(exchange == "otc", "unlisted").when(exchange != "", "listed").alias("listed"), F.nullif(F.upper(exchange), F.lit("")).alias("market"),
        identity.join_address(*business).alias("address"), _text("s.addresses.business.stateOrCountry").alias("region"),
        _text("s.phone").alias("phone"), _text("s.investorWebsite").alias("ir_url"), _text(F.get("s.tickers", 0)).alias("ticker"), F.col("s.sic").alias("sic"),
    )


def dart_universe(captured: DataFrame, payload: str = "payload") -> DataFrame:
    """page, at (place in the list), corp_code, corp_name of the companies of a code list (XML) that have a stock code."""
    shape = "list array<struct<corp_code: string, corp_name: string, stock_code: string>>"
    rows = _pages(captured, payload).select("page", F.posexplode(F.from_xml(payload, shape)["list"]).alias("at", "c")).select(
        "page", "at", F.trim("c.corp_code").alias("corp_code"), F.coalesce(F.trim("c.corp_name"), F.lit("")).alias("corp_name"), F.trim("c.stock_code").alias("stock")
    )
    return rows.where(_filled_in("stock") & _filled_in("corp_code")).drop("stock")


# The register's classes of companies, whether they are listed, and on which board.
DART_LISTED = {"Y": "listed", "K": "listed", "N": "listed", "E": "unlisted"}
DART_MARKET = {"Y": "KOSPI", "K": "KOSDAQ", "N": "KONEX"}


def dart_companies(universe: DataFrame, details: DataFrame, prefixes: tuple[str, ...] | Column | None = None, payload: str = "payload") -> DataFrame:
    """The universe (corp_code, corp_name, and what else it holds) joined with the companies' captured details (corp_code,
    payload): those whose status is 000 and whose KSIC code has one of the prefixes. Of several details the least text counts."""
    names = "status corp_name hm_url induty_code adres bizr_no stock_code phn_no ir_url corp_name_eng corp_cls".split()
    said = details.groupBy("corp_code").agg(F.min(payload).alias("_said")).select("corp_code", F.from_json("_said", ", ".join(f"{n} string" for n in names)).alias("d"))
    rows = universe.join(said, "corp_code").where((F.col("d.status") == "000") & industry.matches_prefix(F.col("d.induty_code"), prefixes))
    look = lambda t: F.try_element_at(F.create_map(*(F.lit(x) for kv in t.items() for x in kv)), F.coalesce("d.corp_cls", F.lit("")))
    return rows.select(
        *(c for c in universe.columns if c not in ("corp_code", "corp_name")), F.col("corp_code").alias("registry_id"), F.coalesce(F.nullif("d.corp_name", F.lit("")), "corp_name").alias("name"),
        identity.registered_domain(F.col("d.hm_url")).alias("domain"), F.coalesce(look(DART_LISTED), F.lit("unknown")).alias("listed"), look(DART_MARKET).alias("market"),
        _text("d.adres").alias("address"), _text("d.bizr_no").alias("reg_no"), _text("d.stock_code").alias("ticker"), _text("d.phn_no").alias("phone"), _text("d.ir_url").alias("ir_url"),
        _text("d.corp_name_eng").alias("name_eng"), F.col("d.induty_code").alias("ksic"),
    )


def _items(captured: DataFrame, payload: str, shape: str, path: tuple[str, ...], outer: bool = False) -> DataFrame:
    """The captured columns but the payload, at (place in the page), and the fields of each entry of a list in the response."""
    parsed = F.from_json(payload, shape)
    for p in path:
        parsed = parsed[p]
    kept = [c for c in captured.columns if c != payload]
    return captured.select(*kept, F.posexplode(parsed).alias("at", "_c")).where("_c is not null").select(*kept, "at", "_c.*")


def page_sizes(captured: DataFrame, path: str, payload: str = "payload") -> DataFrame:
    """The captured columns but the payload, and n: entries of the list at the JSON path; 0 where the response has no such
    list, null where it can't be read at all (a failed request)."""
    kept = [c for c in captured.columns if c != payload]
    whole = F.get_json_object(payload, "$")
    listed = F.coalesce(F.json_array_length(F.get_json_object(payload, path)), F.lit(0))
    return captured.select(*kept, F.when(whole.isNotNull(), listed).cast("long").alias("n"))


def companies_house_items(captured: DataFrame, prefixes: tuple[str, ...] | Column | None = None, payload: str = "payload") -> DataFrame:
    """Active companies with a number and a name whose SIC codes match: the captured columns, at, registry_id, name, address,
    region (the locality), reg_no (the number, by which other registers name the company too), label (of the first
    unambiguous code)."""
    street = "struct<address_line_1: string, address_line_2: string, locality: string, postal_code: string>"
    shape = f"items array<struct<company_number: string, company_name: string, company_status: string, sic_codes: array<string>, registered_office_address: {street}>>"
    rows = _items(captured, payload, shape, ("items",))
    rows = rows.where((F.lower(F.trim("company_status")) == "active") & _filled_in("company_number") & _filled_in("company_name"))
    if prefixes is not None:
        matches = F.exists(F.coalesce("sic_codes", F.array().cast("array<string>")), lambda c: industry.matches_prefix(c, prefixes))
        rows = rows.where(matches | prefixes.isNull() if isinstance(prefixes, Column) else matches)
    codes = rows.select("sic_codes").distinct().select("sic_codes", F.posexplode("sic_codes").alias("n", "code")).where("code is not null")
    known = industry.label_from_code(codes.select("code").distinct().withColumn("_id", F.col("code")), UK_SIC, "_id").where("label is not null")
    first = codes.join(known, F.col("code") == F.col("_id")).groupBy(F.col("sic_codes").alias("_codes")).agg(F.min_by("label", "n").alias("label"))
    address = identity.join_address(*(F.col(f"registered_office_address.{f}") for f in ("address_line_1", "address_line_2", "locality", "postal_code")))
    kept = [c for c in captured.columns if c != payload]
    return rows.join(first, F.col("sic_codes") == F.col("_codes"), "left").select(
        *kept, "at", F.col("company_number").alias("registry_id"), F.col("company_name").alias("name"), address.alias("address"),
        _text("registered_office_address.locality").alias("region"), F.col("company_number").alias("reg_no"), "label",
    )


def gleif_records(captured: DataFrame, payload: str = "payload") -> DataFrame:
    """ACTIVE entities with a name and an id: the captured columns, at, registry_id, name, country (of the legal address),
    address, region (the city), reg_no (the number in the local register)."""
    place = "struct<addressLines: array<string>, city: string, postalCode: string, country: string>"
    entity = f"struct<legalName: struct<name: string>, status: string, legalAddress: {place}, registeredAs: string>"
    shape = f"data array<struct<id: string, attributes: struct<lei: string, entity: {entity}>>>"
    rows = _items(captured, payload, shape, ("data",))
    lei = F.coalesce(F.nullif("id", F.lit("")), "attributes.lei")
    e = lambda f: F.col(f"attributes.entity.{f}")
    rows = rows.where((F.upper(e("status")) == "ACTIVE") & _filled_in(e("legalName.name")) & _filled_in(lei))
    lines = F.concat_ws(", ", F.filter(F.transform(F.coalesce(e("legalAddress.addressLines"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    kept = [c for c in captured.columns if c not in (payload, "country")]
    return rows.select(
        *kept, "at", lei.alias("registry_id"), e("legalName.name").alias("name"), e("legalAddress.country").alias("country"),
        identity.join_address(lines, e("legalAddress.city"), e("legalAddress.postalCode")).alias("address"), _text(e("legalAddress.city")).alias("region"), _text(e("registeredAs")).alias("reg_no"),
    )


def wikidata_bindings(captured: DataFrame, payload: str = "payload", cap: int | None = None) -> DataFrame:
    """registry_id, name, domain, headquarters: of each item the first row with a resolved label, in the order of the response
    (and of `page`, if there are several); an unresolved headquarters is null. With a cap, the first so many items."""
    cell = "struct<value: string>"
    shape = f"results struct<bindings: array<struct<item: {cell}, itemLabel: {cell}, website: {cell}, hqLabel: {cell}>>>"
    rows = _items(_pages(captured, payload), payload, shape, ("results", "bindings"))
    rows = rows.select("page", "at", F.substring_index("item.value", "/", -1).alias("registry_id"), F.col("itemLabel.value").alias("name"), F.col("website.value").alias("site"), F.col("hqLabel.value").alias("hq"))
    rows = rows.where(_filled_in("registry_id") & _filled_in("name") & (F.col("name") != F.col("registry_id")))
    first = rows.groupBy("registry_id").agg(F.min_by(F.struct("name", "site", "hq", "page", "at"), F.struct("page", "at")).alias("r"))
    if cap is not None:
        first = first.orderBy("r.page", "r.at").limit(cap)
    hq = F.nullif("r.hq", F.lit(""))
    return first.select("registry_id", "r.name", identity.registered_domain(F.nullif("r.site", F.lit(""))).alias("domain"), F.when(~hq.rlike("^Q[0-9]+$"), hq).alias("headquarters"))


def opencorporates_companies(captured: DataFrame, payload: str = "payload") -> DataFrame:
    """Companies with a number, a jurisdiction and a name that aren't marked inactive (what isn't said counts as active): the
    captured columns, at, registry_id, name, address, region (the locality), reg_no (the number)."""
    company = "struct<name: string, company_number: string, jurisdiction_code: string, inactive: boolean, registered_address_in_full: string, registered_address: struct<locality: string>>"
    rows = _items(captured, payload, f"results struct<companies: array<struct<company: {company}>>>", ("results", "companies"))
    kept = [c for c in captured.columns if c != payload]
    rows = rows.select(*kept, "at", "company.*").where(~F.coalesce("inactive", F.lit(False)))
    rows = rows.where(_filled_in("company_number") & _filled_in("jurisdiction_code") & _filled_in("name"))
    return rows.select(
        *kept, "at", F.concat_ws("/", "jurisdiction_code", "company_number").alias("registry_id"), "name",
        _text("registered_address_in_full").alias("address"), _text("registered_address.locality").alias("region"), F.col("company_number").alias("reg_no"),
    )


def _first_symbols(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """symbol, name: of rows (page, at, symbol, name) with both, the first of each symbol; with a cap, the first so many symbols."""
    first = rows.where(_filled_in("symbol") & _filled_in("name")).groupBy("symbol").agg(F.min_by(F.struct("name", "page", "at"), F.struct("page", "at")).alias("r"))
    first = first if cap is None else first.orderBy("r.page", "r.at").limit(cap)
    return first.select("symbol", "r.name")


def listing_rows(captured: DataFrame, pattern: str, html: str = "html", symbol: int = 1, name: int = 2, cap: int | None = None) -> DataFrame:
    """symbol, name of an exchange's listing pages (html, and page if there are several): the first row of each symbol that has a
    name. Two groups of the pattern are the two; character references are resolved."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(symbol)).alias("symbol"), F.regexp_extract_all(html, F.lit(pattern), F.lit(name)).alias("name"))
    rows = _pages(captured, html).select("page", F.posexplode(pairs).alias("at", "p"))
    # a reference is resolved after the text is trimmed
    return _first_symbols(rows.select("page", "at", *(_unescaped(F.trim(f"p.{c}")).alias(c) for c in ("symbol", "name"))), cap)


def sgx_rows(captured: DataFrame, payload: str = "payload", cap: int | None = None) -> DataFrame:
    """symbol, name of stocks, trusts and business trusts, wherever the response keeps its rows: the first row of each symbol
    that has a name."""
    rows = F.coalesce(*(F.from_json(F.get_json_object(payload, p), "array<string>") for p in ("$.data.prices", "$.data", "$.prices")))
    flat = _pages(captured, payload).select("page", F.posexplode(rows).alias("at", "r")).where(F.get_json_object("r", "$.type").isin("stocks", "reits", "businesstrusts"))
    return _first_symbols(flat.select("page", "at", first_text(F.col("r"), "nc", "code", "symbol").alias("symbol"), first_text(F.col("r"), "n", "name", "companyName").alias("name")), cap)


def idx_rows(captured: DataFrame, payload: str = "payload", cap: int | None = None) -> DataFrame:
    """symbol, name of the exchange's profile pages (page, payload): of each symbol the first row that has a name, by page and place."""
    flat = _pages(captured, payload).select("page", F.posexplode(F.from_json(F.get_json_object(payload, "$.data"), "array<string>")).alias("at", "r"))
    return _first_symbols(flat.select("page", "at", first_text(F.col("r"), "KodeEmiten", "code", "symbol").alias("symbol"), first_text(F.col("r"), "NamaEmiten", "name", "companyName").alias("name")), cap)


# How the exchanges' listing pages write a row, and which group is the symbol and which the name.
LISTING_ROW = (r"(?s)<a[^>]*>\s*([A-Z0-9.\-]{1,12})\s*</a>\s*</td>\s*<td[^>]*>\s*([^<]{2,120}?)\s*</td>", 1, 2)
PSE_ROW = (r"(?s)cmDetail\('(\d+)','(\d+)'\);return false;\">([^<]+)</a></td>\s*<td[^>]*><a[^>]*>([^<]+)</a>", 4, 3)


def exchange_rows(captured: DataFrame, exchange: str, html: str = "html", cap: int | None = None) -> DataFrame:
    """symbol, name, registry, market, listed of an exchange's captured listing page, by the pattern of that exchange."""
    pattern, symbol, name = PSE_ROW if exchange == "pse" else LISTING_ROW
    found = listing_rows(captured, pattern, html, symbol, name, cap)
    return found.select("symbol", "name", F.lit(exchange).alias("registry"), F.lit(exchange.upper()).alias("market"), F.lit("listed").alias("listed"))


#: Columns of a discovered company, and those of them that a register may leave out.
COMPANY = ("key", "name", "country", "industry", "listed", "domain", "registry", "registry_id", "source", "segment", "address", "region", "reg_no", "ticker", "phone", "ir_url", "name_eng", "market")


def built_companies(rows: DataFrame, source: str, registry: str | None) -> DataFrame:
    """Discovered companies of rows (name, and the segment's country, industry and seg_listed; any of listed, domain,
    registry_id, label, address, region, reg_no, ticker, phone, ir_url, name_eng, market): COMPANY and whatever else the
    rows hold.

    A broad segment's industry is the label that the register's code gives, or unclassified; a specific one's stays. The
    segment's label keeps what was searched for. A region that isn't given is read from a Korean address. Rows that nothing
    identifies have a null key.
    """
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    made = {
        "name": F.col("name"), "country": F.col("country"), "industry": industry.resolve_label(F.col("industry"), have("label")), "listed": F.coalesce(have("listed"), "seg_listed"),
        "registry": F.lit(registry).cast("string"), "source": F.lit(source), "segment": F.concat_ws("/", "country", "industry", F.coalesce(have("listed"), "seg_listed") if "listed" in rows.columns else F.col("seg_listed")),
        "region": F.coalesce(F.nullif(have("region"), F.lit("")), identity.korean_region(F.col("country"), have("address"))),
        "key": identity.canonical_key(F.lit(registry).cast("string"), have("registry_id"), have("domain"), F.col("name"), F.col("country")),
    }
    more = [c for c in rows.columns if c not in (*COMPANY, "label", "seg_listed", "sic", "ksic", "headquarters", "exchange", "cik")]
    return rows.select(*(made.get(c, have(c)).alias(c) for c in COMPANY), *more)


# Parts of page titles that name no company (letters and digits only), and what stands between parts.
TITLE_NOISE = (
    "investorrelations", "investorrelation", "investors", "investor", "ir", "relations", "home", "homepage",
    "officialwebsite", "officialsite", "official", "website", "welcome", "about", "aboutus", "company",
    "companyprofile", "profile", "contact", "contactus", "main", "mainpage", "overview", "investorscorner",
    "corporate",
)
TITLE_BREAK = r"\s*(?:::|[|:：•·—–]|\s-\s)\s*"


def company_name(title: Column, domain: Column) -> Column:
    """The longest part of a page title that isn't noise (the first of equals), else the domain's capitalised root.

    A part counts only if it holds an ASCII letter or digit.
    """
    plain = lambda p: F.regexp_replace(F.lower(p), "[^a-z0-9]", "")
    parts = F.filter(F.transform(F.split(title, TITLE_BREAK), lambda p: F.trim(p)), lambda p: (plain(p) != "") & ~plain(p).isin(*TITLE_NOISE))
    best = F.aggregate(parts, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    root = F.substring_index(domain, ".", 1)
    return F.when(best != "", best).otherwise(F.concat(F.upper(F.substring(root, 1, 1)), F.lower(F.substring(root, 2, 255))))


# Header spellings of imported sheets and the fields they name. A header that names a field itself counts too.
HEADERS = {
    "국가": "country", "업체명": "name", "회사명": "name", "사이트": "domain", "홈페이지": "domain", "site": "domain", "도메인": "domain",
    "이메일": "email", "이메일 (IR 우선순위)": "email", "email": "email",
}


def imported(rows: DataFrame) -> DataFrame:
    """key, name, country, domain, email of an imported sheet; rows that identify nothing are left out.

    Headers are trimmed and compared as they are written; of two that name one field the later counts.
    """
    named = {HEADERS.get(c.strip(), c.strip()): c for c in rows.columns}
    get = lambda f: identity.blank_to_null(F.col(f"`{named[f]}`").cast("string")) if f in named else F.lit(None).cast("string")
    out = rows.select(F.coalesce(get("name"), F.lit("")).alias("name"), F.coalesce(get("country"), F.lit("")).alias("country"), get("domain").alias("domain"), get("email").alias("email"))
    none = F.lit(None).cast("string")
    return out.withColumn("key", identity.canonical_key(none, none, F.col("domain"), F.col("name"), F.col("country"))).where("key is not null")


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, UTF-8 with or without a mark."""
    return imported(spark.read.csv(path, header=True, mode="PERMISSIVE", encoding="UTF-8"))


