"""Contacts of companies from their pages, the lead that they make, and domains for companies without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import identity, pages
from rollcall.sources.scans import hit_domain

# Words of a company's name that say nothing about its domain.
NAME_STOPWORDS = (
    "group", "holdings", "holding", "co", "ltd", "inc", "corp", "corporation", "company", "limited", "plc", "llc", "lp", "the", "and", "of",
    "sa", "ag", "gmbh", "bhd", "pte", "pcl", "tbk", "co.,ltd", "incorporated", "enterprise", "enterprises", "international", "global",
    "industries", "industry",
)
# Fixed value: the pattern of names of funds and vehicles that have no site of their own.
FUND_NAMES = r"(?i)투자신탁|증권투자회사|투자목적회사|유동화전문|펀드|\bETFs?\b|\bUCITS\b|\bSICAV\b|\bFUNDS?\b|INVESTMENT TRUST|TDF\s*20\d\d"


def is_fund(name: Column) -> Column:
    return F.coalesce(name.rlike(FUND_NAMES), F.lit(False))


def name_slug(name: Column) -> Column:
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*NAME_STOPWORDS)), "")


def name_matches(slug: Column, domain: Column) -> Column:
    """The domain's first label equals the slug, or the longer begins with the shorter of at least four letters."""
    brand = F.regexp_replace(F.lower(F.substring_index(domain, ".", 1)), "[^a-z0-9]", "")
    begins = ((F.length(slug) >= 4) & brand.startswith(slug)) | ((F.length(brand) >= 4) & slug.startswith(brand))
    return F.coalesce((F.length(slug) >= 3) & (F.length(brand) >= 3) & ((brand == slug) | begins), F.lit(False))


def resolve_domains(companies: DataFrame, hits: DataFrame, order: str = "key", quota: int = 500, providers: tuple[str, ...] = ("default",)) -> DataFrame:
    """key, provider, domain of the companies for which a search finds their domain.

    companies: key, name, name_eng, country, domain and the order in which they come (unique). Left out are those that have a
    domain, those whose name in either language is a fund's, those whose country has no provider, and those whose name has
    less than three Latin letters or digits for a domain to match (the English name stands in for such a one). Of the rest the
    first `quota` are searched for. Korean companies are looked up with 'naver' alone if it is among the providers,
    all others with 'default'.

    hits: key, provider ('default' if there is no such column), rank, link (and display_link): of a company's hits the first whose domain matches its name, one of
    its country's domain first; portals' domains don't count.
    """
    iso = identity.known_country(F.col("country"))
    default = F.lit("default") if "default" in providers else F.lit(None).cast("string")
    provider = F.when(F.coalesce(iso == "kr", F.lit(False)), "naver").otherwise(default) if "naver" in providers else default
    have = lambda c: F.col(c) if c in companies.columns else F.lit(None).cast("string")
    own, english = name_slug(F.col("name")), name_slug(have("name_eng"))
    slug = F.when(F.length(own) >= 3, own).when(F.coalesce(have("name_eng"), F.lit("")) != "", english)
    wanted = companies.where((F.coalesce(have("domain"), F.lit("")) == "") & ~is_fund(F.col("name")) & ~is_fund(have("name_eng")))
    wanted = wanted.select("key", F.col(order).alias("_order"), slug.alias("slug"), provider.alias("provider"), F.concat(F.lit("."), iso).alias("tld"))
    wanted = wanted.where("provider is not null and length(slug) >= 3").orderBy("_order").limit(max(quota, 0))
    source = F.col("provider") if "provider" in hits.columns else F.lit("default")
    rows = hits.withColumn("domain", hit_domain(hits)).select("key", source.alias("_from"), "rank", "domain").join(wanted, "key")
    rows = rows.where((F.col("_from") == F.col("provider")) & name_matches(F.col("slug"), F.col("domain")))
    first = F.struct((~F.coalesce(F.col("domain").endswith(F.col("tld")), F.lit(False))).cast("int"), "rank")
    best = rows.groupBy("key").agg(F.min_by("domain", first).alias("domain"))
    return wanted.select("key", "provider").join(best, "key").select("key", "provider", "domain")


def company_contacts(captured: DataFrame) -> DataFrame:
    """company, emails, phones, form, contact_page of captured pages (company, page_id, url, html), page_id their order.

    An address has the most certain of its findings; phones, the form and the contact page are those of
    the first page that has one. A company whose pages have nothing keeps a row with empty arrays.
    """
    of = captured.select("page_id", "company")
    emails = pages.page_emails(captured).join(of, "page_id").groupBy("company", "value").agg(F.max("confidence").alias("confidence"))
    entry = F.struct((-F.col("confidence")).alias("c"), "value")
    mails = emails.groupBy("company").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["value"]).alias("emails"))
    numbers = pages.page_phones(captured).join(of, "page_id").groupBy("company", "digits").agg(F.min_by("value", "page_id").alias("value"))
    phones = numbers.groupBy("company").agg(F.array_sort(F.collect_set("value")).alias("phones"))
    forms = pages.page_form(captured).join(of, "page_id").groupBy("company").agg(F.min_by("form_url", "page_id").alias("form"))
    contact = captured.where(pages.is_contact_page(F.col("url"), F.col("html"))).groupBy("company").agg(F.min_by("url", "page_id").alias("contact_page"))
    out = captured.select("company").distinct()
    for part in (mails, phones, forms, contact):
        out = out.join(part, "company", "left")
    empty = F.array().cast("array<string>")
    return out.select("company", F.coalesce("emails", empty).alias("emails"), F.coalesce("phones", empty).alias("phones"), "form", "contact_page")


def escalate(contacts: DataFrame) -> DataFrame:
    """The contacts with a fallback: the contact page stands in for a form where there is neither an address nor a form."""
    needs = (F.size("emails") == 0) & F.col("form").isNull() & F.col("contact_page").isNotNull()
    return contacts.withColumn("fallback", needs).withColumn("form", F.when(needs, F.col("contact_page")).otherwise(F.col("form")))


def dry_contacts(companies: DataFrame) -> DataFrame:
    """key and the three contacts that a dry run gives every company."""
    d = F.coalesce("domain", F.lit("example.com"))
    made = F.array(
        F.struct(F.lit("email").alias("type"), F.concat(F.lit("ir@"), d).alias("value"), F.lit(9).alias("tenths")),
        F.struct(F.lit("phone").alias("type"), F.lit("+82-2-0000-0000").alias("value"), F.lit(6).alias("tenths")),
        F.struct(F.lit("form").alias("type"), F.concat(F.lit("https://"), d, F.lit("/contact")).alias("value"), F.lit(8).alias("tenths")),
    )
    return companies.select("key", F.explode(made).alias("c")).select("key", "c.*")


def finder_addresses(captured: DataFrame, payload: str = "payload", limit: int = 5) -> DataFrame:
    """id, email: what an address finder returned, in its order, up to the limit that was asked for; locked ones left out."""
    one = F.from_json(payload, "data struct<emails: array<struct<value: string>>>")["data"]["emails"]["value"]
    two = F.from_json(payload, "people array<struct<email: string>>")["people"]["email"]
    listed = F.filter(F.coalesce(one, two), lambda e: e.isNotNull() & (e != "") & ~e.startswith("email_not_unlocked"))
    return captured.select("id", F.explode(F.slice(listed, 1, limit)).alias("email"))


def url_variants(url: Column) -> Column:
    """The address itself, its mobile form, and without www: those that differ, in that order."""
    host = F.regexp_extract(url, "^https?://([^/?#:]+)", 1)
    put = lambda new: F.regexp_replace(url, "^(https?://)[^/?#:]+", F.concat(F.lit("$1"), new))
    www = host.startswith("www.")
    apex = ~www & ~host.startswith("m.") & (F.size(F.split(host, r"\.")) <= 2) & (host != "")
    bare = F.substring(host, 5, 1000)
    made = F.array(url, F.when(www, put(F.concat(F.lit("m."), bare))), F.when(apex, put(F.concat(F.lit("m."), host))), F.when(www, put(bare)))
    return F.array_distinct(F.filter(made, lambda u: u.isNotNull()))
