"""What captured pages say: addresses, telephone numbers, links, images, forms, and whether anyone is home.

A page is split at the tags of a name, and each part is looked at by itself: no search goes on to the end of
the page, so the work is in proportion to the page whatever is malformed in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import identity, mail

# Fixed values.
IR_HINTS = ("investor", "ir", "투자", "투자자")
CONTACT_HINTS = ("contact", "inquiry", "문의", "고객", "about", "회사소개", "company")
SKIPPED_ENDINGS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".zip", ".doc", ".docx", ".xls")
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp")
MAIL_IMAGE_HINTS = ("mail", "email", "contact", "이메일", "메일", "문의")
FORM_HINTS = (
    "문의", "문의하기", "온라인문의", "1:1", "상담", "상담신청", "견적", "견적문의", "제휴", "제휴문의", "고객센터", "고객지원", "연락", "연락처",
    "contact", "inquiry", "enquiry", "get in touch", "getintouch", "support", "お問い合わせ", "問い合わせ", "お問合せ",
)
FORM_HOSTS = (
    "forms.gle", "typeform.com", "jotform.com", "form.naver.com", "naver.me", "tally.so", "hsforms.com", "hsforms.net",
    "forms.office.com", "surveymonkey.com", "wufoo.com", "formstack.com", "zohopublic.com",
)
FORM_HOST_PATHS = ("docs.google.com/forms", "zoho.com/forms")
FORM_EXCLUDED = ("search", "검색", "login", "log-in", "signin", "sign-in", "로그인", "newsletter", "subscribe", "구독", "mailing", "메일링")
CONTACT_SEGMENTS = ("contact", "contactus", "inquiry", "enquiry")
CONTACT_TITLES = ("문의", "contact us", "contactus", "inquiry", "enquiry")
PARKED_MARKERS = (
    "domain is for sale", "buy this domain", "this domain is parked", "domain may be for sale", "this domain may be for sale",
    "the domain has expired", "domain is parked free", "이 도메인은 판매", "도메인을 구매하", "주차된 도메인",
)
SCANNED = 200_000


def _any(text: Column, hints: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for h in hints:
        found = found | text.contains(h)
    return found


def _ends(text: Column, endings: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for e in endings:
        found = found | text.endswith(e)
    return found


def _after(end: str):
    """For transform: the first part as it is, of each other one what follows its first match of the pattern."""
    return lambda part, i: F.when(i == 0, part).otherwise(F.coalesce(F.get(F.split(part, end, 2), 1), F.lit("")))


def _blocks_removed(html: Column, name: str) -> Column:
    """Without the elements of a name, from each start tag to the next end tag; a start tag without one stays.

    The text is cut once at its last end tag and split once at the start tags before it, so the work is in proportion to
    the page whatever it holds.
    """
    head = F.regexp_extract(html, f"(?is)^(.*</{name}>)", 1)
    rest = F.transform(F.split(head, f"(?i)<{name}"), _after(f"(?i)</{name}>"))
    return F.concat(F.array_join(rest, " "), F.substring(html, F.length(head) + 1, F.length(html)))


def _tags_removed(html: Column, by: str = " ") -> Column:
    """Without tags: what is between < and the next >. Beyond the last > there is none to look for."""
    head = F.regexp_extract(html, "(?s)^(.*>)", 1)
    return F.concat(F.regexp_replace(head, "<[^>]+>", by), F.substring(html, F.length(head) + 1, F.length(html)))


def _unscripted(html: Column) -> Column:
    return identity.let(_blocks_removed(html, "script"), lambda h: _blocks_removed(h, "style"))


def visible_text(html: Column) -> Column:
    """Without scripts, styles and tags, white space collapsed."""
    return F.trim(F.regexp_replace(identity.let(_unscripted(html), _tags_removed), r"\s+", " "))


def summary_text(html: Column, limit: int = 2000) -> Column:
    return F.coalesce(F.substring(visible_text(html), 1, limit), F.lit(""))


def looks_parked(html: Column) -> Column:
    """A marker in a short text, or hardly any text and neither a link nor an image; a null or blank page too."""

    def judged(bare: Column) -> Column:
        text = F.lower(F.trim(F.regexp_replace(_tags_removed(bare), r"\s+", " ")))
        return identity.let(text, lambda t: (_any(t, PARKED_MARKERS) & (F.length(t) < 200)) | ((F.length(t) < 20) & ~bare.rlike("(?i)<(a[ >]|img)")))

    return F.when(F.coalesce(F.trim(html), F.lit("")) == "", True).otherwise(identity.let(_unscripted(html), judged))


# ---------------------------------------------------------------- elements

#: A start tag up to its >, which quoted values may hold too (in the first 200 of them).
_HEAD = r"""^[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+){0,200}+"""
_ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""


def markup(html: Column) -> Column:
    """The page without what holds no elements: comments, scripts and styles, to their end or the page's."""
    for start, end in (("<!--", "-->"), (r"(?i)<script(?=[\s/>])", r"(?i)</script(?=[\s/>])"), (r"(?i)<style(?=[\s/>])", r"(?i)</style(?=[\s/>])")):
        html = F.array_join(F.transform(F.split(html, start), _after(end)), "<!>")  # so that the text before and after doesn't grow together to a tag
    return html


def elements(of: Column, name: str) -> Column:
    """The elements of a name, in order: array of struct<head (the attributes), inner (up to the end tag or the next such start tag)>.

    One split at the start tags; each part is then looked at by itself.
    """
    parts = F.split(of, rf"(?i)<{name}(?=[\s/>])")

    def element(part: Column) -> Column:
        def made(head: Column) -> Column:
            inner = F.substring(part, F.length(head) + 2, F.length(part))
            return F.struct(head.alias("head"), F.get(F.split(inner, rf"(?i)</{name}(?=[\s/>])", 2), 0).alias("inner"))

        return identity.let(F.regexp_extract(part, _HEAD, 0), made)

    return F.transform(F.slice(parts, 2, 1_000_000_000), lambda p: element(p))


def attributes(head: Column, *names: str) -> Column:
    """A struct of the attributes of a start tag (- in a name becomes _): the first of each name, character references of markup
    resolved; null where it isn't there, '' where it has no value."""
    group = lambda n: F.regexp_extract_all(head, F.lit(_ATTRIBUTE), F.lit(n))
    values = F.zip_with(F.zip_with(group(2), group(3), lambda a, b: F.concat(a, b)), group(4), lambda a, b: F.concat(a, b))

    def plain(x: Column) -> Column:
        for seen, meant in (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            x = F.replace(x, F.lit(seen), F.lit(meant))
        return x

    def picked(found: Column) -> Column:
        one = lambda n: identity.let(F.array_position(found["names"], n).cast("int"), lambda at: F.when(at > 0, plain(F.get(found["values"], at - 1))))
        return F.struct(*(one(n).alias(n.replace("-", "_")) for n in names))

    return identity.let(F.struct(F.transform(group(1), lambda x: F.lower(x)).alias("names"), values.alias("values")), picked)


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def page_emails(pages: DataFrame) -> DataFrame:
    """page_id, value, role, confidence (tenths): links 9, protected payloads 9, visible text 6, raw page 4; the first pass that finds an address counts."""
    pattern = f"({mail.ADDRESS})"
    links = F.transform(elements(markup(F.col("html")), "a"), lambda e: attributes(e["head"], "href")["href"])
    linked = F.transform(F.filter(links, lambda h: h.startswith("mailto:")), lambda h: F.substring_index(F.substring(h, 8, 1_000_000), "?", 1))
    hidden = F.transform(all_matches(F.col("html"), r"""data-cfemail=["']([0-9a-fA-F]*)["']"""), lambda x: mail.decode_protected(x))
    hidden = F.concat(hidden, F.transform(all_matches(F.col("html"), r"""/cdn-cgi/l/email-protection#([0-9a-fA-F]+)"""), lambda x: mail.decode_protected(x)))
    in_all = lambda arr: F.flatten(F.transform(F.filter(arr, lambda x: x.isNotNull()), lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))))
    text = mail.deobfuscate(F.substring(visible_text(F.col("html")), 1, SCANNED))
    passes = ((0, 9, in_all(linked)), (1, 9, in_all(hidden)), (2, 6, all_matches(text, pattern)), (3, 4, all_matches(F.substring("html", 1, SCANNED), pattern)))
    marked = lambda n, c: lambda v: F.struct(F.lit(n).alias("pass"), F.lit(c).alias("confidence"), v.alias("raw"))
    found = F.flatten(F.array(*(F.transform(arr, marked(n, c)) for n, c, arr in passes)))
    rows = pages.select("page_id", F.explode(found).alias("f")).select(
        "page_id", "f.pass", "f.confidence", F.lower(F.regexp_replace(F.trim("f.raw"), r"^\.+|\.+$", "")).alias("value")
    )
    good = rows.where((F.col("value") != "") & ~mail.is_junk(F.col("value"))).withColumn("role", mail.role(F.col("value"))).where(mail.accepted(F.col("role")))
    return good.groupBy("page_id", "value", "role").agg(F.min_by("confidence", "pass").alias("confidence"))


def page_phones(pages: DataFrame) -> DataFrame:
    """page_id, digits, value: numbers of tel: links with 8 to 15 digits, the first of each."""
    links = F.transform(elements(markup(F.col("html")), "a"), lambda e: attributes(e["head"], "href")["href"])
    rows = pages.select("page_id", F.posexplode(F.transform(F.filter(links, lambda h: h.startswith("tel:")), lambda h: F.substring(h, 5, 1_000_000))).alias("at", "value"))
    rows = rows.withColumn("digits", F.regexp_replace("value", "[^0-9]", "")).where(F.length("digits").between(8, 15))
    return rows.groupBy("page_id", "digits").agg(F.trim(F.min_by("value", "at")).alias("value"))


def _undotted(path: Column) -> Column:
    """A path without . and .. segments."""
    return identity.let(path, lambda p: F.when(p.rlike(r"/\.\.?(/|$)"), _folded(p)).otherwise(p))


def _folded(path: Column) -> Column:
    none = F.array().cast("array<string>")
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    fold = F.aggregate(F.split(path, "/"), none, lambda a, s: F.when(s == "..", up(a)).when(s == ".", a).otherwise(F.array_append(a, s)))
    joined = F.concat(F.array_join(fold, "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))
    return identity.let(joined, lambda j: F.when(j.startswith("/"), j).otherwise(F.concat(F.lit("/"), j)))


def absolute(base: Column, link: Column) -> Column:
    """A link joined with the page's address: absolute, scheme-relative, rooted, beside the page, or a part of it."""
    return identity.let(F.struct(base.alias("base"), link.alias("link")), lambda x: _joined(x["base"], x["link"]))


def _joined(base: Column, link: Column) -> Column:
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(base, r"^https?://[^/?#]+(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/"))
    path, more = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return (
        F.when(link == "", base)
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.substring_index(base, "//", 1), link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .when(link.startswith("/"), F.concat(root, _undotted(path), more))
        .otherwise(F.concat(root, _undotted(F.concat(folder, path)), more))
    )


def candidate_links(pages: DataFrame, limit: int = 20) -> DataFrame:
    """page_id, ord, link, kind: links of the same registered domain with an IR or a contact hint.

    The first `limit` hinted links in the page's order are taken, and then IR links come first. Where a link comes several times,
    its first place decides.
    """
    rows = pages.select("page_id", "url", F.posexplode(elements(markup(F.col("html")), "a")).alias("at", "e")).select(
        "page_id", "url", "at", F.trim(attributes(F.col("e.head"), "href")["href"]).alias("href"), _tags_removed(F.col("e.inner"), "").alias("label")
    )
    rows = rows.where((F.col("href") != "") & ~F.col("href").rlike("^(mailto:|tel:|javascript:|#)")).withColumn("link", absolute(F.col("url"), F.col("href")))
    rows = rows.where(F.col("link").rlike("^(?i)https?://") & ~_ends(F.lower("link"), SKIPPED_ENDINGS))
    rows = rows.where(identity.registered_domain(F.col("link")) == identity.registered_domain(F.col("url")))
    hint = F.lower(F.concat_ws(" ", "href", "label"))
    kind = F.when(_any(hint, IR_HINTS), 0).when(_any(hint, CONTACT_HINTS), 1)
    first = rows.withColumn("kind", kind).groupBy("page_id", "link").agg(F.min_by("kind", "at").alias("kind"), F.min("at").alias("at"))
    per_page = first.where(F.col("kind").isNotNull()).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "link"))).alias("l"))
    ordered = F.array_sort(F.transform(F.slice("l", 1, limit), lambda x: F.struct(x["kind"].alias("kind"), x["at"].alias("at"), x["link"].alias("link"))))
    return per_page.select("page_id", F.posexplode(ordered).alias("ord", "x")).select("page_id", "ord", "x.link", "x.kind")


def candidate_images(pages: DataFrame, limit: int = 5) -> DataFrame:
    """page_id, ord, link: the first `limit` images, those that may show an address first."""
    rows = pages.select("page_id", "url", F.posexplode(elements(markup(F.col("html")), "img")).alias("at", "e"))
    rows = rows.select("page_id", "url", "at", attributes(F.col("e.head"), "src", "alt").alias("i")).select("page_id", "url", "at", F.trim("i.src").alias("src"), F.coalesce("i.alt", F.lit("")).alias("alt"))
    rows = rows.where((F.col("src") != "") & ~F.col("src").startswith("data:")).withColumn("link", absolute(F.col("url"), F.col("src")))
    rows = rows.where(F.col("link").rlike("^(?i)https?://") & _ends(F.substring_index(F.lower("link"), "?", 1), IMAGE_ENDINGS))
    plain = F.when(_any(F.lower(F.concat_ws(" ", "src", "alt")), MAIL_IMAGE_HINTS), 0).otherwise(1)
    first = rows.withColumn("plain", plain).groupBy("page_id", "link").agg(F.min_by("plain", "at").alias("plain"), F.min("at").alias("at"))
    per_page = first.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "plain", "link"))).alias("l"))
    ordered = F.array_sort(F.transform(F.slice("l", 1, limit), lambda x: F.struct(x["plain"].alias("plain"), x["at"].alias("at"), x["link"].alias("link"))))
    return per_page.select("page_id", F.posexplode(ordered).alias("ord", "x")).select("page_id", "ord", "x.link")


def is_contact_page(url: Column, html: Column) -> Column:
    """By a segment of the path, or the first title or a heading."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    segments = F.split(path, r"[/_.\-]+")

    def heads(page: Column) -> Column:
        title = F.get(elements(page, "title"), 0)["inner"]
        return F.lower(F.concat_ws(" ", title, F.array_join(F.transform(elements(page, "h1"), lambda e: _tags_removed(e["inner"], "")), " ")))

    said = identity.let(markup(html), heads)
    return F.arrays_overlap(segments, F.array(*map(F.lit, CONTACT_SEGMENTS))) | path.contains("문의") | F.coalesce(_any(said, CONTACT_TITLES), F.lit(False))


def _form_entry(form: Column, url: Column) -> Column:
    """confidence (0: no form for inquiries) and form_url of one form element."""
    kind = lambda e: F.lower(F.coalesce(F.nullif(attributes(e["head"], "type")["type"], F.lit("")), F.lit("text")))
    kinds = lambda n: F.transform(elements(form["inner"], n), lambda e: kind(e))
    given = attributes(form["head"], "action", "id", "class", "name", "aria-label", "role")

    def named(a: Column) -> Column:
        return F.struct(
            a["action"].alias("action"), F.lower(F.coalesce(a["role"], F.lit(""))).alias("role"), F.lower(F.concat_ws(" ", a["action"], a["id"], a["class"], a["name"], a["aria_label"])).alias("names"),
            F.lower(_tags_removed(form["inner"], "")).alias("text"), form["inner"].rlike(r"(?i)<textarea[\s/>]").alias("message"), kinds("input").alias("inputs"), F.concat(kinds("textarea"), kinds("select")).alias("others"),
        )

    def judged(f: Column) -> Column:
        fields = F.size(F.filter(F.concat(f["inputs"], f["others"]), lambda t: ~t.isin("hidden", "submit", "button", "checkbox", "radio", "image", "reset")))
        few = fields <= 1
        excluded = F.array_contains(f["inputs"], "password") | (f["role"] == "search") | (few & (F.array_contains(f["inputs"], "search") | (~f["message"] & _any(f["names"], FORM_EXCLUDED))))
        hinted = _any(f["names"], FORM_HINTS) | _any(f["text"], FORM_HINTS)
        target = F.when(F.coalesce(f["action"], F.lit("")) == "", url).otherwise(absolute(url, f["action"]))
        return F.struct(F.when(hinted & ~excluded, F.when(f["message"], 60).otherwise(45)).otherwise(0).alias("confidence"), target.alias("form_url"))

    return identity.let(identity.let(given, named), judged)


def _provides_forms(link: Column) -> Column:
    def known(place: Column) -> Column:
        host, found = F.substring_index(place, "/", 1), F.lit(False)
        for h in FORM_HOSTS:
            found = found | (host == h) | host.endswith("." + h)
        for p in FORM_HOST_PATHS:
            found = found | place.startswith(p)
        return found

    return identity.let(F.regexp_extract(F.lower(link), "^https?://([^?#]*)", 1), known)


def page_form(pages: DataFrame) -> DataFrame:
    """page_id, form_url, confidence (hundredths): an embedded form 70, one with a message field 60, one with a hint 45; the first of the best."""
    page = pages.select("page_id", "url", markup(F.col("html")).alias("m"))
    srcs = F.filter(F.transform(elements(F.col("m"), "iframe"), lambda e: F.trim(attributes(e["head"], "src")["src"])), lambda s: s != "")
    frames = F.filter(F.transform(srcs, lambda s: absolute(F.col("url"), s)), lambda x: _provides_forms(x))
    listed = page.select("page_id", F.get(frames, 0).alias("embedded"), F.transform(elements(F.col("m"), "form"), lambda f: _form_entry(f, F.col("url"))).alias("forms"))
    good = F.filter("forms", lambda f: f["confidence"] > 0)
    best = F.array_max(F.transform(good, lambda f: f["confidence"]))
    chosen = F.get(F.filter(good, lambda f: f["confidence"] == best), 0)
    return listed.select(
        "page_id", F.coalesce("embedded", chosen["form_url"]).alias("form_url"), F.when(F.col("embedded").isNotNull(), 70).otherwise(chosen["confidence"]).alias("confidence")
    ).where("form_url is not null")
