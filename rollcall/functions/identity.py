"""Identity keys as column expressions: names, domains, registration numbers, countries, surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.dimensions import COUNTRIES, KR_REGIONS, LEGAL_SUFFIXES, TWO_LEVEL_LABELS

KEY_LENGTH = 255
_NOT_NAME = "[^0-9a-z가-힣]+"


def blank_to_null(x: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def name_tokens(name: Column) -> Column:
    """Lower-case words of letters, digits and Hangul, legal forms left out; order and repetitions stay."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), _NOT_NAME, " ")), " ")
    return F.filter(words, lambda t: (t != "") & ~t.isin(*LEGAL_SUFFIXES))


def normal_name(name: Column) -> Column:
    return F.array_join(name_tokens(name), "")


def let(value: Column, use) -> Column:
    """use(value), with value computed once and not once for each place where it stands."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def registered_domain(value: Column) -> Column:
    """The host's last two labels, or three below a generic second level of a two-letter country; null without a dot."""
    raw = F.lower(F.trim(value))
    rest = F.regexp_replace(raw, "^[^/]*//", "")
    host = F.regexp_extract(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)

    def root(labels: Column) -> Column:
        size = F.size(labels)
        three = (size >= 3) & F.element_at(labels, -2).isin(*TWO_LEVEL_LABELS) & (F.length(F.element_at(labels, -1)) == 2)
        kept = F.when(three, 3).otherwise(2)
        return F.when((size >= 2) & ~F.get(labels, 0).startswith("["), F.array_join(F.slice(labels, F.greatest(size - kept + 1, F.lit(1)), kept), "."))

    return let(F.split(F.regexp_replace(host, r"^www\.", ""), r"\."), root)


def normal_reg_no(value: Column) -> Column:
    """Letters, digits and Hangul only, lower case; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(value)), _NOT_NAME, ""), F.lit(""))


def known_country(country: Column) -> Column:
    """Lower-case ISO code of a known alias, else null."""
    known = F.create_map(*(F.lit(x) for iso, _, aliases in COUNTRIES for a in aliases for x in (a, iso.lower())))
    return F.try_element_at(known, F.lower(F.trim(F.coalesce(country, F.lit("")))))


def normal_country(country: Column) -> Column:
    """Lower-case ISO code of a known alias, else the trimmed text in lower case."""
    return F.coalesce(known_country(country), F.lower(F.trim(F.coalesce(country, F.lit("")))))


def clamp_key(key: Column) -> Column:
    """Keys over KEY_LENGTH keep their beginning and end in the SHA-1 of the whole."""
    return F.when(F.length(key) > KEY_LENGTH, F.concat(F.substring(key, 1, KEY_LENGTH - 41), F.lit(":"), F.sha1(key))).otherwise(key)


def canonical_key(registry: Column, registry_id: Column, domain: Column, name: Column, country: Column) -> Column:
    """reg: before dom: before name:; null if nothing identifies the row."""
    by_registry = F.when(
        (F.coalesce(registry, F.lit("")) != "") & (F.coalesce(registry_id, F.lit("")) != ""),
        F.concat(F.lit("reg:"), F.lower(F.trim(registry)), F.lit(":"), F.lower(F.trim(registry_id))),
    )
    by_domain = F.concat(F.lit("dom:"), registered_domain(domain))
    plain = normal_name(name)
    by_name = F.when(plain != "", F.concat(F.lit("name:"), normal_country(country), F.lit(":"), plain))
    return clamp_key(F.coalesce(by_registry, by_domain, by_name))


def korean_region(country: Column, address: Column) -> Column:
    """Short name of the province that a Korean address begins with; longer aliases come first."""
    head, found = F.trim(address), F.lit(None).cast("string")
    for alias, label in reversed(KR_REGIONS):
        found = F.when(head.startswith(alias), F.lit(label)).otherwise(found)
    return F.when(F.upper(F.trim(country)) == "KR", found)


def join_address(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *(blank_to_null(p) for p in parts)), F.lit(""))


def surrogate_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix and the first `length` digits of the SHA-1 of the parts joined by '|'."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length))


def company_id(key: Column) -> Column:
    return surrogate_id("c_", 30, key)


def contact_id(company: Column, kind: Column, value: Column) -> Column:
    return surrogate_id("k_", 30, company, kind, value)


def review_id(company: Column, field: Column) -> Column:
    return surrogate_id("r_", 30, company, field)


def send_id(email: Column) -> Column:
    return surrogate_id("e_", 38, email)


def pair_id(a: Column, b: Column) -> Column:
    """SHA-1 of the ordered pair joined by NUL: the same for (a, b) and (b, a)."""
    return F.sha1(F.concat(F.least(a, b), F.lit("\0"), F.greatest(a, b)))
