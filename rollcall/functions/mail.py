"""E-mail addresses: roles, junk, disguises, and the choice of the best."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of the local part, most specific role first; anything else is general.
ROLE_KEYS = (
    ("ir", ("ir", "investor", "investors", "investorrelations", "투자")),
    ("hr", ("hr", "recruit", "recruiting", "recruitment", "career", "careers", "jobs", "humanresources", "인사", "채용")),
    ("press", ("press", "media", "pr", "news", "pressroom", "newsroom", "mediarelations", "publicrelations", "홍보", "보도")),
)
# Endings of files, and domains that stand in for real ones.
ASSET_ENDINGS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "svg", "ico", "css", "js", "pdf", "zip", "mp4", "mp3", "woff", "woff2", "ttf", "eot")
PLACEHOLDER_DOMAINS = (
    "example.com", "example.org", "example.net", "domain.com", "yourdomain.com", "yourcompany.com", "company.com", "sentry.io",
    "sentry-cdn.com", "wix.com", "wixpress.com",
)
# The address pattern, how a local part is split, and the disguises of the two signs.
ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}"
LOCAL_SPLIT = r"[._\-]+|(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])"
DISGUISED_AT = r"(?i)\s*[(\[{]\s*(?:at|골뱅이)\s*[)\]}]\s*"
DISGUISED_DOT = r"(?i)\s*[(\[{]\s*(?:dot|닷|점)\s*[)\]}]\s*"


def local_tokens(local: Column) -> Column:
    """Parts between separators and at the borders of letters and digits."""
    return F.filter(F.split(local, LOCAL_SPLIT), lambda t: t != "")


def role(email: Column) -> Column:
    """ir, hr, press or general: ASCII keys equal a token, Hangul keys are anywhere in the local part."""
    local = F.lower(F.substring_index(F.coalesce(email, F.lit("")), "@", 1))
    tokens = local_tokens(local)
    found = F.lit("general")
    for name, keys in reversed(ROLE_KEYS):
        hit = F.arrays_overlap(tokens, F.array(*(F.lit(k) for k in keys if k.isascii())))
        for k in keys:
            if not k.isascii():
                hit = hit | local.contains(k)
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def accepted(name: Column) -> Column:
    return name.isin("ir", "general")


def is_junk(address: Column) -> Column:
    """A file name, or an address at a placeholder domain or below one."""
    domain = F.substring_index(address, "@", -1)
    bad = (domain == "") | F.substring_index(domain, ".", -1).isin(*ASSET_ENDINGS)
    for d in PLACEHOLDER_DOMAINS:
        bad = bad | (domain == d) | domain.endswith("." + d)
    return bad


def deobfuscate(text: Column) -> Column:
    """(at), [dot] and the like, and the full-width sign, back to @ and a dot."""
    plain = F.replace(text, F.lit("＠"), F.lit("@"))
    plain = F.regexp_replace(plain, DISGUISED_AT, "@")
    return F.regexp_replace(plain, DISGUISED_DOT, ".")


def decode_protected(payload: Column) -> Column:
    """The address in a hex payload whose first byte was combined with all others; null of anything else."""
    key = F.conv(F.substring(payload, 1, 2), 16, 10).cast("int")
    places = F.sequence(F.lit(3), F.length(payload) - 1, F.lit(2))
    byte = lambda i: F.lpad(F.hex(F.conv(F.substring(payload, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key)), 2, "0")
    good = payload.rlike("^([0-9a-fA-F]{2}){2,}$")
    return F.when(good, F.decode(F.unhex(F.array_join(F.transform(places, byte), "")), "UTF-8"))


def rank_accepted(contacts: Column) -> Column:
    """Of an array of (value, role, confidence): the accepted ones, IR first, then confidence, then address."""
    kept = F.filter(contacts, lambda c: accepted(c["role"]))
    keyed = F.transform(kept, lambda c: F.struct(F.when(c["role"] == "ir", 0).otherwise(1).alias("r"), (-c["confidence"]).alias("c"), c["value"].alias("v"), c.alias("contact")))
    return F.transform(F.array_sort(keyed), lambda k: k["contact"])
