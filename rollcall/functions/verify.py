"""Decision ladders over recorded probes: existence, e-mail validity, registries, deliverability, responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions import identity


def existence(domain: Column, site_ok: Column, dns_ok: Column, registry_active: Column) -> Column:
    """struct(is_active, site_alive, hundredths): a registry's word first, then the site, with DNS beside it."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    alive = (F.coalesce(domain, F.lit("")) != "") & yes(site_ok)
    active = F.coalesce(registry_active, alive)
    sure = F.when(registry_active.isNotNull(), 90).when(alive & yes(dns_ok), 85).when(alive, 70).otherwise(0)
    return F.struct(active.alias("is_active"), alive.alias("site_alive"), sure.alias("hundredths"))


def email_format_ok(email: Column) -> Column:
    """Exactly one @ and a dot after it."""
    parts = F.split(email, "@")
    return (F.size(parts) == 2) & F.coalesce(F.get(parts, 1), F.lit("")).contains(".")


def email_validation(email: Column, company_domain: Column, has_mx: Column, smtp_result: Column, vendor_result: Column, vendor: str = "vendor") -> Column:
    """struct(status, domain_match, smtp, provider): format, MX, domain, SMTP, then a vendor; each may only correct the one before.

    A company without a domain asks for no match; one whose domain has no normal form matches no address. provider
    is who decided: nobody (null) of a malformed address, "mx", "smtp", or the vendor's name.
    """
    good = email_format_ok(email)
    mx = good & F.coalesce(has_mx, F.lit(False))
    own = identity.registered_domain(F.substring_index(email, "@", -1))
    wanted = identity.registered_domain(company_domain)
    given = F.coalesce(company_domain, F.lit("")) != ""
    match = good & given & own.eqNullSafe(wanted)
    base = F.when(~mx, "invalid").when(match | ~given, "valid").otherwise("risky")
    smtp = F.when(mx & (smtp_result == "deliverable"), True).when(mx & (smtp_result == "undeliverable"), False)
    after = F.when(smtp == F.lit(False), "invalid").when(smtp & (base == "risky"), "valid").otherwise(base)
    asked = after != "invalid"
    last = F.when(asked & (vendor_result == "bad"), "invalid").when(asked & (vendor_result == "ok") & (after == "risky"), "valid").otherwise(after)
    provider = F.when(~good, F.lit(None)).when(asked & vendor_result.isin("bad", "ok"), vendor).when(smtp.isNotNull(), "smtp").otherwise("mx")
    return F.struct(last.alias("status"), match.alias("domain_match"), smtp.alias("smtp"), provider.alias("provider"))


# The words of a register for companies that exist, and for those that are gone.
REGISTERED = ("active", "registered", "open")
DEFUNCT = ("dissolved", "liquidation", "receivership", "administration", "converted-closed", "insolvency-proceedings", "removed", "closed")


def registry_status(registry: Column, status: Column, inactive: Column, registry_id: Column | None = None) -> Column:
    """True, false, or null where the registry doesn't say, or where an id is given that it cannot look up."""
    s, name = F.lower(F.trim(status)), F.lower(F.trim(registry))
    number = F.lit("x/x") if registry_id is None else F.trim(registry_id)
    safe = r"[A-Za-z0-9._-]+"
    own = F.lit(True) if registry_id is None else F.coalesce(number.rlike(f"^{safe}$"), F.lit(False))
    split = F.coalesce(number.rlike(f"^{safe}/{safe}$"), F.lit(False))
    return (
        F.when((name == "companies_house") & own, F.when(s.isin(*DEFUNCT), False).when(s.isin(*REGISTERED), True))
        .when((name == "opencorporates") & split, ~inactive)
    )


def smtp_verdict(codes: Column, catch_all: Column) -> Column:
    """bad at 550, 551 or 553; 250 is ok unless anything is accepted there; else the second host, else unknown."""
    one = lambda c, all_: F.when(c.isin(550, 551, 553), "bad").when((c == 250) & all_, "unknown").when(c == 250, "ok")
    return F.coalesce(one(F.get(codes, 0), F.get(catch_all, 0)), one(F.get(codes, 1), F.get(catch_all, 1)), F.lit("unknown"))


# The vendors' words.
ZEROBOUNCE = {"valid": "ok", "invalid": "bad", "spamtrap": "bad", "abuse": "bad", "do_not_mail": "bad", "catch-all": "unknown", "unknown": "unknown"}
NEVERBOUNCE = {"valid": "ok", "invalid": "bad", "disposable": "bad", "catchall": "unknown", "unknown": "unknown"}


def vendor_verdict(words: dict[str, str], said: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(said)), F.lit("unknown"))


# Words of challenge pages, and the length below which a page without other proof counts as one.
CHALLENGE_WORDS = (
    "Access Denied", "sec-if-cpt-container", "Powered and protected by Akamai", "Just a moment...", "Checking your browser", "cf-chl-bypass",
    "Attention Required! | Cloudflare", "<title>Bot Challenge</title>", "DataDome", "captcha", "Please enable JS and disable any ad blocker",
    "The requested URL was rejected", "Request unsuccessful. Incapsula",
)
SMALL_BODY = 3000


def response_verdict(status: Column, body: Column, found: Column | None = None, unresolved: Column | None = None, bad_sizes: tuple[int, ...] = (), tolerance: int = 20) -> Column:
    """blocked, challenge, weak_ok or strong_ok, of a captured response.

    A status of 0 (or none) or of 400 and above blocks; then words of challenge pages, then known sizes of such. found:
    whether something that was asked for is in the page (null where nothing was asked for), which decides whatever the
    size, though only weakly with an unresolved session; without it a small page is a challenge.
    """
    text = F.coalesce(body, F.lit(""))
    low, size, code = F.lower(text), F.length(text), F.coalesce(status, F.lit(0))
    said, known = F.lit(False), F.lit(False)
    for word in CHALLENGE_WORDS:
        said = said | low.contains(word.lower())
    for bad in bad_sizes:
        known = known | (F.abs(size - bad) <= tolerance)
    asked = F.lit(None).cast("boolean") if found is None else found
    open_ = F.lit(False) if unresolved is None else F.coalesce(unresolved, F.lit(False))
    return (
        F.when((code == 0) | (code >= 400), "blocked").when(said | known, "challenge")
        .when(asked & open_, "weak_ok").when(asked, "strong_ok").when(~asked, "challenge")
        .when(size < SMALL_BODY, "challenge").otherwise("weak_ok")
    )
