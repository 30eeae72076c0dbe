"""Which profile a captured response fits: weighted rules over its cookies, headers, server name and body."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import identity

#: Confidence (tenths) of a response that no profile fits.
NOTHING = ("unknown_challenge", 1, "fallback")


@dataclass(frozen=True)
class Profile:
    """Names (cookie, header: with *, ? and [...] as in file names) and texts (server, body) that speak for a profile, and how
    many of them make it likely (6 tenths) or nearly sure (9); fewer give 3."""

    name: str
    cookie: tuple[str, ...] = ()
    header: tuple[str, ...] = ()
    server: tuple[str, ...] = ()
    body: tuple[str, ...] = ()
    strong: int = 2
    weak: int = 1
    rules: list[tuple[str, str]] = field(init=False, repr=False, compare=False, default_factory=list)

    def __post_init__(self) -> None:
        self.rules.extend((kind, p) for kind in ("cookie", "header", "server", "body") for p in getattr(self, kind))


def _as_regex(pattern: str) -> str:
    """A file-name pattern as a regular expression of Java for the whole of a name in lower case."""
    out, i, low = "", 0, pattern.lower()
    while i < len(low):
        c = low[i]
        end = low.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inside = low[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.sub(r"([^a-z0-9_ ])", r"\\\1", c)
        i += 1
    return f"(?s)^{out}$"


def _scored(p: Profile, order: int):
    return lambda s: F.struct(
        (-F.when(F.size(s) == 0, 0).when(F.size(s) >= p.strong, 9).when(F.size(s) >= p.weak, 6).otherwise(3)).alias("c"),
        F.lit(order).alias("o"), F.lit(p.name).alias("profile"), s.alias("signals"), F.size(s).alias("n"),
    )


def fitting_profiles(responses: DataFrame, profiles: list[Profile], least: int = 0) -> DataFrame:
    """id, rank (from 1), profile, confidence (tenths), signals: the profiles that a response shows signs of, the surest first, then
    in the order of the list; a response without any gets one row of NOTHING.

    responses: id, cookies array<string> (their names), headers map<string, string>, body. Nulls are empty. A sign is `kind:pattern`.
    Profiles whose name begins with _, and confidences under `least`, don't count. The rules are the caller's and few: they
    become one expression, and nothing is joined or shuffled.
    """
    names = F.transform(F.coalesce("cookies", F.array().cast("array<string>")), lambda c: F.lower(c))
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    keys = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    server = F.coalesce(F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "server")), 0), F.lit(""))
    seen = F.struct(names.alias("cookie"), keys.alias("header"), server.alias("server"), F.lower(F.coalesce("body", F.lit(""))).alias("body"))

    def sign(x: Column, kind: str, pattern: str) -> Column:
        if kind in ("server", "body"):
            return x[kind].contains(pattern.lower())
        if any(c in pattern for c in "*?["):
            return F.exists(x[kind], lambda k: k.rlike(_as_regex(pattern)))
        return F.array_contains(x[kind], pattern.lower())

    def ranked(x: Column) -> Column:
        made = []
        for order, p in enumerate(p for p in profiles if not p.name.startswith("_") and p.rules):
            found = F.array_compact(F.array(*(F.when(sign(x, kind, pattern), F.lit(f"{kind}:{pattern}")) for kind, pattern in p.rules)))
            made.append(identity.let(found, _scored(p, order)))
        hits = F.filter(F.array(*made), lambda h: (h["n"] > 0) & (-h["c"] >= least)) if made else F.array().cast("array<struct<c: int, o: int, profile: string, signals: array<string>, n: int>>")
        name, sure, why = NOTHING
        none = F.array(F.struct(F.lit(-sure).alias("c"), F.lit(0).alias("o"), F.lit(name).alias("profile"), F.array(F.lit(why)).alias("signals"), F.lit(1).alias("n")))
        return identity.let(hits, lambda h: F.when(F.size(h) > 0, F.array_sort(h)).otherwise(none))

    rows = responses.select("id", F.posexplode(identity.let(seen, ranked)).alias("at", "h"))
    return rows.select("id", (F.col("at") + 1).alias("rank"), "h.profile", (-F.col("h.c")).alias("confidence"), "h.signals")
