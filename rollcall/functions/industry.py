"""Industry labels: from codes by the longest prefix, from words, and from what a judge wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import dimensions as D


def matches_prefix(code: Column, prefixes: tuple[str, ...] | Column | None) -> Column:
    """Whether a code begins with one of the prefixes, which may be a column of arrays; without prefixes every row does."""
    if prefixes is None:
        return F.lit(True)
    if isinstance(prefixes, Column):
        return prefixes.isNull() | F.coalesce((code != "") & F.exists(prefixes, lambda p: code.startswith(p)), F.lit(False))
    found = F.lit(False)
    for p in prefixes:
        found = found | code.startswith(p)
    return F.coalesce(found & (code != ""), F.lit(False))


def label_from_code(codes: DataFrame, table: dict[str, tuple[str, ...]], key: str, code: str = "code") -> DataFrame:
    """key, label: the label of the longest prefix of the code; null if none, or if two labels share that length.

    Prefixes are few and short, so a code is exploded into its beginnings and joined by equality.
    """
    prefixes = F.broadcast(D.industry_prefixes(codes.sparkSession, table))  # a fixed table
    longest = max(len(p) for v in table.values() for p in v)
    begins = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.col(code).substr(F.lit(1), n))
    rows = codes.select(key, F.explode_outer(F.array_distinct(F.when(F.coalesce(F.col(code), F.lit("")) != "", begins))).alias("prefix"))
    hits = rows.join(prefixes, "prefix", "left").groupBy(key, F.length("prefix").alias("n")).agg(F.collect_set("label").alias("labels")).where(F.size("labels") > 0)
    best = hits.groupBy(key).agg(F.max_by("labels", "n").alias("labels"))
    return codes.select(key).join(best, key, "left").select(key, F.when(F.size("labels") == 1, F.get("labels", 0)).alias("label"))


def is_broad(industry: Column) -> Column:
    return F.lower(F.trim(F.coalesce(industry, F.lit("")))).isin(*D.BROAD_INDUSTRY)


def is_specific(industry: Column) -> Column:
    return F.lower(F.trim(industry)).isin(*{*D.KSIC, *D.SIC, *D.UK_SIC})


def is_taxonomy_label(value: Column) -> Column:
    return F.coalesce(F.trim(value).isin(D.UNCLASSIFIED, *D.TAXONOMY), F.lit(False))


def resolve_label(industry: Column, code_label: Column) -> Column:
    return F.when(~is_broad(industry), industry).otherwise(F.coalesce(F.nullif(code_label, F.lit("")), F.lit(D.UNCLASSIFIED)))


def label_from_words(*texts: Column) -> Column:
    """The label of the first keyword of the list that occurs; null if none does."""
    hay, found = F.lower(F.concat_ws(" ", *texts)), F.lit(None).cast("string")
    for word, label in reversed(D.KEYWORD_LABELS):
        found = F.when(hay.contains(word), F.lit(label)).otherwise(found)
    return found


def accept_label(raw: Column) -> Column:
    """The label that a judge's answer is, or the first one that it contains."""
    plain = F.trim(F.regexp_replace(F.trim(raw), "^[\"'`.。]+|[\"'`.。]+$", ""))
    labels = F.array(*map(F.lit, D.TAXONOMY))
    return F.when(plain.isin(*D.TAXONOMY), plain).otherwise(F.get(F.filter(labels, lambda x: plain.contains(x)), 0))


def search_term(industry: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in D.EN_INDUSTRY.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(industry))), F.trim(industry))


def search_terms(industry: Column) -> Column:
    table = F.create_map(*(x for k, v in D.EN_INDUSTRY_TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(industry))), F.array(F.trim(industry)))
