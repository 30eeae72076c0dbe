"""Quality rules whose cut-offs carry a guarantee: with few exceptions, good texts pass.

Each rule compares one statistic of a text with a cut-off. Labelled texts are the holdout: for each
stratum and rule the cut-offs are tested from the loosest to the strictest, with the exact binomial
probability of so few rejected good texts if the rule truly rejected more than its share of them. The
tests of one rule and stratum are a fixed sequence, and the level is divided by the number of rules and
strata, so with probability 1 - delta no stratum loses more than alpha of its good texts. Among the
cut-offs that pass, the one with the most bad texts beyond the good ones rejected is used; a rule with
no such cut-off rejects nothing in that stratum. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.session import materialise

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
RULES = ("symbols", "dup_lines", "repeats", "capitals")
#: Cut-offs in thousandths, from strict to loose.
GRID = (1, 2, 5, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)
ALPHA, DELTA = 0.02, 0.05


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def _share(part: str, whole: str) -> Column:
    """Thousandths, rounded down; 0 of nothing."""
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(0).cast("int")


def text_statistics(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, and of each whole text the counts and shares that the rules use.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs); symbols, dup_lines, repeats,
    capitals (thousandths). A null text counts as empty; all its values are 0. One row out for each row in.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    # names with a dot before them cannot clash with those of a user's table
    first = documents.select(*keep, value.alias("_text"), _words(value).alias("_words"), F.split(value, "\n").alias("_lines"))
    first = first.select(
        *keep,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace("_text", WORD_BREAK, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]", ""))).cast("long").alias("_capitals"),
    )
    # every window of five words by its hash and place, sorted: equal windows are neighbours
    window = F.expr(
        f"""CASE WHEN n_words >= {WINDOW} THEN sort_array(transform(sequence(0, cast(n_words as int) - {WINDOW}),
            i -> struct(xxhash64({", ".join(f"_words[i + {k}]" for k in range(WINDOW))}) AS h, i AS i))) END"""
    )
    second = first.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "_capitals",
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        window.alias("_windows"),
    )
    repeated = F.expr(
        """sort_array(transform(filter(sequence(0, size(_windows) - 1), k -> coalesce(
               get(_windows, k).h = get(_windows, k - 1).h OR get(_windows, k).h = get(_windows, k + 1).h,
               get(_windows, k).h = get(_windows, k - 1).h, get(_windows, k).h = get(_windows, k + 1).h, false)),
           k -> get(_windows, k).i))"""
    )
    third = second.select("*", F.when(F.col("_windows").isNotNull(), repeated).alias("_at")).drop("_windows")
    covered = F.expr(
        f"""aggregate(_at, named_struct('n', 0L, 'last', -{WINDOW}),
            (acc, p) -> named_struct('n', acc.n + least({WINDOW}, p - acc.last), 'last', p), acc -> acc.n)"""
    )
    fourth = third.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("_at")
    return fourth.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        _share("n_symbols", "word_chars").alias("symbols"),
        _share("n_dup_lines", "_n_lines").alias("dup_lines"),
        _share("n_repeat_words", "n_words").alias("repeats"),
        _share("_capitals", "word_chars").alias("capitals"),
    )


def _binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly, for k <= p * n; 1 beyond (no cut-off there can pass).

    The terms below the last are summed relative to it: s(i) = 1 + s(i - 1) * i / (n - i + 1) * (1 - p) / p.
    """
    walk = F.expr(
        f"""aggregate(CASE WHEN _k > 0 THEN sequence(1L, _k) ELSE array() END, named_struct('s', 1D, 'c', 0D),
            (a, i) -> named_struct('s', 1D + a.s * i / (_n - i + 1) * {(1 - p) / p!r}D, 'c', a.c + ln((_n - i + 1) / i)))"""
    )
    tail = F.exp(walk["c"] + k * math.log(p) + (n - k) * math.log(1 - p)) * walk["s"]
    return F.when(k <= n * p, tail).otherwise(1.0)


def learn_cutoffs(
    statistics: DataFrame, labels: DataFrame, stratum: str = "stratum", alpha: float = ALPHA, delta: float = DELTA, key: str = "doc_id"
) -> DataFrame:
    """stratum, rule, cutoff: reject where the rule's statistic is above the cut-off.

    labels: key and quality (1 good, 0 bad); other values and nulls are left out, and of several labels
    of one key the least counts. Each rule gets alpha / (number of rules). A stratum without labels, or
    with too few, gets no row.
    """
    known = labels.where("quality in (0, 1)").groupBy(key).agg(F.min("quality").alias("_good"))
    rows = statistics.join(known, key).select(F.col(stratum).alias("stratum"), "_good", *RULES)
    values = rows.select("stratum", "_good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES))).alias("x"))
    steps = F.filter(F.array(*map(F.lit, GRID)), lambda g: F.col("x.v") > g)
    counts = (
        values.select("stratum", "_good", "x.rule", F.size(steps).alias("beyond"))
        .groupBy("stratum", "rule", "beyond").agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad"))
    )
    sizes = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("_n"))
    grid = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("at"), F.lit(g).alias("cutoff")) for i, g in enumerate(GRID)))).alias("g")
    cuts = sizes.select("stratum", "rule", "_n", grid).select("stratum", "rule", "_n", "g.at", "g.cutoff")
    tested = (
        cuts.join(counts, ["stratum", "rule"]).groupBy("stratum", "rule", "_n", "cutoff").agg(
            F.sum(F.when(F.col("beyond") >= F.col("at"), F.col("good")).otherwise(0)).alias("_k"),
            F.sum(F.when(F.col("beyond") >= F.col("at"), F.col("bad")).otherwise(0)).alias("bad"),
        )
    )
    strata = sizes.agg(F.countDistinct("stratum").alias("strata"))
    tested = tested.crossJoin(F.broadcast(strata))  # one row
    level = F.lit(delta / len(RULES)) / F.col("strata")
    # the tail falls as the cut-off loosens, so each cut-off that passes has all looser ones before it in the sequence
    passed = tested.where(_binomial_tail(F.col("_n"), F.col("_k"), alpha / len(RULES)) <= level).where(F.col("bad") > F.col("_k"))
    best = F.max_by("cutoff", F.struct(F.col("bad") - F.col("_k"), "cutoff"))
    return passed.groupBy("stratum", "rule").agg(best.alias("cutoff"))


def judge(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """Per row: doc_id, the counts of text_statistics, base_failed and kept; strata are languages (null: one of its own).

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated five-word windows.
    kept: not base_failed, and no statistic above its stratum's cut-off. Empty tables give no rows.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("stratum"))
    found = materialise(text_statistics(rows, keep=("doc_id", "stratum")), "statistics")
    cutoffs = learn_cutoffs(found, labels.withColumnRenamed(doc_id, "doc_id"), alpha=alpha, delta=delta)
    by_stratum = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES))
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"_{r}"), F.lit(False))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.join(by_stratum, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~over).alias("kept")
    )


_RULE_LIST = ", ".join(f"('{r}', {r})" for r in RULES)
_GRID_LIST = ", ".join(map(str, GRID))

#: The same in DuckDB.
JUDGE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, i, ws[i : i + 4] AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY rid
), s AS (
  SELECT w.rid, doc_id, stratum, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, len(ls) AS n_lines
  FROM w LEFT JOIN rep ON w.rid = rep.rid
), r AS (
  SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats,
         CASE WHEN word_chars > 0 THEN n_capitals * 1000 // word_chars ELSE 0 END AS capitals
  FROM s
), known AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
x AS (
  SELECT stratum, good, v.rule, v.v FROM r JOIN known USING (doc_id),
  LATERAL (VALUES {_RULE_LIST}) AS v(rule, v)
), cuts AS (
  SELECT stratum, rule, cutoff, sum(good) AS n, sum(CASE WHEN v > cutoff THEN good ELSE 0 END) AS k,
         sum(CASE WHEN v > cutoff THEN 1 - good ELSE 0 END) AS bad
  FROM x, (SELECT unnest([{_GRID_LIST}]) AS cutoff) GROUP BY ALL
), tested AS (
  SELECT *, CASE WHEN k > n * {ALPHA / len(RULES)!r} THEN 1 ELSE (
      SELECT sum(exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - CASE WHEN n - i > 0 THEN lgamma(n - i + 1) ELSE 0 END
             + i * ln({ALPHA / len(RULES)!r}) + (n - i) * ln({1 - ALPHA / len(RULES)!r})))
      FROM (SELECT unnest(range(0, (k + 1)::BIGINT)) AS i)) END AS p
  FROM cuts
), best AS (
  SELECT stratum, rule, max_by(cutoff, (bad - k) * 10000 + cutoff) AS cutoff FROM tested
  WHERE bad > k AND p <= {DELTA / len(RULES)!r} / (SELECT count(DISTINCT stratum) FROM x) GROUP BY ALL
), verdict AS (
  SELECT r.rid FROM r JOIN best b USING (stratum)
  WHERE CASE b.rule WHEN 'symbols' THEN symbols WHEN 'dup_lines' THEN dup_lines WHEN 'repeats' THEN repeats ELSE capitals END > b.cutoff
), base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM verdict) AS kept
FROM base
"""
