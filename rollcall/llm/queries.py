"""One query for each operator of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.session import materialise, new_folder, remove_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=2048)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.toxicity import held_out, learn, score_toxicity

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    model = learn(documents, labels)
    return score_toxicity(documents, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.html_render import extract_text

    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.lm_score import cross_entropy_difference

    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), digests=True)


def op9_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.neighbours import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.chat import digests, format_trees, thread_by_turn

    both = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(format_trees(thread_by_turn(rows)))


def op11_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.token_orc import document_digests, write_tokens

    path = new_folder(spark, "token-files")
    write_tokens(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"), end_id=2)
    found = materialise(document_digests(spark, path), "token-digests")
    remove_folder(spark, path)
    return found


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.divergence import audit_sources

    return audit_sources(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollcall.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_toxicity,
        op3_ngram_jaccard,
        op4_html_extraction,
        op5_line_dedup,
        op6_quality_rules,
        op7_lm_scoring,
        op8_bpe,
        op9_embedding_near_dup,
        op10_chat_format,
        op11_token_orc,
        op12_source_divergence,
        op13_embedding_whitening,
    )
}

_OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [md5(array_to_string(w, ' '))]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i : i + 3], ' ')))) END AS s FROM d
), c AS MATERIALIZED (
  SELECT min(doc_id) AS rep, len(k) AS n, k FROM (SELECT doc_id, list_sort(s) AS k FROM s) WHERE len(k) > 0 GROUP BY k
), t AS (SELECT rep, n, unnest(k) AS g FROM c),
f AS (SELECT g, count(*) AS df FROM t GROUP BY g),
p AS MATERIALIZED (
  SELECT rep, n, g FROM (SELECT t.rep, t.n, t.g, row_number() OVER (PARTITION BY t.rep ORDER BY f.df, t.g) AS r FROM t JOIN f ON t.g = f.g)
  WHERE r <= n - (85 * n + 99) // 100 + 1
), cand AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), e AS MATERIALIZED (
  SELECT a, b FROM (SELECT cand.a, cand.b, x.n AS na, y.n AS nb, len(list_intersect(x.k, y.k)) AS o
                    FROM cand JOIN c x ON x.rep = cand.a JOIN c y ON y.rep = cand.b)
  WHERE 100 * o >= 85 * (na + nb - o)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS x, a AS y FROM both_ways UNION SELECT r.x, w.b FROM reach r JOIN both_ways w ON r.y = w.a),
comp AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(comp.m, c.rep, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.k = list_sort(s.s) LEFT JOIN comp ON comp.x = c.rep
"""

#: lists of the digests that one sorted conversation gives; its template is written out in the escape patterns.
_OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '(<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])', '\1\4\2\5\\\3\6', 'g') AS escaped FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || escaped || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


#: Whole numbers beyond 63 bits are HUGEINT; terms are compared by their UTF-8 bytes, as DuckDB compares texts.
_OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
o AS MATERIALIZED (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 3),
c AS MATERIALIZED (SELECT o.* FROM o SEMI JOIN k ON o.lang = k.lang AND o.t = k.t),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS MATERIALIZED (
  SELECT s.lang, s.source, k.t, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.total + v.v))::HUGEINT AS p
  FROM s JOIN k ON s.lang = k.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.t = k.t
), q AS MATERIALIZED (
  SELECT x.lang, x.t, (1 + 1000000000::HUGEINT * (x.n + 1) // (y.total + v.v))::HUGEINT AS q
  FROM (SELECT lang, t, sum(n) AS n FROM c GROUP BY ALL) x JOIN (SELECT lang, sum(total) AS total FROM s GROUP BY lang) y ON x.lang = y.lang JOIN v ON v.lang = x.lang
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS s1, b.source AS s2, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.s1 = a.source AND x.s2 = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.t, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.t = q.t WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 200
"""


def _oracles() -> dict[str, str]:
    from rollcall.llm.quality import JUDGE_SQL

    return {"op3_ngram_jaccard": _OP3_SQL, "op6_quality_rules": JUDGE_SQL, "op10_chat_format": _OP10_SQL, "op12_source_divergence": _OP12_SQL}


ORACLE_SQL: dict[str, str] = _oracles()
