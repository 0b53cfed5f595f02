"""Queries of the text operators, each over a whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, importance, jaccard, media, mixing, pii, quality_rules, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """(path, pattern) of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.attribute(_table(spark, sf_dir, "documents"), *vocabulary())
    return rows.withColumn("section_tokens", F.array_join(F.transform("section_tokens", lambda x: x.cast("string")), ","))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir, "documents"), *vocabulary()))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    return chat.digests(chat.format_trees(chat.turn_trees(rows)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii, op2_importance, op3_token_counts, op4_ngram_jaccard, op5_mixing, op6_quality_rules, op7_media, op8_toxicity, op9_bpe, op10_chat)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": OP1_SQL, "op4_ngram_jaccard": OP4_SQL, "op6_quality_rules": OP6_SQL, "op10_chat": OP10_SQL}


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) AS n FROM lines WHERE k > 1 GROUP BY doc_id
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, w.host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM f GROUP BY host
), p AS (
  SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h
), s AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM p
), v AS (
  SELECT host, (bad + m * s) / (n + s) <= 0.5 AS ok FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept, f.host
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""

OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(role) + 11 + 2 * (length(role || text) - length(regexp_replace(role || text, '[%<|\[]', '', 'g'))) AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS origin FROM documents UNION SELECT e.y, r.origin FROM r JOIN e ON e.x = r.node WHERE r.origin < e.y
), c AS (
  SELECT node, min(origin) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""

_KIND_SQL = "SELECT doc_id, text, {k} AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM t WHERE text LIKE '%{like}%'"
_SPANS_SQL = " UNION ALL ".join(
    _KIND_SQL.format(k=k, p=p, like=like)
    for k, (p, like) in enumerate(
        (
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@"),
            (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "."),
            (r"[0-9](?:[\x20-]?[0-9])+", ""),
            (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
        )
    )
)
_TERM_SQL = r"[\p{L}\p{M}\p{N}]{2,}"
OP1_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), found AS (
  {_SPANS_SQL}
), u AS (
  SELECT doc_id, kind, unnest(m) AS v, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0
), placed AS (
  SELECT *, (sum(length(gap) + length(v)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS b, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM u
), b AS (
  SELECT doc_id, kind, b - length(v) AS a, b, v FROM placed
  WHERE CASE kind WHEN 1 THEN list_aggregate(list_transform(string_split(v, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE coalesce(try_cast(x AS INT), 999) END), 'max') <= 255
    WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INT WHEN digits[i]::INT > 4 THEN 2 * digits[i]::INT - 9 ELSE 2 * digits[i]::INT END)) % 10 = 0
    WHEN 3 THEN length(digits) BETWEEN 9 AND 15 ELSE true END
), reached AS (
  SELECT doc_id, a, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM b
), pieces AS (
  SELECT doc_id, lo, a AS hi FROM reached WHERE a >= lo
  UNION ALL SELECT doc_id, (SELECT coalesce(max(b), 0) FROM b WHERE b.doc_id = t.doc_id), length(text) FROM t
), cut AS (
  SELECT doc_id, lo, regexp_extract_all(text[lo+1:hi], '{_TERM_SQL}') AS m, string_split_regex(text[lo+1:hi], '{_TERM_SQL}') AS g FROM pieces JOIN t USING (doc_id)
), each AS (
  SELECT doc_id, lo, unnest(m) AS v, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM cut WHERE len(m) > 0
), token AS (
  SELECT doc_id, lower(v) AS term, length(v) AS size, (lo + sum(length(gap) + length(v)) OVER (PARTITION BY doc_id, lo ORDER BY i))::BIGINT AS te FROM each
), has AS (
  SELECT DISTINCT doc_id, term FROM token
), names AS (
  SELECT DISTINCT doc_id, kind || ':' || v AS entity, CASE WHEN kind = 0 THEN list_transform(regexp_extract_all(v, '{_TERM_SQL}'), lambda x: lower(x)) ELSE [] END AS own FROM b
), total AS (
  SELECT count(*)::DOUBLE AS n FROM documents
), te AS (
  SELECT term, entity, count(DISTINCT doc_id) AS n_te FROM has JOIN names USING (doc_id) GROUP BY term, entity, own
  HAVING count(DISTINCT doc_id) + CASE WHEN length(term) >= {pii.OWN_LENGTH} AND list_contains(own, term) THEN {pii.OWN} ELSE 0 END >= {pii.SUPPORT}
), ne AS (
  SELECT entity, count(DISTINCT doc_id) AS n_e FROM names GROUP BY ALL
), nt AS (
  SELECT term, count(*) AS n_t FROM has GROUP BY ALL
), telling AS (
  SELECT DISTINCT term FROM te JOIN ne USING (entity) JOIN nt USING (term), total WHERE n_e < n AND ln(n_te * n / (n_t * n_e)) / ln(n / n_e) >= {pii.GENERALISE}
), added AS (
  SELECT doc_id, 4 AS kind, te - size AS a, te AS b FROM token JOIN telling USING (term)
), listed AS (
  SELECT doc_id, a, kind, b, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || a || ':' || b AS s FROM (SELECT doc_id, kind, a, b FROM b UNION ALL SELECT doc_id, kind, a, b FROM added)
), o AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
         coalesce(string_agg(s, ',' ORDER BY a, kind, b) FILTER (kind < 4), '') AS base, string_agg(s, ',' ORDER BY a, kind, b) AS spans, count(*) FILTER (kind = 4) AS n_term FROM listed GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term
FROM t LEFT JOIN o USING (doc_id)
"""
