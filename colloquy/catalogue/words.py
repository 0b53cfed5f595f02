"""Texts: search, relation, languages, promises, times, terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import retrieval
from ..functions import text as T
from ..operators import graph
from ..sources import instance_log, visits
from .base import query, r6, table

_WORDS = r"[\p{L}''’]+"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(rf"""WITH c AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM documents
), t AS (SELECT id, len(list_filter(w, lambda x: x = 'of')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b FROM c
), n AS (SELECT count(*) AS n, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM t
), h AS (SELECT id, round(a * ln(1 + n / da) + b * ln(1 + n / db), 9) AS score FROM t, n WHERE a > 0 AND b > 0)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank, count(*) OVER () AS total FROM h QUALIFY rank <= 50""")
def keyword_search(spark, sf):
    """Documents with both words, best first, and how many there are in all."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.keyword_search(d, "with of", 50)


@query(rf"""WITH s AS (SELECT item_id AS id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 4 AND strlen(x) <= 96 AND x NOT IN ({_list(retrieval.COMMON)})))) AS w FROM benchmark
), t AS (SELECT id, unnest(w) AS term FROM s), q AS (SELECT id, unnest(w[1:24]) AS term FROM s
), h AS (SELECT q.id, t.id AS other, count(*) AS m FROM q JOIN t USING (term) WHERE q.id <> t.id GROUP BY ALL
), k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY m DESC, other DESC) <= 200
), j AS (SELECT k.id, other, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) AS total FROM k JOIN s a ON a.id = k.id JOIN s b ON b.id = other
), c AS (SELECT id, other, shared::INT AS shared, shared / (total - shared) AS score FROM j WHERE shared >= 2)
SELECT id, other, shared, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other DESC)::INT AS place FROM c QUALIFY place <= 5""")
def related_jaccard(spark, sf):
    """Passages that share words, by Jaccard index."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.related(b).withColumn("score", r6("score"))


@query(rf"""WITH w AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM documents
), v AS (SELECT doc_id, t, len(w) AS n, len(list_filter(w, lambda x: x IN ({_list(T.GERMAN)}))) AS de, len(list_filter(w, lambda x: x IN ({_list(T.ENGLISH)}))) AS en FROM w)
SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN regexp_matches(t, '[äöüß]') OR de > en THEN 'de' WHEN en > de THEN 'en' ELSE 'unclear' END AS vote FROM v""")
def language_vote(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.language_vote(F.col("text")).alias("vote"))


@query(rf"""WITH l AS (SELECT doc_id, lower(text) AS t FROM documents
), h AS (SELECT doc_id, t, list_filter([CASE WHEN regexp_matches(t, '[ýčěřšůž]') THEN 'cs' END, CASE WHEN regexp_matches(t, '[ñ]') THEN 'es' END, CASE WHEN regexp_matches(t, '[ąćęłńśż]') THEN 'pl' END, CASE WHEN regexp_matches(t, '[ãõ]') THEN 'pt' END, CASE WHEN regexp_matches(t, '[ğış]') THEN 'tr' END], lambda x: x IS NOT NULL) AS k FROM l)
SELECT doc_id, CASE WHEN len(k) = 1 AND len(regexp_extract_all(t, '{_WORDS}')) >= 2 THEN k[1] END AS tag FROM h""")
def other_language(spark, sf):
    """Languages that a script or a letter gives away."""
    return table(spark, sf, "documents").select("doc_id", T.other_language(F.col("text")).alias("tag"))


_LINES = [
    (1, "yeah I'll send it to you tonight"), (2, "I will drop them in your DMs on Friday"), (3, "will you send me the link?"), (4, "I will probably just sleep after this"), (5, "Schick ich dir morgen um 18 Uhr"),
    (6, "we should do that next week"), (7, "ich mache das am Freitag"), (8, "I already sent it, I will not again"), (9, "versprochen, in 2 Stunden"), (10, ""), (11, "I'm gonna fix the shader tomorrow at 6"), (12, "guten Morgen zusammen"),
]
_VALUES = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in _LINES)


@query(f"""WITH l AS (SELECT id, lower(text) AS t FROM (VALUES {_VALUES}) v(id, text))
SELECT id::BIGINT AS id, t <> '' AND NOT suffix(t, '?') AND NOT regexp_matches(t, '{T.VETOES.replace("'", "''")}') AND regexp_matches(t, '{T.MODALS.replace("'", "''")}') AS promises FROM l""")
def promise_candidates(spark, sf):
    """Literal lines, as the driver's prose holds no promise."""
    return spark.createDataFrame(_LINES, "id long, text string").select("id", T.promises(F.col("text")).alias("promises"))


@query()
def time_references(spark, sf):
    """References to times in the same lines, resolved against a Thursday noon."""
    lines = spark.createDataFrame(_LINES, "id long, text string").withColumn("t_start_ns", F.lit(1_788_436_800_000_000_000))
    return graph.time_references(lines)


@query()
def commitments(spark, sf):
    """Promises with their due dates: two voices in the thread, so each is owed by one to the other."""
    lines = spark.createDataFrame(_LINES, "id long, text string").withColumns({"t_start_ns": F.lit(1_788_436_800_000_000_000), "thread_id": F.lit(1).cast("long"), "speaker_id": F.col("id") % 2})
    return graph.commitments(lines)


@query()
def notes_to_self(spark, sf):
    """Notes after a wake phrase, some a letter off, with their reminders."""
    rows = [(1, "Scribe, remember to send the link tomorrow at 10", "mic"), (2, "Scrib, merk dir: Schlüssel", "mic"), (3, "Scribe, remember.", "mic"), (4, "scribe note buy milk", "app"), (5, "remember the milk", "mic")]
    t = spark.createDataFrame(rows, "id long, text string, source_kind string").withColumn("t_start_ns", F.lit(1_788_436_800_000_000_000))
    return graph.notes(t)


@query("""SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+'))::INT AS n_words FROM documents""")
def split_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.split_words(F.col("text"))).alias("n_words"))


@query(rf"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '{_WORDS}'), lambda x: x NOT IN ({_list(T.FILLERS)})))::INT AS n FROM documents""")
def content_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.content_words(F.col("text"))).alias("n"))


@query("""SELECT item_id, regexp_matches(text, '[?？]$') OR regexp_extract(lower(text), '([\\p{L}\\p{N}_''’]+)', 1) IN ('what', 'who', 'whom', 'whose', 'when', 'where', 'why', 'how', 'which', 'was', 'wer', 'wen', 'wem', 'wo', 'wie', 'wann') AS asks FROM benchmark""")
def questions(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.is_question(F.col("text")).alias("asks"))


_LOG = [
    "2026.08.31 18:45:57 Debug      -  [Behaviour] Joining wrld_0a1b-2c:12345~region(eu)",
    "2026.08.31 18:46:00 Debug      -  [Behaviour] Entering Room: The Great Pug",
    "2026.08.31 18:46:10 Debug      -  [Behaviour] OnPlayerJoined Ada (usr_0123-ab)",
    "2026.08.31 18:50:00 Debug      -  [Behaviour] OnPlayerLeftRoom",
    "2026.08.31 18:51:00 Debug      -  [Behaviour] OnPlayerLeft Ada",
    "2026.08.31 19:00:00 Debug      -  [Behaviour] Joining wrld_ff:7",
    "2026.08.31 19:00:00 Debug      -  [Behaviour] Joining wrld_ff:7",
    "2026.13.31 19:00:00 Debug      -  [Behaviour] Joining wrld_bad:7",
    "nothing of the kind",
]


@query("""SELECT 'wrld_0a1b-2c' AS world_id, 'The Great Pug' AS world_name, '12345' AS instance_id, epoch_us(TIMESTAMP '2026-08-31 18:45:57') * 1000 AS t_start_ns, epoch_us(TIMESTAMP '2026-08-31 19:00:00') * 1000 AS t_end_ns
UNION ALL SELECT 'wrld_ff', NULL, '7', epoch_us(TIMESTAMP '2026-08-31 19:00:00') * 1000, NULL""")
def visits_from_log(spark, sf):
    """Visits of literal log lines: a repeated entry is one, a line without a time is none."""
    return visits(instance_log(spark.createDataFrame([(x,) for x in _LOG], "value string")))


@query("""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a b c d e f' ELSE 'a b c d e g' END AS live, 'a b x d e f' AS night FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS edits, round(1 - CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END / 6, 6) AS agreement FROM v""")
def word_agreement(spark, sf):
    """Word edits and agreement of two literal readings."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "a b c d e f").otherwise("a b c d e g").alias("live"), F.lit("a b x d e f").alias("night"))
    return d.select("doc_id", T.word_edits(T.split_words(F.col("live")), T.split_words(F.col("night"))).alias("edits"), r6(T.agreement(F.col("live"), F.col("night"))).alias("agreement"))


@query("""WITH t AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'User' WHEN 1 THEN 'World' ELSE 'Roster' END || (l_suppkey % 4) AS term, l_linenumber FROM lineitem)
SELECT l_orderkey, count(DISTINCT lower(term)) AS n FROM t GROUP BY ALL""")
def effective_terms(spark, sf):
    """Terms in order of priority, once each, per order."""
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.when(F.col("l_linenumber") % 3 == 0, "User").when(F.col("l_linenumber") % 3 == 1, "World").otherwise("Roster"), (F.col("l_suppkey") % 4).cast("string")).alias("term"))
    g = t.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "term"))), lambda x: x["term"]).alias("ts"))
    return g.select("l_orderkey", F.size(T.effective_terms(F.col("ts"), F.transform("ts", F.upper))).cast("long").alias("n"))
