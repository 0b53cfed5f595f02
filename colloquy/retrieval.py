"""Lexical, vector and hybrid retrieval over an archive of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.text import letter_words, words_in_common

RRF_K, DEPTH = 60.0, 50
# Words of four letters or more that are too common to recommend anything.
COMMON = (
    "this that with from have will your they them what when then there their about just like would could should been "
    "were also some into than very really because eine einen einer einem nicht dass aber auch noch schon oder sich wird "
    "sind haben dann dies über"
).split()


def inverted_index(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, length): to be written bucketed or partitioned by term and read by every search."""
    words = letter_words(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w"))
    return rows.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def keyword_search(docs: DataFrame, query: str, limit: int = DEPTH, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score, rank, total): texts that have every word of the query, literally; ``total`` counts all of them.

    The score is the sum over the words of tf * ln(1 + N / df), ties by id. Texts
    that lack a word are gone after the scan; what is summed is the hits.
    """
    terms = sorted({w for w in _query_words(query)})
    spark = docs.sparkSession
    schema = "id long, score double, rank int, total long"
    if not terms:
        return spark.createDataFrame([], schema)
    words = letter_words(F.col(text_col))
    counts = [_occurrences(F.col("w"), t).alias(f"tf{k}") for k, t in enumerate(terms)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), words.alias("w")).select("id", *counts)
    df = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms)))).withColumn("one", F.lit(1))
    hits = rows.where(" AND ".join(f"tf{k} > 0" for k in range(len(terms)))).withColumn("one", F.lit(1)).join(F.broadcast(df), "one")
    score = sum((F.col(f"tf{k}") * F.log(1 + F.col("n") / F.col(f"df{k}")) for k in range(len(terms))), F.lit(0.0))
    hits = hits.select("id", F.round(score, 9).alias("score"))
    total = hits.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1))
    page = hits.orderBy(F.col("score").desc(), "id").limit(limit)  # a bounded heap a task; only a page is numbered
    ranked = page.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "id"))).withColumn("one", F.lit(1))
    return ranked.join(F.broadcast(total), "one").select("id", "score", "rank", "total")


def _occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term)))


def _query_words(query: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}'’]+", query.lower())


def search_index(index: DataFrame, query: str, n_docs: int, limit: int = DEPTH) -> DataFrame:
    """``keyword_search`` over an inverted index: only the query's terms are read."""
    terms = sorted(set(_query_words(query)))
    hit = index.where(F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    per = hit.join(F.broadcast(df), "term").groupBy("id").agg(F.count(F.lit(1)).alias("found"), F.round(F.sum(F.col("tf") * F.log(1 + F.lit(float(n_docs)) / F.col("df"))), 9).alias("score"))
    return per.where(F.col("found") == len(terms)).select("id", "score").orderBy(F.col("score").desc(), "id").limit(limit)


def fuse(keyword: DataFrame, semantic: DataFrame, k: float = RRF_K, on: list[str] | None = None) -> DataFrame:
    """(on, id, via, score, keyword_rank, semantic_rank, place) of two ranked lists (on, id, rank).

    Score: the sum of 1 / (k + rank). An id that a list has twice keeps its first
    rank. Order: score, then the better rank, then id.
    """
    on = on or []
    one = lambda df, name: df.groupBy(*on, "id").agg(F.min("rank").alias(name))
    both = one(keyword, "keyword_rank").join(one(semantic, "semantic_rank"), [*on, "id"], "full")
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    via = F.when(F.col("semantic_rank").isNull(), "keyword").when(F.col("keyword_rank").isNull(), "semantic").otherwise("both")
    rows = both.withColumn("via", via).withColumn("score", part("keyword_rank") + part("semantic_rank"))
    w = W.partitionBy(*on).orderBy(F.round("score", 12).desc(), F.least("keyword_rank", "semantic_rank"), "id")
    return rows.withColumn("place", F.row_number().over(w)).select(*on, "id", "via", "score", "keyword_rank", "semantic_rank", "place")


def content_set(text: Column) -> Column:
    """Distinct runs of letters and digits, four or more (96 bytes at most), that are not too common."""
    listed = F.array(*(F.lit(w) for w in COMMON))
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 4) & (F.octet_length(w) <= 96) & ~F.array_contains(listed, w)))


def related(moments: DataFrame, limit: int = 5, query_words: int = 24, candidates: int = 200, id_col: str = "id", text_col: str = "text", ids: DataFrame | None = None) -> DataFrame:
    """(id, other, shared, score, place): for each moment those that share two words or more, by Jaccard index, ties to the later id.

    As in a search box, a moment asks with its first ``query_words`` words in order
    and looks at the ``candidates`` moments that have most of them. ``ids`` (id)
    limits who asks; candidates come from an inverted index on words, so the work
    is what the asked words' holders are, in one join.
    """
    sets = moments.select(F.col(id_col).cast("long").alias("id"), F.array_sort(content_set(F.col(text_col))).alias("words"))
    terms = sets.select("id", F.explode("words").alias("term"))
    asking = sets if ids is None else sets.join(ids.select(F.col("id")), "id", "left_semi")
    asked = asking.select("id", F.explode(F.slice("words", 1, query_words)).alias("term"))
    hits = asked.join(terms.select(F.col("id").alias("other"), "term"), "term").where("id <> other")
    per = hits.groupBy("id", "other").agg(F.count(F.lit(1)).alias("matches"))
    near = per.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy(F.col("matches").desc(), F.col("other").desc()))).where(F.col("k") <= candidates)
    both = near.join(sets, "id").join(sets.select(F.col("id").alias("other"), F.col("words").alias("w2")), "other")
    scored = both.withColumn("c", words_in_common(F.col("words"), F.col("w2"))).select("id", "other", "c.shared", "c.score").where("shared >= 2")
    w = W.partitionBy("id").orderBy(F.col("score").desc(), F.col("other").desc())
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def snippet(text: Column, query: str, around: int = 40) -> Column:
    """The text around the first of the query's words."""
    at = F.least(*(F.when(F.locate(w, F.lower(text)) > 0, F.locate(w, F.lower(text))) for w in _query_words(query)), F.lit(2**31 - 1))
    return F.when(at < 2**31 - 1, F.substring(text, F.greatest(F.lit(1), at - around), F.lit(2 * around)))
