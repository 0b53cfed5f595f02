"""Faceted scans, pages, contexts, previews."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import NS, blank, clamp, live, need

#: What a world facet resolves to if nothing matches: an id that no row has.
NO_WORLD = "wrld_none"


@dataclass(frozen=True)
class SegmentFilter:
    """A conjunction of facets; what is None is left out."""

    speaker: int | None = None
    session: int | None = None
    source: str | None = None
    from_ns: int | None = None
    to_ns: int | None = None
    worlds: tuple[str, ...] | None = None

    def predicate(self) -> Column:
        p = F.lit(True)
        for value, test in (
            (self.speaker, lambda v: F.col("speaker_id") == v),
            (self.session, lambda v: F.col("session_id") == v),
            (self.source, lambda v: F.col("source") == v),
            (self.from_ns, lambda v: F.col("t_start_ns") >= v),
            (self.to_ns, lambda v: F.col("t_start_ns") < v),
            (self.worlds, lambda v: F.col("world_id").isin(list(v))),
        ):
            if value is not None:
                p = test(value) if p is None else p & test(value)
        return p


def segment_filter(turns: DataFrame, facets: SegmentFilter) -> DataFrame:
    """Visible turns that all facets admit."""
    return live(turns).where(facets.predicate())


def world_facet(visits: DataFrame, text: str) -> DataFrame:
    """(world_id) that a typed world means: an id exactly, else any name that contains it, whatever its case.

    No match gives the impossible id, so that a filter by it is empty rather than absent.
    """
    need(bool(text.strip()), "a world must not be empty")
    if text.startswith("wrld_"):
        found = visits.where(F.col("world_id") == text)
    else:
        found = visits.where(F.contains(F.lower("world_name"), F.lit(text.strip().lower())))
    ids = found.select("world_id").distinct()
    none = visits.sparkSession.range(1).select(F.lit(NO_WORLD).alias("world_id")).join(ids.limit(1).select(F.lit(1).alias("x")), F.lit(True), "left_anti")
    return ids.unionByName(none)


def in_worlds(turns: DataFrame, worlds: DataFrame) -> DataFrame:
    return live(turns).join(worlds, "world_id", "left_semi")


def candidates(turns: DataFrame, facets: SegmentFilter | None, dead: DataFrame | None = None) -> DataFrame:
    """(id) a search may return: without facets all but the dead ones, else those admitted."""
    if facets is None:
        return turns.select("id") if dead is None else turns.select("id").join(dead.select("id"), "id", "left_anti")
    return segment_filter(turns, facets).select("id")


def transcript_page(turns: DataFrame, limit: int, from_ns: int | None = None, to_ns: int | None = None, session: int | None = None) -> DataFrame:
    """At most ``limit`` turns, ascending: the first from ``from_ns`` or of a session, else the newest (before ``to_ns``).

    Only a page leaves the sort: both forms are a bounded top-k.
    """
    rows = segment_filter(turns, SegmentFilter(session=session, from_ns=from_ns, to_ns=to_ns))
    newest = from_ns is None and session is None
    order = [F.col("t_start_ns").desc(), F.col("id").desc()] if newest else [F.col("t_start_ns"), F.col("id")]
    return rows.orderBy(*order).limit(clamp(limit, 200, 10_000)).orderBy("t_start_ns", "id")


def history_page(turns: DataFrame, from_ns: int, to_ns: int, limit: int = 100, after: tuple[int, int] | None = None, max_id: int | None = None) -> DataFrame:
    """A page of history with ``has_more``: rows after the cursor (time, id), up to the snapshot's greatest id, in order.

    The cursor of the next page is the last row's (t_start_ns, id), with the same ``max_id``.
    """
    need(from_ns < to_ns, "from must precede to")
    need(1 <= limit <= 200, "limit must be 1-200")
    rows = live(turns).where((F.col("t_start_ns") >= from_ns) & (F.col("t_start_ns") < to_ns))
    if max_id is not None:
        rows = rows.where(F.col("id") <= max_id)
    if after is not None:
        t, i = after
        rows = rows.where((F.col("t_start_ns") > t) | ((F.col("t_start_ns") == t) & (F.col("id") > i)))
    page = rows.orderBy("t_start_ns", "id").limit(limit + 1)
    # one row more than the page tells whether there is more; the window is over limit + 1 rows
    n = F.row_number().over(W.orderBy("t_start_ns", "id"))
    more = F.count(F.lit(1)).over(W.partitionBy()) > limit
    return page.withColumn("has_more", more).withColumn("__n", n).where(F.col("__n") <= limit).drop("__n")


def context_windows(turns: DataFrame, anchors: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(anchor_id, place, turn columns): visible turns around each anchor id, in its thread, else in its session.

    Works for any number of anchors at once: positions are numbered once a group
    and anchors join by (group, position range).
    """
    need(0 <= before <= 10 and 0 <= after <= 10, "before and after must be 0-10")
    group = F.coalesce(F.concat(F.lit("t"), F.col("thread_id").cast("string")), F.concat(F.lit("s"), F.col("session_id").cast("string")))
    rows = live(turns).withColumn("__g", group)
    rows = rows.withColumn("__n", F.row_number().over(W.partitionBy("__g").orderBy("t_start_ns", "id")))
    at = rows.join(anchors.select(F.col("id")), "id", "left_semi").select("__g", F.col("id").alias("anchor_id"), F.explode(F.sequence(F.col("__n") - before, F.col("__n") + after)).alias("__n"), F.col("__n").alias("__a"))
    return at.join(rows, ["__g", "__n"]).withColumn("place", (F.col("__n") - F.col("__a")).cast("int")).drop("__g", "__n", "__a")


def review_inbox(turns: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """id, reasons of turns that need a look: visible, worded, and shaky or of mismatched language.

    ``reviewed`` (id, reviewed_revision) hides a turn reviewed at its present ``revision``.
    """
    reasons = F.array_compact(F.array(F.when(F.col("asr_confidence") == "shaky", F.lit("shaky")), F.when(F.col("lang_via") == "mismatch", F.lit("mismatch"))))
    rows = live(turns).where(~blank(F.col("text"))).withColumn("reasons", reasons).where(F.size("reasons") > 0)
    if reviewed is not None:
        seen = reviewed.select("id", F.col("reviewed_revision").alias("revision"))
        rows = rows.join(seen, ["id", "revision"], "left_anti")
    return rows.select("id", *(["revision"] if "revision" in turns.columns else []), "reasons")


def speaker_samples(turns: DataFrame, limit: int = 3) -> DataFrame:
    """The best ``limit`` recordings of every voice: with a file, longest first in whole seconds, then best score, then id."""
    rows = live(turns).where("speaker_id IS NOT NULL AND audio_path IS NOT NULL")
    order = [F.floor((F.col("t_end_ns") - F.col("t_start_ns")) / NS).desc(), F.col("match_score").desc_nulls_last(), F.col("id")]
    return rows.withColumn("place", F.row_number().over(W.partitionBy("speaker_id").orderBy(*order))).where(F.col("place") <= clamp(limit, 3, 20))


def voice_window(turns: DataFrame, observations: DataFrame, source: str, from_ns: int, to_ns: int) -> DataFrame:
    """Turns of a source within at most 120 s, with those that were only observed as duplicates there; 64 rows at most."""
    need(from_ns < to_ns and to_ns - from_ns <= 120 * NS, "a voice window spans at most 120 s")
    inside = lambda df: df.where((F.col("t_start_ns") < to_ns) & (F.col("t_end_ns") > from_ns))
    own = inside(live(turns).where(F.col("source") == source)).select("id", "t_start_ns", "t_end_ns", F.lit(False).alias("duplicate"))
    seen = inside(observations.where(F.col("source") == source)).select(F.col("segment_id").alias("id"), "t_start_ns", "t_end_ns", F.lit(True).alias("duplicate"))
    return own.unionByName(seen).orderBy("t_start_ns", "id", "duplicate").limit(64)


def listing(df: DataFrame, state: str | None, limit: int | None, order: Sequence[Column], default: int = 50, most: int = 500) -> DataFrame:
    """A bounded list, of one state if given."""
    rows = df if state is None else df.where(F.col("state") == state)
    return rows.orderBy(*order).limit(clamp(limit, default, most))


def delete_preview(turns: DataFrame, facets: SegmentFilter) -> DataFrame:
    """n, bytes, is_everything of what a deletion would take."""
    hit = F.coalesce(facets.predicate(), F.lit(False))
    size = F.when(hit, F.col("bytes")) if "bytes" in turns.columns else F.lit(0)
    return live(turns).agg(F.count_if(hit).alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), (F.count_if(hit) == F.count(F.lit(1))).alias("is_everything"))


def separators(turns: DataFrame, tz: str = "UTC") -> DataFrame:
    """Adds new_day and new_thread: whether a row differs in local day or thread from the one before it (per session)."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.expr("t_start_ns div 1000")), tz))
    w = W.partitionBy("session_id").orderBy("t_start_ns", "id")
    rows = turns.withColumn("local_day", day)
    return rows.withColumn("new_day", ~F.lag("local_day").over(w).eqNullSafe(F.col("local_day"))).withColumn("new_thread", ~F.lag("thread_id").over(w).eqNullSafe(F.col("thread_id")) & F.lag("id").over(w).isNotNull())


def contiguous_moments(turns: DataFrame, moments: DataFrame) -> DataFrame:
    """(moment_id, n, contiguous): whether the turns of a moment (moment_id, segment_id) stand side by side in one session."""
    placed = live(turns).select(F.col("id").alias("segment_id"), "session_id", F.row_number().over(W.partitionBy("session_id").orderBy("t_start_ns", "id")).alias("n"))
    got = moments.join(placed, "segment_id").groupBy("moment_id").agg(F.count(F.lit(1)).alias("k"), (F.max("n") - F.min("n") + 1).alias("span"), F.countDistinct("session_id").alias("s"))
    asked = moments.groupBy("moment_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(got, "moment_id", "left").select("moment_id", "n", F.coalesce((F.col("k") == F.col("n")) & (F.col("span") == F.col("n")) & (F.col("s") == 1), F.lit(False)).alias("contiguous"))


def merged_unique(current: DataFrame, incoming: DataFrame, key: Column, order: Column) -> DataFrame:
    """Upsert: rows of both with one key (a collection's name without regard to case, say) become the newest."""
    both = current.unionByName(incoming)
    return both.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order.desc()))).where("__n = 1").drop("__n")
