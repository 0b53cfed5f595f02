"""Mutation with provenance: corrections, merges, deletions, retention, derived states.

Tables are append-only: a mutation is an event, and what holds now is the latest
event of each key. Nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import DAY_NS, NS, blank, live, need

UNDO_DAYS, AUDIO_DAYS, BATCH = 7, 30, 200
SNOOZE = (60 * NS, 7 * DAY_NS)


def latest(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event of each key; combines before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return events.groupBy(*keys).agg(row).select(*keys, "r.*")


def corrected_texts(turns: DataFrame, events: DataFrame) -> DataFrame:
    """``turns`` with the text of the last correction (segment_id, text, expected_text, at_ns, op_id) that was accepted.

    A correction is accepted only if the text it expected was the text: a stale
    one is refused. The chain is checked with one window: each event expects the
    text of the one before it, or the turn's own.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("segment_id").orderBy("at_ns", "op_id")
    rows = events.join(turns.select(F.col("id").alias("segment_id"), F.col("text").alias("__own")), "segment_id")
    before = F.coalesce(F.lag("text").over(w), F.col("__own"))
    ok = rows.withColumn("__ok", F.col("expected_text").isNull() | F.col("expected_text").eqNullSafe(before))
    # after a refused event nothing that builds on it holds
    bad = F.sum(F.when(F.col("__ok"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    good = ok.withColumn("__bad", bad).where("__bad = 0")
    now = latest(good.select("segment_id", "text", "at_ns", "op_id"), ["segment_id"], ["at_ns", "op_id"]).select(F.col("segment_id").alias("id"), F.col("text").alias("__new"), F.lit(True).alias("__hit"))
    return turns.join(now, "id", "left").withColumn("text", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("text"))).select(*turns.columns)


def merge_speakers(speakers: DataFrame, merges: DataFrame) -> DataFrame:
    """``speakers`` (id, merged_into, ...) after merges (from_id, into_id): tombstones point to the final voice, never to another tombstone."""
    from ..core import flatten_tombstones

    asked = merges.groupBy(F.col("from_id").alias("id")).agg(F.max("into_id").alias("__into"))
    rows = speakers.join(asked, "id", "left").withColumn("merged_into", F.coalesce("__into", "merged_into")).drop("__into")
    flat = flatten_tombstones(rows.select("id", "merged_into"))
    return rows.drop("merged_into").join(flat, "id").withColumn("merged_into", F.when(F.col("canonical_id") != F.col("id"), F.col("canonical_id"))).select(*speakers.columns)


def reassigned(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Turns with the voice of the last reassignment (segment_id, speaker_id, at_ns): split, reassign and undo are all such events."""
    now = latest(events, ["segment_id"], ["at_ns"]).select(F.col("segment_id").alias("id"), F.col("speaker_id").alias("__new"), F.lit(True).alias("__hit"))
    return turns.join(now, "id", "left").withColumn("speaker_id", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("speaker_id"))).select(*turns.columns)


def renamed(speakers: DataFrame, events: DataFrame) -> DataFrame:
    """Speakers with the last name given (id, display_name, named_at)."""
    now = latest(events, ["id"], ["named_at"]).select("id", F.col("display_name").alias("__name"), F.col("named_at").alias("__at"), F.lit(True).alias("__hit"))
    hit = F.col("__hit")
    return speakers.join(now, "id", "left").withColumn("display_name", F.when(hit, F.col("__name")).otherwise(F.col("display_name"))).withColumn("named_at", F.when(hit, F.col("__at")).otherwise(F.col("named_at"))).select(*speakers.columns)


def soft_deletes(turns: DataFrame, predicate: Column, now_ns: int, confirm_everything: bool = False) -> DataFrame:
    """Deletion events (segment_id, deleted_at, batch) for what a predicate hits; to hit everything must be confirmed."""
    hit = live(turns).where(predicate)
    if not confirm_everything:
        need(not live(turns).where(~F.coalesce(predicate, F.lit(False))).isEmpty() or hit.isEmpty(), "this would delete everything; confirm it", "refused")
    batch = F.floor(F.monotonically_increasing_id() / BATCH)
    return hit.select(F.col("id").alias("segment_id"), F.lit(now_ns).alias("deleted_at"), batch.alias("batch"))


def with_deletions(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Turns with deletions (segment_id, deleted_at: null undoes, at_ns) applied."""
    now = latest(events, ["segment_id"], ["at_ns"]).select(F.col("segment_id").alias("id"), F.col("deleted_at").alias("__d"), F.lit(True).alias("__hit"))
    return turns.join(now, "id", "left").withColumn("deleted_at", F.when(F.col("__hit"), F.col("__d")).otherwise(F.col("deleted_at"))).select(*turns.columns)


def retention(turns: DataFrame, now_ns: int, undo_days: int = UNDO_DAYS, audio_days: int = AUDIO_DAYS) -> DataFrame:
    """Adds ``fate``: purge (deleted longer than the undo window), purge_empty (old, no words and no voice), forget_audio (old), keep.

    0 days switch a rule off.
    """
    undo = F.col("deleted_at") <= now_ns - undo_days * DAY_NS if undo_days > 0 else F.lit(False)
    old = F.col("t_end_ns") <= now_ns - audio_days * DAY_NS if audio_days > 0 else F.lit(False)
    empty = blank(F.col("text")) & F.col("speaker_id").isNull()
    fate = F.when(F.coalesce(undo, F.lit(False)), "purge").when(old & empty, "purge_empty").when(old & F.col("audio_path").isNotNull(), "forget_audio").otherwise("keep")
    return turns.withColumn("fate", fate)


def retention_report(fates: DataFrame) -> DataFrame:
    """purged_rows, purged_empty, aged_audio, kept, pruned_threads of what ``retention`` gives."""
    gone = F.col("fate").isin("purge", "purge_empty")
    counts = fates.agg(*(F.count_if(F.col("fate") == f).alias(n) for f, n in (("purge", "purged_rows"), ("purge_empty", "purged_empty"), ("forget_audio", "aged_audio"), ("keep", "kept"))))
    threads = fates.where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.count_if(~gone).alias("left")).agg(F.count_if(F.col("left") == 0).alias("pruned_threads"))
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(threads.withColumn("one", F.lit(1))), "one").drop("one")


def reconcile(turns: DataFrame, files: DataFrame, settled_before: int) -> DataFrame:
    """(path, state): orphan files (path, modified) old enough to have settled, and dangling rows whose file is gone."""
    known = turns.where("audio_path IS NOT NULL").select(F.col("audio_path").alias("path"))
    orphans = files.where(F.col("modified") < settled_before).join(known, "path", "left_anti").select("path", F.lit("orphan").alias("state"))
    return orphans.unionByName(known.join(files.select("path"), "path", "left_anti").select("path", F.lit("dangling").alias("state")))


def storage_usage(files: DataFrame) -> DataFrame:
    """kind, bytes, files of a listing (path, length): by the first folder."""
    return files.groupBy(F.element_at(F.split("path", "/"), 1).alias("kind")).agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))


def surviving(parents: DataFrame, bridge: DataFrame, turns: DataFrame, parent_id: str = "moment_id") -> DataFrame:
    """Moments that still have a source turn; the last one's purge takes the moment along."""
    alive = bridge.join(turns.select(F.col("id").alias("segment_id")), "segment_id", "left_semi").select(F.col(parent_id).alias("id")).distinct()
    return parents.join(alive, "id", "left_semi")


def review_revisions(events: DataFrame) -> DataFrame:
    """(segment_id, revision, pending) of a log of turn states (segment_id, at_ns, text, asr_confidence, lang_via, deleted_at).

    A row enters the queue when it first needs a look; each later change is a new revision.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("segment_id").orderBy("at_ns")
    state = F.struct("text", "asr_confidence", "lang_via", "deleted_at")
    needs = F.col("deleted_at").isNull() & ~blank(F.col("text")) & F.coalesce((F.col("asr_confidence") == "shaky") | (F.col("lang_via") == "mismatch"), F.lit(False))
    rows = events.withColumn("needs", needs).withColumn("changed", ~F.lag(state).over(w).eqNullSafe(state))
    rows = rows.withColumn("entered", F.max(F.col("needs").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1).where("entered AND changed")
    return rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias("revision"), F.max_by("needs", "at_ns").alias("pending"))


def states(events: DataFrame, key: str = "id") -> DataFrame:
    """(key, state, due_ns) of state events (key, at_ns, event, arg): open, done, dropped, reopened, snoozed.

    A snooze moves the due time by ``arg`` nanoseconds, held within a minute and a week.
    """
    last = latest(events.where("event <> 'snoozed'"), [key], ["at_ns"]).select(key, F.when(F.col("event") == "reopened", "open").otherwise(F.col("event")).alias("state"))
    held = F.least(F.lit(SNOOZE[1]), F.greatest(F.lit(SNOOZE[0]), F.col("arg")))
    snoozed = events.where("event = 'snoozed'").groupBy(key).agg(F.max_by(F.col("at_ns") + held, "at_ns").alias("due_ns"))
    return last.join(snoozed, key, "left")


def stale_vectors(turns: DataFrame, vectors: DataFrame, model_id: str) -> DataFrame:
    """(id, text) that a vector index lacks: worded, visible, without a vector of this model for this text.

    Recomputed as an anti-join on (id, text hash, model) instead of being kept up by triggers.
    """
    rows = live(turns).where(~blank(F.col("text"))).select("id", "text", F.xxhash64("text").alias("text_hash"))
    have = vectors.where(F.col("model_id") == model_id).select(F.col("segment_id").alias("id"), "text_hash")
    return rows.join(have, ["id", "text_hash"], "left_anti").select("id", "text")


def guarded_insert(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Vectors (segment_id, text, ...) whose text is still the turn's: others were made for words that changed meanwhile."""
    return rows.join(turns.select(F.col("id").alias("segment_id"), "text"), ["segment_id", "text"], "left_semi")
