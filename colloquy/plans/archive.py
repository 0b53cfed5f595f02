"""An archive's calls: each takes arguments as clients send them and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import retrieval
from ..core import OperatorError, live, need, resolve_speakers
from ..functions import vectors as V
from ..operators import accuracy, graph, joins, lifecycle, rollups, scans, talk
from .ask import nameable, parse


@dataclass
class Archive:
    """Tables by name (segments, speakers, sources, sessions, threads, visits, vectors, ...) and an optional query embedder."""

    tables: dict[str, DataFrame]
    embed: Callable[[str], list[float]] | None = None
    calls: dict[str, Callable] = field(init=False)

    def __post_init__(self) -> None:
        self.calls = {
            "search": self.search, "search.semantic": self.semantic, "search.ask": self.ask, "transcript.page": self.transcript, "history.page": self.history,
            "segments.context": self.context, "person.stats": self.person_stats, "person.worlds": self.person_worlds, "person.edges": self.person_edges, "thread.get": self.thread,
            "worlds.list": self.worlds, "graph.summary": self.graph_summary, "topics.list": self.topics, "commitments.extract": self.commitments, "notes.extract": self.notes,
            "accuracy.summary": self.accuracy, "review.list": self.review, "sources.matrix": self.matrix, "delete.preview": self.delete_preview, "gaps.health": self.gaps,
            "retention.report": self.retention, "saved.related": self.related,
        }

    def call(self, method: str, **params) -> DataFrame:
        need(method in self.calls, f"no such method: {method}", "not_found")
        return self.calls[method](**params)

    def table(self, name: str) -> DataFrame:
        need(name in self.tables, f"no table {name}", "unavailable")
        return self.tables[name]

    @property
    def turns(self) -> DataFrame:
        """Visible turns with their voices resolved: what every call reads."""
        rows = live(self.table("segments"))
        return resolve_speakers(rows, self.tables["speakers"]) if "speakers" in self.tables else rows

    def _admitted(self, speaker=None, session=None, source=None, from_ns=None, to_ns=None, world=None) -> DataFrame:
        rows = self.turns.where(scans.SegmentFilter(speaker, session, source, from_ns, to_ns).predicate())
        return rows if world is None else scans.in_worlds(rows, scans.world_facet(self.table("visits"), world))

    def search(self, query: str, limit: int = 50, **facets) -> DataFrame:
        """Turns that have every word, best first, with the number of all of them."""
        rows = self._admitted(**facets)
        hits = retrieval.keyword_search(rows, query, limit)
        return hits.join(rows, "id").withColumn("snippet", retrieval.snippet(F.col("text"), query)) if retrieval._query_words(query) else hits.join(rows, "id").withColumn("snippet", F.col("text"))

    def _semantic(self, query: str, limit: int, rows: DataFrame) -> DataFrame:
        vectors = self.table("vectors").join(rows.select(F.col("id").alias("segment_id")), "segment_id", "left_semi")
        asked = rows.sparkSession.createDataFrame([(0, self.embed(query))], "query_id long, vector array<double>")
        return V.search(asked, vectors.select(F.col("segment_id").alias("id"), "vector"), limit).select("id", "score", "rank")

    def semantic(self, query: str, limit: int = 50, **facets) -> DataFrame:
        """Both legs fused; without vectors it is an error."""
        need(self.embed is not None and "vectors" in self.tables, "no vectors", "unavailable")
        rows = self._admitted(**facets)
        near = self._semantic(query, limit, rows)
        fused = retrieval.fuse(retrieval.keyword_search(rows, query, limit).select("id", "rank"), near.select("id", "rank")).where(F.col("place") <= limit)
        return fused.join(near.select("id", F.col("score").alias("cosine")), "id", "left").join(rows, "id")

    def ask(self, question: str, now_ns: int, limit: int = 50, tz: str = "UTC", **visible) -> DataFrame:
        """What a question means, searched for; the controls that are set hold where it names nothing. Without vectors, by words alone."""
        named = [tuple(r) for r in nameable(self.tables["speakers"].select("id", "display_name"), question).collect()] if "speakers" in self.tables else []
        worlds = [tuple(r) for r in nameable(rollups.worlds_list(self.tables["visits"]).select("world_id", "name"), question).collect()] if "visits" in self.tables else []
        said = parse(question, now_ns, named, worlds, tz)
        facets = visible | {k: v for k, v in {"speaker": said.speaker_id, "from_ns": said.from_ns, "to_ns": said.to_ns, "world": said.world_id}.items() if v is not None}
        mode = said.mode(self.embed is not None and "vectors" in self.tables)
        if mode == "facets":
            return self._admitted(**facets).orderBy(F.col("t_start_ns").desc(), F.col("id").desc()).limit(limit)
        return self.semantic(said.query, limit, **facets) if mode == "hybrid" else self.search(said.query, limit, **facets)

    def transcript(self, limit: int = 200, **bounds) -> DataFrame:
        return scans.transcript_page(self.turns, limit, **bounds)

    def history(self, **params) -> DataFrame:
        return scans.history_page(self.turns, **params)

    def context(self, id: int, before: int = 3, after: int = 3) -> DataFrame:
        anchor = self.turns.where(F.col("id") == id).select("id")
        need(not anchor.isEmpty(), "no such turn", "not_found")
        return scans.context_windows(self.turns, anchor, before, after).orderBy("place")

    def person_stats(self, speaker: int, now_ns: int, days: int = 30) -> DataFrame:
        return talk.person_stats(talk.since(self.turns, now_ns, days, speaker)).where(F.col("speaker_id") == speaker)

    def person_worlds(self, speaker: int, limit: int = 8) -> DataFrame:
        return rollups.person_worlds(self.table("threads"), self.turns, self.table("visits"), limit).where(F.col("speaker_id") == speaker)

    def person_edges(self, speaker: int) -> DataFrame:
        return joins.copresence(self.turns).where(F.col("speaker_id") == speaker)

    def thread(self, id: int) -> DataFrame:
        return talk.shares(self.turns.where(F.col("thread_id") == id)).orderBy(F.col("speech_ns").desc(), "speaker_id")

    def worlds(self, limit: int = 50) -> DataFrame:
        return rollups.worlds_list(self.table("visits")).orderBy(F.col("last_ns").desc(), "world_id").limit(limit)

    def graph_summary(self) -> DataFrame:
        return rollups.graph_summary(self.table("threads"))

    def topics(self, limit: int = 50) -> DataFrame:
        return rollups.topic_list(self.table("threads")).orderBy(F.col("threads").desc(), "topic").limit(limit)

    def commitments(self, tz: str = "UTC") -> DataFrame:
        return graph.commitments(self.turns, tz)

    def notes(self, tz: str = "UTC") -> DataFrame:
        return graph.notes(self.turns, tz)

    def accuracy(self, key: str = "source") -> DataFrame:
        fixed = accuracy.corrections(accuracy.correction_log(self.table("operations")), self.turns.select(F.col("id").alias("segment_id"), "text"))
        faceted = fixed.join(self.turns.select(F.col("id").alias("segment_id"), key), "segment_id")
        return accuracy.evidence_order(accuracy.accuracy_summary(faceted, self.turns, key), key)

    def review(self, limit: int = 30) -> DataFrame:
        return scans.review_inbox(self.turns, self.tables.get("reviewed")).orderBy(F.col("id").desc()).limit(limit)

    def matrix(self) -> DataFrame:
        return rollups.speaker_source_matrix(self.turns)

    def delete_preview(self, **facets) -> DataFrame:
        return scans.delete_preview(self.turns, scans.SegmentFilter(**facets))

    def gaps(self) -> DataFrame:
        return rollups.gap_health(self.table("gaps"))

    def retention(self, now_ns: int) -> DataFrame:
        return lifecycle.retention_report(lifecycle.retention(self.table("segments"), now_ns))

    def related(self, id: int, limit: int = 5) -> DataFrame:
        if not 1 <= limit <= 10:
            raise OperatorError("params", "limit must be 1-10")
        moments = self.table("moments")
        return retrieval.related(moments, limit, ids=moments.where(F.col("id") == id).select("id"))
