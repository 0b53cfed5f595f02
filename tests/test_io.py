"""Sources, sinks, models, retrieval, the archive's calls, streams."""

import base64
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import models, retrieval, sinks, sources
from colloquy import streaming as stream
from colloquy.core import OperatorError
from colloquy.plans.archive import Archive

S = 1_000_000_000


def test_ndjson_keeps_good_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"user": "a", "at": 1}\n{bad\n{"user": "b", "at": 2}\n')
    good, bad = sources.ndjson(spark, str(tmp_path), "user string, at long")
    assert sorted(r.user for r in good.collect()) == ["a", "b"] and [r.line for r in bad.collect()] == ["{bad"]


def test_roster_and_visits(spark):
    lines = [
        "2026.08.31 18:00:00 Debug      -  [Behaviour] Joining wrld_a-1:11~x", "2026.08.31 18:00:05 Debug      -  [Behaviour] Entering Room: Pug",
        "2026.08.31 18:01:00 Debug      -  [Behaviour] OnPlayerJoined Ada (usr_0a)", "2026.08.31 18:01:30 Debug      -  [Behaviour] OnPlayerJoined Ada (usr_0a)", "2026.08.31 18:02:00 Debug      -  [Behaviour] OnPlayerJoined Bob",
        "2026.08.31 18:03:00 Debug      -  [Behaviour] OnPlayerLeft Bob", "2026.08.31 18:10:00 Debug      -  [Behaviour] Joining wrld_b-2:12", "2026.08.31 18:20:00 Debug      -  [Behaviour] OnPlayerLeftRoom",
    ]
    log = sources.instance_log(spark.createDataFrame([(x,) for x in lines], "value string"), "Europe/Berlin")
    base = log.agg(F.min("t_ns")).first()[0]
    who = sorted((r.name, (r.joined_ns - base) // S, (r.left_ns - base) // S) for r in sources.roster(log).collect())
    assert who == [("Ada", 60, 600), ("Bob", 120, 180)]
    v = sources.visits(log).orderBy("t_start_ns").collect()
    assert [(r.world_id, r.world_name, r.instance_id, r.t_end_ns is None) for r in v] == [("wrld_a-1", "Pug", "11", False), ("wrld_b-2", None, "12", True)]


def test_audio_frames(spark):
    ok = base64.b64encode(bytes(320)).decode()
    rows = [("u", 16_000, 0, ok), (" ", 16_000, 0, ok), ("u", 4_000, 0, ok), ("u", 16_000, 0, "!!"), ("u", 16_000, 61 * S, ok), ("u", 8_000, 0, base64.b64encode(bytes(40_000)).decode())]
    good, bad = sources.audio_frames(spark.createDataFrame(rows, "user_id string, rate long, at_ns long, pcm string"), 0)
    assert [r.ms for r in good.collect()] == [10] and sorted(r.reason for r in bad.collect()) == ["audio", "clock", "no_user", "rate", "too_long"]


def test_sample_time(spark):
    (r,) = spark.range(1).select(sources.sample_time(F.lit(10**18), F.lit(16_000 * 10**9 + 1)).alias("t")).collect()
    assert r.t == 10**18 + 10**18 + 62_500


def test_wav_files(spark, tmp_path):
    pcm = struct.pack("<4h", 1, 2, 3, 4)
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, 8000, 32000, 4, 16)
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + len(pcm)) + b"WAVE" + head + struct.pack("<4sI", b"data", len(pcm)) + pcm)
    (tmp_path / "b.wav").write_bytes(b"not audio")
    got = {r.path.rsplit("/")[-1]: r for r in sources.wav_files(spark, str(tmp_path)).collect()}
    assert (got["a.wav"].rate, got["a.wav"].channels, bytes(got["a.wav"].pcm)) == (8000, 2, pcm) and got["b.wav"].pcm is None
    assert sources.downmix(np.array([1, 3, 5, 7, 9]), 2).tolist() == [2.0, 6.0]


def test_resampling_in_pieces_is_resampling():
    x = np.random.default_rng(0).normal(0, 1, 1000)
    for rate in (8_000, 44_100, 48_000, 16_000):
        whole = sources.Resampler(rate).push(x)
        r, parts, lo = sources.Resampler(rate), [], 0
        for n in (1, 7, 100, 3, 389, 500):
            parts.append(r.push(x[lo : lo + n]))
            lo += n
        assert np.allclose(np.concatenate(parts), whole, atol=1e-9)
        assert abs(len(whole) - 1000 * 16_000 / rate) <= 2


def test_duplicate_audio():
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, 48_000)
    b = np.concatenate([rng.normal(0, 1, 5_000), 0.3 * a + rng.normal(0, 0.03, 48_000)])
    assert sources.duplicate_audio(a, b)[0] and not sources.duplicate_audio(a, rng.normal(0, 1, 50_000))[0]


def segments(spark):
    rows = [
        (1, 1, 1, "app", 1, 0, 2 * S, "the shader broke again", None, "a.wav"), (2, 1, 1, "app", 2, 3 * S, 5 * S, "which shader was it", None, "b.wav"), (3, 1, 1, "app", None, 6 * S, 7 * S, "  ", None, None),
        (4, 2, 1, "mic", 1, 90_000 * S, 90_002 * S, "portal and shader", None, None), (5, 2, 1, "mic", 3, 90_003 * S, 90_004 * S, "deleted shader", 5, None),
    ]
    return spark.createDataFrame(rows, "id long, thread_id long, session_id long, source string, speaker_id long, t_start_ns long, t_end_ns long, text string, deleted_at long, audio_path string")


def test_export(spark, tmp_path):
    t = segments(spark)
    assert [(str(r.local_day), r.turns, r.conversations) for r in sinks.export_plan(t).orderBy("local_day").collect()] == [("1970-01-01", 3, 1), ("1970-01-02", 2, 1)]
    places = spark.createDataFrame([("Pug", 80_000 * S, None)], "world_name string, t_start_ns long, t_end_ns long")
    sinks.export_markdown(t, str(tmp_path / "md"), places=places)
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "md").rglob("local_day=1970-01-02/*.txt")))
    assert sinks.MARK in text and "Pug" in text and "**1** portal and shader" in text
    w = json.loads(sinks.wire_rows(t).where("id = 4").first().json)
    assert w["t_start_ns"] == str(90_000 * S) and w["t_start_ms"] == 90_000_000 and w["deleted_at"] is None


def test_backup(spark, tmp_path):
    t = {"segments": segments(spark), "few": spark.range(3)}
    path, key = str(tmp_path / "b"), b"k"
    sinks.backup(t, path, key, 24)
    assert sinks.verify_backup(spark, path, key) == [] and sinks.verify_backup(spark, path, b"x")
    with pytest.raises(OperatorError):
        sinks.restore(spark, path, key, str(tmp_path / "r"), paused=False)
    sinks.restore(spark, path, key, str(tmp_path / "r"), paused=True)
    assert spark.read.parquet(str(tmp_path / "r/few")).count() == 3
    spark.range(4).write.mode("overwrite").parquet(f"{path}/few")
    assert any("few" in x for x in sinks.verify_backup(spark, path, key))


def test_models(spark):
    t = segments(spark)
    emb = models.HashedEmbedder(16)
    out = models.apply_model(t, emb)
    assert out.where("error IS NULL AND size(vector) = 16").count() == 5

    class Broken:
        inputs, outputs, model_id = ["text"], "score double", "broken"

        def load(self):
            def run(b):
                raise RuntimeError("no")

            return run

    bad = models.apply_model(t, Broken()).collect()
    assert len(bad) == 5 and all(r.score is None and "RuntimeError" in r.error for r in bad)
    assert models.pending(t, out.where("id < 3"), emb.model_id).count() == 3


def archive(spark):
    t, emb = segments(spark), models.HashedEmbedder(32)
    vec = models.apply_model(t, emb).select(F.col("id").alias("segment_id"), "vector")
    speakers = spark.createDataFrame([(1, None, "Aspen"), (2, None, "Kira"), (3, 1, None)], "id long, merged_into long, display_name string")
    visits = spark.createDataFrame([("wrld_1", "The Great Pug", 0, None)], "world_id string, world_name string, t_start_ns long, t_end_ns long")
    return Archive({"segments": t.withColumn("world_id", F.lit("wrld_1")), "speakers": speakers, "visits": visits, "vectors": vec}, emb)


def test_archive(spark):
    a = archive(spark)
    hits = a.call("search", query="shader").collect()
    assert sorted(r.id for r in hits) == [1, 2, 4] and all(r.total == 3 and "shader" in r.snippet for r in hits)
    assert [r.id for r in a.call("search", query="shader", speaker=2).collect()] == [2]
    assert a.call("search", query="shader", world="nowhere").count() == 0 and a.call("search", query="shader", world="pug").count() == 3
    both = {r.id: r.via for r in a.call("search.semantic", query="portal shader").collect()}
    assert both[4] == "both" and both[1] == "semantic"
    got = a.call("search.ask", question="what did Kira say about the shader", now_ns=10**18).collect()
    assert [r.id for r in got] == [2]
    assert [r.id for r in a.call("segments.context", id=2, before=1, after=1).orderBy("place").collect()] == [1, 2, 3]
    assert a.call("transcript.page", limit=2).count() == 2 and a.call("person.edges", speaker=1).first().other_id == 2
    with pytest.raises(OperatorError) as e:
        a.call("nothing")
    assert e.value.kind == "not_found"
    a.embed = None
    with pytest.raises(OperatorError) as e:
        a.call("search.semantic", query="x")
    assert e.value.kind == "unavailable"
    assert a.call("search.ask", question="shader", now_ns=10**18).count() == 3


def test_fusion(spark):
    k = spark.createDataFrame([(1, 1), (2, 2), (1, 3)], "id long, rank int")
    s = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = retrieval.fuse(k, s).orderBy("place").collect()
    assert [(r.id, r.via) for r in got] == [(2, "both"), (1, "keyword"), (3, "semantic")]
    assert abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-12


def test_related(spark):
    rows = [(1, "shader rendering performance"), (2, "shader rendering optimization"), (3, "different conversation entirely"), (4, "this that with eine nicht")]
    m = spark.createDataFrame(rows, "id long, text string")
    got = [(r.id, r.other, r.shared) for r in retrieval.related(m).orderBy("id").collect()]
    assert got == [(1, 2, 2), (2, 1, 2)]
    assert [r.other for r in retrieval.related(m, ids=m.where("id = 2").select("id")).collect()] == [1]


def test_index_search_is_search(spark):
    d = segments(spark).select("id", "text")
    index = retrieval.inverted_index(d)
    want = [(r.id, r.score) for r in retrieval.keyword_search(d, "shader", 10).orderBy("rank").collect()]
    assert [(r.id, r.score) for r in retrieval.search_index(index, "shader", 5).collect()] == want
    assert retrieval.keyword_search(d, "!!", 10).count() == 0


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def drain(df, folder, feed=()):
    """Runs a stream over what is there, again after each feed, from one checkpoint: state goes on where it was."""
    for step in (None, *feed):
        if step:
            step()
        q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    return df.sparkSession.read.parquet(f"{folder}/out").collect()


def test_stream_merge_and_voice(spark, tmp_path):
    src = tmp_path / "spans"
    rows = [("k", a - 1, b + 1, a, b) for a, b in ((10, 20), (30, 40), (100, 110))]
    schema = "key string, start long, end long, voiced_start long, voiced_end long"
    spark.createDataFrame(rows[:1], schema).coalesce(1).write.mode("append").parquet(str(src))
    more = lambda r: lambda: spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(str(src))
    df = stream.merge_stream(spark.readStream.schema(schema).parquet(str(src)), 15, 1000, None)
    got = drain(df, tmp_path / "m", [more(rows[1:2]), more(rows[2:])])
    assert [(r.voiced_start, r.voiced_end) for r in got] == [(10, 40)]

    frames = [("k", i * 512, 512, 0.9 if 20 <= i < 52 else 0.0) for i in range(100)]
    fs = "key string, at long, length long, prob double"
    spark.createDataFrame(frames[:40], fs).coalesce(1).write.parquet(str(tmp_path / "f"))
    later = lambda: spark.createDataFrame(frames[40:], fs).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    got = drain(stream.voice_stream(spark.readStream.schema(fs).parquet(str(tmp_path / "f")), None), tmp_path / "v", [later])
    assert [(r.voiced_start, r.voiced_end) for r in got] == [(20 * 512, 52 * 512)]


def test_stream_windows_and_updates(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    got = run(stream.event_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "1 day"), "complete", "counts")
    want = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().collect()
    assert {(r.start, r.event_type): r.n for r in got} == {(r.w.start, r.event_type): r["count"] for r in want}
    v = "id long, revision long, text string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "late")], v).write.parquet(str(tmp_path / "v"))
    got = run(stream.latest_versions(spark.readStream.schema(v).parquet(str(tmp_path / "v"))), "update", "versions")
    assert {r.id: r.text for r in got} == {1: "late", 2: "b"}


def test_stream_spans(spark, tmp_path):
    s = "key string, at_ns long, edge string"
    spark.createDataFrame([("a", 0, "start"), ("a", 5, "start"), ("a", 9, "stop"), ("b", 1, "stop")], s).coalesce(1).write.parquet(str(tmp_path / "s"))
    got = drain(stream.span_stream(spark.readStream.schema(s).parquet(str(tmp_path / "s")), timeout=False), tmp_path / "x")
    assert sorted((r.key, r.t_start_ns, r.t_end_ns) for r in got) == [("a", 0, 5), ("a", 5, 9)]


def test_event_log(spark, tmp_path):
    log = stream.EventLog(str(tmp_path / "log"), keep=3)
    s = "topic string, ev string, data string, ephemeral boolean, at_ns long"
    log.publish(spark.createDataFrame([("t", "a", "1", False, 1), ("t", "b", "2", True, 2), ("u", "c", "3", False, 3)], s), 0)
    for _ in range(2):  # written again after a failure: the same numbers
        log.publish(spark.createDataFrame([("t", "d", "4", False, 4), ("t", "e", "5", False, 5)], s), 1)
    kind, rows = log.events_since(spark, 3)
    assert kind == "events" and [r.ev for r in rows.collect()] == ["d", "e"]
    assert log.events_since(spark, 0)[0] == "resync" and log.events_since(spark, 10**15)[0] == "resync"
    assert [r.ev for r in log.events_since(spark, 2, ["u"])[1].collect()] == ["c"]


def test_reminders_fire_once(spark, tmp_path):
    fire = stream.fire_reminders(str(tmp_path / "fired"))
    n = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "segment_id long, due_ns long, text string")
    fire(n.where("segment_id = 1"), 0)
    fire(n, 1)
    fire(n, 1)
    assert sorted((r.segment_id, r.batch) for r in spark.read.parquet(str(tmp_path / "fired")).collect()) == [(1, 0), (2, 1)]


def test_captions_and_intake(spark):
    s = spark.createDataFrame([(1, 1, "he"), (1, 2, "hello"), (2, 1, "wo")], "turn_id long, seq long, text string")
    f = spark.createDataFrame([(1, "Hello.")], "turn_id long, text string")
    assert {(r.turn_id, r.text, r.final) for r in stream.partial_captions(s, f).collect()} == {(1, "Hello.", True), (2, "wo", False)}
    q = spark.createDataFrame([("a", i, "audio") for i in range(5)] + [("a", 9, "control")], "source string, seq long, kind string")
    assert sorted(r.seq for r in stream.bounded_intake(q, 2).where("NOT dropped").collect()) == [3, 4, 9]
