"""Worked examples with exact numbers, and folds against second implementations."""

import random
from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy import core
from colloquy.functions import text as T
from colloquy.functions import timerefs as R
from colloquy.functions import vectors as V
from colloquy.operators import accuracy, graph, identity, joins, lifecycle, rollups, scans, sequences, talk, truth
from colloquy.plans.ask import parse

MS, S = 1_000_000, 1_000_000_000
TURN = "id long, thread_id long, t_start_ns long, t_end_ns long, speaker_id long, overlap_frac double"


def turns(spark, rows):
    """(thread, start ms, end ms, voice, overlap)"""
    return spark.createDataFrame([(i, th, a * MS, b * MS, v, o) for i, (th, a, b, v, o) in enumerate(rows)], TURN)


CONVERSATION = [
    (1, 0, 2_000, 1, 0.0), (1, 2_500, 4_000, 2, 0.0), (1, 4_500, 6_500, 1, 0.0), (1, 5_500, 7_500, 2, 0.4), (1, 10_000, 22_000, 1, 0.0),
    (1, 22_500, 30_500, 1, 0.0), (1, 32_500, 34_500, 2, 0.0), (1, 35_000, 36_000, None, 0.0), (1, 50_000, 51_000, 1, 0.0),
]


# ---- turn-taking ------------------------------------------------------------


def test_the_worked_conversation(spark):
    got = {r.speaker_id: r for r in talk.person_stats(turns(spark, CONVERSATION)).collect()}
    a, b = got[1], got[2]
    assert (a.turns, a.speech_ns, a.total_speech_ns, a.mean_turn_ns) == (5, 25_000 * MS, 30_500 * MS, 5_000 * MS)
    assert a.share == 25_000 / 30_500 and a.longest_monologue_ns == 20_500 * MS
    assert (a.interruptions_given, a.interruptions_received, a.median_latency_ms, a.span_ns) == (0, 1, 1500, 51_000 * MS)
    assert abs(a.turns_per_minute - 5 / (51 / 60)) < 1e-9
    assert (b.turns, b.speech_ns, b.mean_turn_ns, b.longest_monologue_ns) == (3, 5_500 * MS, 5_500 * MS // 3, 2_000 * MS)
    assert (b.interruptions_given, b.interruptions_received, b.median_latency_ms) == (1, 0, 1250)


@pytest.mark.parametrize("overlap,n", [(0.09, 0), (0.1, 1), (None, 0)])
def test_what_interrupts(spark, overlap, n):
    rows = [*CONVERSATION[:3], (1, 5_500, 7_500, 2, overlap)]
    assert talk.interruptions(turns(spark, rows), 2 * S).count() == n


def test_threads_are_apart_and_silence_belongs_to_nobody(spark):
    (r,) = talk.person_stats(turns(spark, [(1, 0, 10_000, 1, 0.0), (2, 10_000, 20_000, 1, 0.0)])).collect()
    assert r.longest_monologue_ns == 10_000 * MS and r.span_ns == 20_000 * MS
    (r,) = talk.person_stats(turns(spark, [(1, 0, 1_000, 1, 0.0), (1, 5_000, 6_000, None, 0.9), (1, 9_000, 10_000, 1, 0.0)])).collect()
    assert (r.share, r.longest_monologue_ns, r.median_latency_ms, r.interruptions_received) == (1.0, 10_000 * MS, None, 0)
    assert talk.person_stats(turns(spark, [])).count() == 0


def test_by_conversation(spark):
    rows = [(1, 0, 1_000, 1, 0.0), (1, 1_000, 3_000, 2, 0.0), (2, 10_000, 11_000, 2, 0.0), (3, 20_000, 24_000, 1, 0.0)]
    got = [(r.thread_id, r.share) for r in talk.by_conversation(turns(spark, rows)).where("speaker_id = 1").orderBy("place").collect()]
    assert got == [(3, 1.0), (1, 1_000 / 3_000)]


# ---- visibility -------------------------------------------------------------


def test_visibility(spark):
    t = spark.createDataFrame([(1, 5, None), (2, 6, None), (3, None, None), (4, 5, 9)], "id long, speaker_id long, deleted_at long")
    s = spark.createDataFrame([(5, 6), (6, None)], "id long, merged_into long")
    got = sorted((r.id, r.speaker_id) for r in core.resolve_speakers(core.live(t), s).collect())
    assert got == [(1, 6), (2, 6), (3, None)]
    text = spark.createDataFrame([(None,), ("",), (" 　 \t",), ("a",), ("​",)], "t string")
    assert [r.b for r in text.select(core.blank(F.col("t")).alias("b")).collect()] == [True, True, True, False, False]


def test_merges_never_chain(spark):
    s = spark.createDataFrame([(i, None, f"n{i}") for i in range(1, 7)], "id long, merged_into long, display_name string")
    m = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 4)], "from_id long, into_id long")
    got = {r.id: r.merged_into for r in lifecycle.merge_speakers(s, m).collect()}
    assert got == {1: 4, 2: 4, 3: 4, 4: None, 5: 4, 6: None}


# ---- threads, merging, voice activity ---------------------------------------


def script(rows):
    return [r["thread"] for r in sequences.place_turns([{"id": i, "t_start_ns": at * S, "t_end_ns": (at + 3) * S, "speaker_id": v} for i, (at, v) in enumerate(rows)], 20 * S)]


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(5 * k, v) for k, v in enumerate([7, 8, 9, 7, 8, 9])], [1] * 6),  # whoever joins before anybody has spoken twice
        ([(5 * k, v) for k, v in enumerate([7, 8, 7, 9, 9, 8])], [1, 1, 1, 2, 2, 1]),  # a stranger to a settled pair
        ([(0, 7), (4, 8), (40, 7)], [1, 1, 2]),
        ([(0, 7), (23, 7), (46, 8)], [1, 1, 2]),  # 20 seconds after the end is open still, and settled by then
        ([(0, 7), (5, 8), (10, 7), (12, 9), (16, None), (18, 7)], [1, 1, 1, 2, 2, 1]),
        ([(0, None), (4, 7), (8, None)], [1, 1, 1]),
        ([(5 * k, v) for k, v in enumerate([1, 2, 3, 4, 5, 5, 1])], [1, 1, 1, 1, 1, 1, 2]),  # four others have spoken since
        ([(5 * k, v) for k, v in enumerate([1, 2, 3, 4, 4, 1])], [1] * 6),  # three have
        ([], []),
    ],
)
def test_threads(rows, want):
    assert script(rows) == want


def test_threads_on_executors(spark):
    rng = random.Random(3)
    rows = []
    for session in range(4):
        at = 0
        for _ in range(60):
            at += rng.randint(1, 15)
            rows.append((len(rows), session, at * S, (at + 3) * S, rng.choice([None, 1, 2, 3, 4, 5])))
    df = spark.createDataFrame(rows, "id long, session_id long, t_start_ns long, t_end_ns long, speaker_id long").repartition(5)
    got = {r.id: r.thread for r in sequences.thread_turns(df, ["session_id"]).collect()}
    for session in range(4):
        own = [r for r in rows if r[1] == session]
        want = [x["thread"] for x in sequences.place_turns([dict(zip(("id", "s", "t_start_ns", "t_end_ns", "speaker_id"), r, strict=True)) for r in own], 20 * S)]
        assert [got[r[0]] for r in own] == want


def spans(*pairs):
    return [{"start": a - 1, "end": b + 1, "voiced_start": a, "voiced_end": b} for a, b in pairs]


def test_turn_merging():
    merge = lambda *p: [(r["voiced_start"], r["voiced_end"]) for r in sequences.merge_turns(spans(*p), 15, 100)]
    assert merge((5, 30), (45, 70)) == [(5, 70)]  # 15 apart
    assert merge((5, 30), (46, 70)) == [(5, 30), (46, 70)]
    assert merge((0, 50), (55, 100)) == [(0, 100)] and merge((0, 50), (55, 101)) == [(0, 50), (55, 101)]  # 100 at most
    assert merge((0, 80), (90, 120), (125, 130)) == [(0, 80), (90, 130)]
    assert merge((3, 9)) == [(3, 9)] and merge() == []


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 30)), max_size=30))
@settings(max_examples=60, deadline=None)
def test_merging_keeps_order_and_bounds(steps):
    at, rows = 0, []
    for gap, n in steps:
        at += gap
        rows.append((at, at + n))
        at += n
    out = list(sequences.merge_turns(spans(*rows), 15, 100))
    assert [r["voiced_start"] for r in out] == sorted(r["voiced_start"] for r in out)
    starts, ends = {a for a, _ in rows}, {b for _, b in rows}
    for r in out:
        assert r["voiced_start"] in starts and r["voiced_end"] in ends
        assert r["voiced_end"] - r["voiced_start"] <= max(100, max(b - a for a, b in rows))


def segment(*track, **limits):
    frames, at = [], 0
    for p, n in track:
        for _ in range(n):
            frames.append((at, 400, p))
            at += 400
    return list(sequences.VoiceRule(**limits).spans(frames))


def test_voice_activity():
    assert segment() == [] and segment((0.49, 100)) == []
    # voiced from 12,000 to 20,000, closed by the frame that ends at 28,000
    assert segment((0.2, 30), (0.5, 20), (0.1, 25)) == [{"start": 8_800, "end": 23_200, "voiced_start": 12_000, "voiced_end": 20_000}]
    assert segment((0.9, 9), (0.0, 30)) == [] and len(segment((0.9, 10), (0.0, 30))) == 1  # 4,000 samples at least
    assert [s["voiced_end"] for s in segment((0.9, 20), (0.0, 19), (0.9, 20), (0.0, 20), (0.9, 20))] == [23_600, 39_600]  # a pause of 7,600 is none
    cut = segment((0.9, 90), (0.0, 40), longest=16_000)
    assert [(s["voiced_start"], s["voiced_end"]) for s in cut] == [(0, 16_000), (16_000, 32_000), (32_000, 36_000)]
    assert segment((0.9, 50), longest=16_000)[-1]["end"] == 20_000  # there is no more sound to keep


def test_flaps():
    run = lambda *r: [(x["start_ms"], x["end_ms"], x["flaps"]) for x in sequences.flap_sessions([dict(zip(("at_ms", "event", "instance"), e, strict=True)) for e in r], 5_000)]
    assert run((0, "appear", "p1"), (1_000, "vanish", "p1"), (3_000, "appear", None), (9_000, "vanish", "p1")) == [(0, 9_000, 1)]
    assert run((0, "appear", "p1"), (1_000, "vanish", "p1"), (3_000, "appear", "p2")) == [(0, 1_000, 0), (3_000, None, 0)]
    assert run((0, "appear", None), (1_000, "vanish", None), (6_001, "appear", None)) == [(0, 1_000, 0), (6_001, None, 0)]


def test_spaced_cuts():
    rows = [{"at": a, "distance": d} for a, d in ((1.0, 0.9), (1.5, 0.95), (3.0, 0.85), (5.0, 0.99), (7.0, 0.82), (9.0, 0.5))]
    assert [(c["cut"], c["at"]) for c in sequences.spaced_cuts(rows, 1.0, 3)] == [(1, 1.5), (2, 3.0), (3, 5.0)]


def test_speaking_edges(spark):
    e = spark.createDataFrame([("a", 0, "start"), ("a", 500 * MS, "start"), ("a", 900 * MS, "stop"), ("b", 1_000 * MS, "start"), ("c", 5, "stop")], "user string, at_ns long, edge string")
    got = sorted((r.user, r.t_start_ns, r.t_end_ns, r.closed) for r in sequences.speaking_spans(e, ["user"]).collect())
    assert got == [("a", 0, 500 * MS, True), ("a", 500 * MS, 900 * MS, True), ("b", 1_000 * MS, 31_000 * MS, False)]


def test_folds_go_through_all_groups_of_a_task_in_one_stream(spark):
    """No call a group: so many groups cost their rows. Large numbers beside nulls stay whole, and groups go across batches."""
    big = 2**53 + 1
    rows = [(k, at, None if at == 1 else big + k) for k in range(3_000) for at in (2, 1, 0)] + [(-1, at, big) for at in range(25_000)] + [(None, 0, 7)]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    out = sequences.folded(df, ["k"], ["at"], lambda g: [{"n": len(g), "first": g[0]["v"], "last": g[-1]["v"], "sorted": [r["at"] for r in g] == sorted(r["at"] for r in g)}], "n bigint, first bigint, last bigint, sorted boolean")
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: tuple(r)[1:] for r in out.collect()}
    assert got == {k: (3, big + k, big + k, True) for k in range(3_000)} | {-1: (25_000, big, big, True), None: (1, 7, 7, True)}


@pytest.mark.parametrize("meetings", [1, 40, 10**6])
def test_copresence_counts_pairs_by_blocks_of_voices(spark, meetings):
    """Whatever the number of blocks; sums are exact beyond doubles; no pair is shuffled."""
    rng = random.Random(meetings)
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, *"abcdefgh"]), 0, rng.choice([-5, 3, 2**55 + 1])) for _ in range(90)] + [(50, "alone", 0, 9), (51, "x", 0, 2), (51, "y", 5, 5)]
    out = joins.copresence(spark.createDataFrame(rows, "thread_id long, speaker_id string, t_start_ns long, t_end_ns long"), meetings=meetings)
    said = {}
    for th, v, a, b in rows:
        if th is not None and v is not None:
            said[th, v] = said.get((th, v), 0) + max(0, b - a)
    want = {}
    for th, v in said:
        for th2, o in said:
            if th == th2 and v != o:
                n, ns = want.get((v, o), (0, 0))
                want[v, o] = (n + 1, ns + said[th2, o])
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert {(r.speaker_id, r.other_id): (r.threads, r.weight_ns) for r in got} == want and len(got) == len(want)


def written(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_copresence_shuffles_speech_to_few_tasks(spark):
    """The number of pairs counted at a time says nothing about how often a row is shuffled."""
    rows = spark.range(4 * 600).selectExpr("id % 4 AS thread_id", "id div 4 AS speaker_id", "0L AS t_start_ns", "xxhash64(id) & 1099511627775 AS t_end_ns")
    before = written(spark)
    out = joins.copresence(rows, meetings=500)
    n, threads = out.selectExpr("count(*)", "sum(threads)").first()
    assert (n, threads) == (600 * 599, 4 * 600 * 599)
    assert written(spark) - before < 4 * 600 * 150


@pytest.mark.parametrize("meetings", [3, 10**6])
@pytest.mark.parametrize("voices,per_thread,dense", [(400, 3, False), (30, 20, True)])
def test_copresence_pieces(voices, per_thread, dense, meetings, monkeypatch):
    """By matrices where threads are full, from the meetings where they are not; the same pairs, exact beyond doubles."""
    import pyarrow as pa

    rng = random.Random(voices + meetings)
    said = {(th, v): rng.choice([None, 0, 3, 2**55 + 1]) for th in range(300 if not dense else 9) for v in rng.sample(range(voices), per_thread)}
    monkeypatch.delattr(joins, "_sparse" if dense else "_dense")
    for alone in (True, False):
        packs = {}
        for (th, v), ns in said.items():
            packs.setdefault((th, not alone and v % 2 == 1), []).append((f"v{v}", ns))
        batch = pa.RecordBatch.from_pylist([{"tile": 0, "alone": alone, "other": o, "thread": th, "voice": [v for v, _ in m], "ns": [ns for _, ns in m]} for (th, o), m in packs.items()])
        got = [tuple(r.values()) for piece in joins._met([batch], meetings) for r in piece.to_pylist()]
        want = {}
        for th, v in said:
            for o in range(voices):
                if o != v and (th, o) in said and (alone or (o - v) % 2):
                    n, ns = want.get((f"v{v}", f"v{o}"), (0, 0))
                    want[f"v{v}", f"v{o}"] = (n + 1, ns + (said[th, o] or 0))
        assert len(got) == len(want) and {g[:2]: g[2:] for g in got} == want


# ---- truth ------------------------------------------------------------------


def cover(spark, rows, a=0, b=1000, width=300):
    t = spark.createDataFrame([(1, a * MS, b * MS)], "id long, t_start_ns long, t_end_ns long")
    s = spark.createDataFrame([(u, u, x * MS, y * MS) for u, x, y in rows], "user_id string, name string, s_start long, s_end long")
    cut = truth.clipped(t, s, width * MS)
    c = {r.user_id: r.frac for r in truth.coverage(cut).collect()}
    f = [r.frac for r in truth.simultaneous(cut).collect()]
    return c, (f or [0.0])[0]


@pytest.mark.parametrize(
    "rows,want,at_once",
    [
        ([("a", -1000, 2000)], {"a": 1.0}, 0.0),
        ([("a", 250, 750)], {"a": 0.5}, 0.0),
        ([("a", 2000, 3000)], {}, 0.0),
        ([("a", 0, 400), ("a", 200, 500), ("a", 900, 1000)], {"a": 0.6}, 0.0),
        ([("a", 0, 500), ("b", 500, 1000)], {"a": 0.5, "b": 0.5}, 0.0),
        ([("a", 0, 1000), ("b", -500, 1500)], {"a": 1.0, "b": 1.0}, 1.0),
        ([("a", 0, 500), ("b", 0, 500), ("c", 0, 500)], {"a": 0.5, "b": 0.5, "c": 0.5}, 0.5),
        ([("a", 0, 200), ("a", 400, 1000), ("b", 100, 500)], {"a": 0.8, "b": 0.4}, 0.2),
        ([("a", 0, 800), ("a", 700, 950), ("b", 300, 600), ("c", 550, 900)], {"a": 0.95, "b": 0.3, "c": 0.35}, 0.6),
    ],
)
def test_coverage_and_simultaneity(spark, rows, want, at_once):
    c, f = cover(spark, rows)
    assert c == pytest.approx(want) and f == pytest.approx(at_once)


@pytest.mark.parametrize("seed", [1, 2])
def test_truth_over_time_groups_is_that_of_pairs(spark, seed):
    """Turns of very different lengths, turns that share an id, empty ones, spans that touch, repeat, or begin together, and ties of names; no pair of a turn and a span is dealt out."""
    rng = random.Random(seed)
    turn = [(n if n % 10 else 0, at, at + rng.choice([0, 1, 7, 50, 50, 51, 300, 4_000])) for n in range(120) for at in [rng.randrange(-500, 5_000)]]
    span = [(rng.choice("abc"), rng.choice("xyz"), at, at + rng.choice([0, 5, 50, 400])) for _ in range(150) for at in [rng.randrange(-600, 5_400)]] + [("d", "late", 5_000, 9_000), ("d", "early", 4_000, 9_000)]
    t = spark.createDataFrame(turn, "id long, t_start_ns long, t_end_ns long")
    s = spark.createDataFrame(span, "user_id string, name string, s_start long, s_end long")
    length, sound, names = {}, {}, {}
    for i, a, b in turn:
        if a < b:
            length[i] = max(length.get(i, 0), b - a)
            for u, n, lo, hi in span:
                if lo < b and a < hi and lo < hi:
                    sound.setdefault((i, u), set()).update(range(max(a, lo), min(b, hi)))
                    names[i, u] = max(names.get((i, u), (lo, n)), (lo, n))
    want = {k: (names[k][1], pytest.approx(len(x) / length[k[0]])) for k, x in sound.items()}
    out = truth.covered(t, s, 50)
    assert {(r.id, r.user_id): (r.name, r.frac) for r in out.collect()} == want
    assert {(r.id, r.user_id): (r.name, r.frac) for r in truth.coverage(truth.clipped(t, s, 50)).collect()} == want
    per = {}
    for i in {i for i, _ in sound}:
        all_ = {u: x for (j, u), x in sound.items() if j == i}
        there = {u: len(x) / length[i] for u, x in all_.items() if len(x) / length[i] >= 0.2}
        met = [at for x in all_.values() for at in x]
        per[i] = (len(there), max(there, default=None), max(there.values(), default=None), sum(met.count(at) > 1 for at in set(met)) / length[i])
    got = truth.summed(t, s, 50)
    assert {r.id: (r.n, r.u, r.f if r.n else None, r.at_once) for r in got.collect()} == {i: (n, u, f and pytest.approx(f), pytest.approx(o)) for i, (n, u, f, o) in per.items()}
    near = truth.reached(t, s, 10)
    key = lambda df: sorted((r.id, r.verdict, r.user_id or "", round(r.frac or 0, 9)) for r in df.collect())
    assert key(truth.judged(t, got, near)) == key(truth.verdicts(t, truth.coverage(truth.clipped(t, s, 50)), near))


def test_shares_are_rounded_as_in_sql(spark):
    """0.5104711925 times a thousand million is below the half in doubles, so SQL's engine rounds it down."""
    import duckdb

    from colloquy.catalogue.intervals import _rounded

    x = [k / 1_200_000_000 for k in (612_565_431, 3, 9, 302_848_107, 632_224_311, 1_200_000_000)]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 9)", [v]).fetchone()[0] for v in x]
    assert [r.y for r in spark.createDataFrame(list(enumerate(x)), "i int, x double").select("i", _rounded("x", 9).alias("y")).orderBy("i").collect()] == want


def test_an_interjection_and_an_empty_turn(spark):
    assert cover(spark, [("a", 0, 6000), ("b", 2000, 2500)], 0, 6000)[1] == pytest.approx(0.5 / 6)
    assert cover(spark, [("a", 0, 100)], 500, 500) == ({}, 0.0)


def test_verdicts(spark):
    t = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    c = spark.createDataFrame([(1, "a", 0.8), (2, "a", 0.79), (3, "a", 0.5), (3, "b", 0.2), (4, "a", 0.19), (6, "me", 0.9), (6, "a", 0.85), (7, "me", 0.9)], "id long, user_id string, frac double")
    near = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6, 7)], "id long")
    mute = spark.createDataFrame([(6, "me"), (7, "me")], "id long, user_id string")
    got = {r.id: (r.verdict, r.user_id) for r in truth.verdicts(t, c, near, mute).collect()}
    assert got == {1: ("single", "a"), 2: ("partial", "a"), 3: ("overlap", None), 4: ("nobody", None), 5: ("unknown", None), 6: ("single", "a"), 7: ("nobody", None)}


def test_linking(spark):
    rows = [("u", 1)] * 18 + [("u", 2)] * 2 + [("v", 2), ("v", 1)] + [("u", None)] * 5
    got = {r.user_id: r for r in truth.dominant_label(spark.createDataFrame(rows, "user_id string, speaker_id long")).collect()}
    assert (got["u"].speaker_id, got["u"].agreement, got["u"].n, got["u"].links) == (1, 0.9, 20, True)
    assert got["v"].speaker_id == 1 and not got["v"].links


@pytest.mark.parametrize("times,first", [([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 6), ([1, 1, 1, 1, 1, 1, 1, 2, 3, 4], 7), ([1, 2, 3, 4, 9, 9, 9, 9, 9, 9], 4), ([5, 5, 5], 3), ([1], 1)])
def test_chronological_split(spark, times, first):
    got = truth.chronological_split(spark.createDataFrame([(t,) for t in times], "t long"), "t").where("fit").count()
    assert got == first


def test_swaps(spark):
    n = lambda x: F.lit(x).cast("double")
    ask = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert ask(truth.swap_is_safe(n(0.9), n(0.8), n(0.9), n(0.81))) and not ask(truth.swap_is_safe(n(0.9), n(0.8), n(0.89), n(0.95)))
    assert ask(truth.swap_is_safe(n(None), n(0.0), n(0.5), n(0.3))) and not ask(truth.swap_is_safe(n(0.9), n(0.8), n(None), n(0.9)))
    assert ask(truth.improvement_is_material(n(0.50), n(10), n(0.52), n(10))) and ask(truth.improvement_is_material(n(0.5), n(10), n(0.5), n(8)))
    assert not ask(truth.improvement_is_material(n(0.50), n(0), n(0.51), n(0)))


# ---- joins ------------------------------------------------------------------


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(0, 30)), max_size=12), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(0, 30)), max_size=12), st.sampled_from([1, 7, 100]))
@settings(max_examples=8, deadline=None)
def test_interval_joins(spark, a, b, width):
    l = spark.createDataFrame([(i, k, s, s + n) for i, (k, s, n) in enumerate(a)], "i long, k long, ls long, le long")
    r = spark.createDataFrame([(i, k, s, s + n) for i, (k, s, n) in enumerate(b)], "j long, k long, rs long, re long")
    want = sorted((i, j) for i, (k, s, n) in enumerate(a) for j, (q, t, m) in enumerate(b) if k == q and s < t + m and t < s + n and n and m)
    got = sorted((x.i, x.j) for x in joins.overlap_join(l, r, ("ls", "le"), ("rs", "re"), width, ["k"]).collect())
    assert got == want
    semi = {x.i for x in joins.overlap_join(l, r, ("ls", "le"), ("rs", "re"), width, ["k"], "left_semi").collect()}
    assert semi == {i for i, _ in want}


def test_asof_join(spark):
    l = spark.createDataFrame([("a", 5), ("a", 10), ("a", 25), ("b", 1), (None, 7)], "k string, t long")
    r = spark.createDataFrame([("a", 5, 9, "x"), ("a", 10, None, "y"), ("a", 20, 22, "z"), (None, 1, None, "n")], "k string, s long, e long, v string")
    got = {(x.k, x.t): x.v for x in joins.asof_join(l, r, ["k"], "t", "s", "e").collect()}
    assert got == {("a", 5): "x", ("a", 10): "y", ("a", 25): None, ("b", 1): None, (None, 7): "n"}
    strict = {(x.k, x.t): x.v for x in joins.asof_join(l, r, ["k"], "t", "s", allow_equal=False).collect()}
    assert strict[("a", 5)] is None and strict[("a", 10)] == "x"


# ---- pages ------------------------------------------------------------------


@pytest.mark.parametrize("args,want", [({}, [8, 9, 10]), ({"to_ns": 8000}, [5, 6, 7]), ({"to_ns": 5000}, [2, 3, 4]), ({"to_ns": 2000}, [1]), ({"to_ns": 1000}, []), ({"from_ns": 3000}, [3, 4, 5]), ({"session": 1}, [1, 2, 3])])
def test_transcript_pages(spark, args, want):
    t = spark.createDataFrame([(i, 1, i * 1000) for i in range(1, 11)], "id long, session_id long, t_start_ns long")
    assert [r.id for r in scans.transcript_page(t, 3, **args).collect()] == want


def test_history_walk(spark):
    t = spark.createDataFrame([(i, i // 3, None) for i in range(1, 30)] + [(99, 2, 5)], "id long, t_start_ns long, deleted_at long")
    seen, cursor = [], None
    while True:
        page = scans.history_page(t, 0, 100, 7, cursor, 25).collect()
        seen += [r.id for r in page]
        if not page or not page[0].has_more:
            break
        cursor = (page[-1].t_start_ns, page[-1].id)
    assert seen == list(range(1, 26))
    with pytest.raises(core.OperatorError):
        scans.history_page(t, 5, 5)


# ---- identity ---------------------------------------------------------------


def test_the_ladder(spark):
    t = [(1, 0.10, 1.0, 5), (2, 0.11, 9.0, 5), (3, 0.0, 0.99, 5), (4, 0.0, 3.0, 5), (5, 0.0, 3.0, 5), (6, 0.0, 3.0, 1), (7, 0.0, 3.0, 5), (8, 0.0, 2.0, 2)]
    top = [(1, 1, 0.35, 0.0), (4, 1, 0.55, 0.06), (5, 2, 0.45, 0.2), (6, 1, 0.34, 0.5), (7, 1, 0.30, 0.5)]
    turns_ = spark.createDataFrame(t, "probe_id long, overlap_frac double, duration_s double, words long")
    ranked = spark.createDataFrame(top, "probe_id long, speaker_id long, score double, margin double")
    fitted = spark.createDataFrame([(2, 0.5, 0.0)], "speaker_id long, threshold double, margin double")
    got = {r.probe_id: (r.decision, r.speaker_id, r.enrol) for r in identity.decide(turns_, ranked, fitted=fitted).collect()}
    assert got == {
        1: ("matched", 1, False), 2: ("refused_overlapped", None, False), 3: ("refused_too_short", None, False), 4: ("matched", 1, True),
        5: ("declined", None, False), 6: ("too_slight", None, False), 7: ("mint", None, False), 8: ("mint", None, False),
    }


def test_split_in_two():
    rng = np.random.default_rng(0)
    a, b = np.eye(16)[0], np.eye(16)[1]
    x = np.concatenate([a + rng.normal(0, 0.05, (10, 16)), b + rng.normal(0, 0.05, (8, 16))])
    verdict, side = identity.split_in_two(x, np.zeros(18, bool))
    assert verdict == "split" and len(set(side[:10])) == 1 and len(set(side[10:])) == 1 and side[0] != side[-1]
    assert identity.split_in_two(x[:10], np.zeros(10, bool))[0] == "same_voice"
    golden = np.zeros(18, bool)
    golden[[0, 17]] = True
    assert identity.split_in_two(x, golden)[0] == "golden_conflict"
    assert identity.split_in_two(x[:3], golden[:3])[0] == "too_few"


def test_whitening(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 8)).astype(np.float32)
    x[:, 0] += 10 * rng.normal(0, 1, 400)
    x[:, 1] += 5 * rng.normal(0, 1, 400)
    mean, basis = V.whitening(x)
    assert abs(basis[0][0]) > 0.99 and abs(basis[1][1]) > 0.95 and abs(basis[0] @ basis[1]) < 1e-3
    assert V.whitening(x[:255]) is None
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:20])], "id long, vector array<float>")
    got = np.array([r.vector for r in V.whiten(df, (mean, basis)).orderBy("id").collect()])
    assert np.allclose((got * got).sum(1), 1, atol=1e-5) and np.abs(got @ basis.T).max() < 1e-4


def test_projection():
    rng = np.random.default_rng(2)
    labels = np.repeat(np.arange(4), 30)
    x = np.eye(4, 6)[labels] + rng.normal(0, [0.5, 0.05, 0.05, 0.05, 0.05, 2.0], (120, 6))
    mean, a = identity.fit_projection(x, labels)
    y = (x - mean) @ a.T
    spread = lambda z: np.mean([z[labels == k].var(0) for k in range(4)], 0)
    assert spread(y).max() / spread(y).min() < spread(x).max() / spread(x).min()
    with pytest.raises(ValueError):
        identity.fit_projection(x[:1], labels[:1])


# ---- words ------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_edits(spark):
    rng = random.Random(5)
    pairs = [(" ".join(rng.choices("ab cd ef gh".split(), k=rng.randint(0, 9))), " ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 9)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.word_edits(T.split_words(F.col("a")), T.split_words(F.col("b"))).alias("d"), T.wer(F.col("a"), F.col("b")).alias("w"))
    for r in df.collect():
        want = distance(r.a.split(), r.b.split())
        assert r.d == want and r.w == (want / len(r.b.split()) if r.b.split() else None)


def test_agreement_and_votes(spark):
    df = spark.createDataFrame([("Hello, world!", "HELLO world", 1.0), ("", "", 1.0), ("a b c d", "a x", 0.25), ("don't stop", "DON'T", 0.5)], "a string, b string, w double")
    assert all(abs(r.g - r.w) < 1e-9 for r in df.select("w", T.agreement(F.col("a"), F.col("b")).alias("g")).collect())
    rows = [("das ist nicht gut", "de"), ("that is not good", "en"), ("Straße", "de"), ("ok yeah", "unclear"), ("123 !", "empty"), ("was", "unclear"), (None, "empty")]
    got = spark.createDataFrame(rows, "t string, w string").select("w", T.language_vote(F.col("t")).alias("g")).collect()
    assert all(r.g == r.w for r in got)


def test_other_languages(spark):
    rows = [("これはテストです", "ja"), ("안녕하세요", "ko"), ("Привет, как дела", "ru"), ("Привіт, як справи їжак", "uk"), ("你好世界", "zh"), ("mañana voy", "es"), ("mañana", None), ("não señor", None), ("just english here", None)]
    got = spark.createDataFrame(rows, "t string, w string").select("w", T.other_language(F.col("t")).alias("g")).collect()
    assert all(r.g == r.w for r in got), got


def test_night_vote(spark):
    c = [("the cat sat on the mat", "a dog ran in that park", "the cat sat on the mat", "en", "replace"), ("the cat sat on the mat", "a dog ran", None, "en", "annotate"), ("", "a dog", "a dog", "en", "nothing"), ("the cat sat on the mat", "a dog ran in that park", "the cat sat on the mat", "de", "annotate")]
    df = spark.createDataFrame(c, "n string, l string, k string, g string, w string")
    got = df.select("w", T.night_vote(F.col("n"), F.col("l"), F.col("k"), 0.7, F.col("g"), F.lit(None).cast("string")).alias("v")).collect()
    assert all(r.v == r.w for r in got)


def test_lists_of_words(spark):
    (r,) = spark.createDataFrame([("the kubra sang", "The Kübra sang loudly, Kübra!")], "a string, b string").select(T.corrected_words(F.col("a"), F.col("b")).alias("x")).collect()
    assert r.x == ["Kübra", "loudly"]
    one = spark.range(1)
    lit = lambda *w: F.array(*(F.lit(x) for x in w))
    (r,) = one.select(T.effective_terms(lit("Kübra", " "), lit("kübra", "Ada"), lit("Bob"), cap=2).alias("a"), T.clean_terms(lit(" a  b ", "one two three four five")).alias("b"), T.normalised_languages(lit("EN", "de", "en")).alias("c"), T.normalised_languages(lit("any", "de")).alias("d"), T.unknown_languages(lit("xx", "de")).alias("e")).collect()
    assert (r.a, r.b, r.c, r.d, r.e) == (["Kübra", "Ada"], ["a b"], ["de", "en"], None, ["xx"])


def test_questions_and_grounding(spark):
    rows = [("was ist das", True), ("the world where we met", False), ("really?", True), ("何時？", True), ("これは何ですか", True), ("shader", False), ("Worüber reden wir", True)]
    got = spark.createDataFrame(rows, "t string, w boolean").select("t", "w", T.is_question(F.col("t")).alias("g")).collect()
    assert all(r.g == r.w for r in got), got
    g = spark.createDataFrame([("the shader broke", "shader code broke today", True), ("yes ok", "yes ok", False), ("東京駅前です", "東京駅前に", True)], "a string, b string, w boolean")
    assert all(r.x == r.w for r in g.select("w", T.grounded(F.col("a"), F.col("b")).alias("x")).collect())


# ---- times ------------------------------------------------------------------


def at(y, m, d, h=0, mi=0):
    return int(datetime(y, m, d, h, mi, tzinfo=timezone.utc).timestamp()) * S


TUE = at(2027, 3, 9, 8, 45)


@pytest.mark.parametrize(
    "text,kind,when,raw",
    [
        ("das Treffen legen wir auf Donnerstag", "weekday", at(2027, 3, 11), "Donnerstag"),
        ("Dienstag passt mir", "weekday", at(2027, 3, 16), "Dienstag"),
        ("nächsten Samstag geht es los", "weekday", at(2027, 3, 13), "nächsten Samstag"),
        ("the raid is this Sunday", "weekday", at(2027, 3, 14), "this Sunday"),
        ("vielleicht Morgen Abend", "day", at(2027, 3, 10, 20), "Morgen Abend"),
        ("we play later today", "day", at(2027, 3, 9), "later today"),
        ("tomorrow morning works", "day", at(2027, 3, 10, 8), "tomorrow morning"),
        ("tonight then", "day", at(2027, 3, 9, 20), "tonight"),
        ("ÜBERMORGEN, versprochen", "day", at(2027, 3, 11), "ÜBERMORGEN"),
        ("in der nächsten Woche erst", "week", at(2027, 3, 15), "in der nächsten Woche"),
        ("see you on the weekend", "weekend", at(2027, 3, 13), "on the weekend"),
        ("back in 90 mins", "in", TUE + 5_400 * S, "in 90 mins"),
        ("in 2 weeks", "in", TUE + 14 * 86_400 * S, "in 2 weeks"),
        ("gegen 17:30 Uhr", "clock", at(2027, 3, 9, 17, 30), "gegen 17:30 Uhr"),
        ("um 7 Uhr", "clock", at(2027, 3, 9, 19), "um 7 Uhr"),
        ("at 8, as always", "clock", at(2027, 3, 9, 20), "at 8"),
        ("until 12 am", "clock", at(2027, 3, 10), "12 am"),
        ("call me 3 p.m.", "clock", at(2027, 3, 9, 15), "3 p.m."),
        ("around eleven", "clock", at(2027, 3, 9, 11), "around eleven"),
        ("five o'clock tea", "clock", at(2027, 3, 9, 17), "five o'clock"),
        ("13 Uhr 20", "clock", at(2027, 3, 9, 13, 20), "13 Uhr 20"),
    ],
)
def test_one_time_reference(text, kind, when, raw):
    assert R.extract(text, TUE) == [R.TimeRef(raw, when, kind)]


def test_time_references_together():
    assert [(r.kind, r.resolved_ns) for r in R.extract("Samstag gegen 21 Uhr", TUE)] == [("weekday", at(2027, 3, 13)), ("clock", at(2027, 3, 13, 21))]
    assert R.extract("Sunday at 4", TUE)[1].resolved_ns == at(2027, 3, 14, 4)
    assert [r.kind for r in R.extract("erst morgen, dann Montag, dann in 3 Tagen", TUE)] == ["day", "weekday", "in"]
    assert R.pick_due(R.extract("am Samstag um 20 Uhr", TUE), TUE).resolved_ns == at(2027, 3, 13, 20)
    assert R.pick_due(R.extract("heute", TUE), TUE) is None  # midnight is past
    assert R.reminder_due("übermorgen um neun, sonst am Wochenende", TUE) == at(2027, 3, 11, 9)
    assert R.reminder_due("nothing here", TUE) is None and R.reminder_due("in 5 minutes", TUE) == TUE + 300 * S
    (local,) = R.extract("tomorrow", TUE, "America/New_York")
    assert local.resolved_ns == at(2027, 3, 10, 5)


@pytest.mark.parametrize("text", [None, "", "guten Morgen zusammen", "I counted 31 of them", "um eine Ecke", "at 24", "7:75", "zwei davon nehme ich", "around the corner", "in Minuten", "weeknight"])
def test_no_time_reference(text):
    assert R.extract(text, TUE) == []


def test_promises(spark):
    yes = ["I'll bring the cables", "i will upload the recording on Sunday", "I'm going to write it down", "bring ich dir mit", "Ich baue die Bühne noch um"]
    no = ["I'll perhaps join", "will he come?", "let's say I will", "ich mache das vielleicht", None, "the hill", "I'll tell you what?", "gestern: ich hole es"]
    df = spark.createDataFrame([(t, t in yes) for t in yes + no], "t string, w boolean").select("t", "w", T.promises(F.col("t")).alias("g"))
    assert all(r.g == r.w for r in df.collect()), df.collect()


def test_commitments(spark):
    rows = [(1, 1, 7, TUE, "I'll bring them Thursday at 5pm"), (2, 1, 8, TUE, "fine"), (3, 2, 7, TUE, "I will carry it"), (4, 3, None, TUE, "I will"), (5, 3, 8, TUE, "I will"), (6, 3, 9, TUE, "x"), (7, 3, 7, TUE, "y")]
    got = {r.segment_id: r for r in graph.commitments(spark.createDataFrame(rows, "id long, thread_id long, speaker_id long, t_start_ns long, text string")).collect()}
    assert set(got) == {1, 5}
    assert (got[1].to, got[1].due_ns, got[1].due_kind, round(got[1].confidence, 2)) == (8, at(2027, 3, 11, 17), "clock", 0.40)
    assert got[5].to is None and round(got[5].confidence, 2) == 0.25


def test_notes():
    assert R.note("Scribe, remember to send the link") == "to send the link"
    assert R.note("Scrib, merk dir: Schlüssel") == "Schlüssel" and R.note("Scribe note: milk") == "milk"
    assert R.note("Scribe, remember.") is None and R.note("scribe not this") is None and R.note("remember the milk") is None
    assert R.note("Archive, note x", wake="archive") == "x"
    assert R.within_one("node", "note") and R.within_one("abc", "abcd") and not R.within_one("abc", "cba") and not R.within_one("a", "abc")


NOON = at(2027, 3, 9, 12)
NAMED = [(3, "Juniper"), (4, "Bo"), (5, "Juniper Vale")]


def midnight(n):
    return at(2027, 3, 9) + n * 86_400 * S


@pytest.mark.parametrize(
    "q,who,start,end,rest",
    [
        ("wann hat Juniper gestern den Avatar erwähnt?", 3, midnight(-1), midnight(0), "Avatar"),
        ("Junipers Idee letzte Woche", 3, midnight(-8), midnight(-1), "Idee"),
        ("who talked about Bo on Sunday", 4, midnight(-2), midnight(-1), ""),
        ("Dienstag, Garten", None, midnight(0), midnight(1), "Garten"),
        ("what did Juniper Vale say today", 5, midnight(0), midnight(1), ""),
        ("Juniper's map of the cave last night", 3, midnight(-1) + 18 * 3600 * S, midnight(0) + 6 * 3600 * S, "map cave"),
        ("tell me about the boss fight this month", None, at(2027, 3, 1), at(2027, 4, 1), "boss fight"),
        ("Junipar said what", 3, None, None, ""),
        ("Ba erzaehlte etwas", None, None, None, "Ba"),
        ("Bo und Junipar", 4, None, None, "Junipar"),
        ("auf Englisch über Musik", None, None, None, "Musik"),
        ("cave map", None, None, None, "cave map"),
        ("door code in the last hour", None, NOON - 3600 * S, NOON, "door code"),
        ("vorgestern und gestern", None, midnight(-2), midnight(-1), "gestern"),
        ("", None, None, None, ""),
    ],
)
def test_questions_taken_apart(q, who, start, end, rest):
    got = parse(q, NOON, NAMED)
    assert (got.speaker_id, got.from_ns, got.to_ns, got.query) == (who, start, end, rest)


def test_places_need_a_preposition():
    worlds = [("wrld_a", "Moss Hollow"), ("wrld_b", "The Quay"), ("wrld_c", "Quay")]
    got = parse("was sagt Bo in the Quay world", NOON, NAMED, worlds)
    assert (got.world_id, got.speaker_id, got.query) == ("wrld_b", 4, "")
    assert parse("in Moss Hollow mit Bo", NOON, NAMED, worlds).world_id == "wrld_a"
    assert parse("Moss Hollow", NOON, NAMED, worlds).world_id is None


def test_find_in_text(spark):
    assert T.literal_matches("Crème brûlée, creme", "CREME") == [(0, 5), (14, 19)]
    assert T.literal_matches("e\u0301te\u0301", "ete") == [(0, 5)] and T.literal_matches("abc", " ") == []
    df = spark.createDataFrame([("Straße",), (None,)], "t string").select(T.find_in_text(F.col("t"), "STRA").alias("m"))
    assert [[tuple(x) for x in r.m] for r in df.collect()] == [[(0, 4)], []]
    (r,) = spark.createDataFrame([("👩‍👩‍👧é", "")], "a string, b string").select(T.graphemes(F.col("a")).alias("a"), T.graphemes(F.col("b")).alias("b")).collect()
    assert (r.a, r.b) == (2, 0)


def test_unroute(spark):
    rows = [
        (False, "x", False, 3.0, "うん今日は", "no_prior"), (True, "Mm-hmm.", False, 3.0, "うん今日は", "revert"), (True, "das ist nicht gut", False, 3.0, "うん今日は", "revert"), (True, "blah foo zork", False, 0.5, "うん今日は", "revert"),
        (True, "blah foo zork", False, 3.0, "", "revert"), (True, "blah foo zork", False, 3.0, "うん今日は", "keep"), (True, "blah foo zork", True, 3.0, "うん今日は", "revert"), (True, "blah foo zork", False, 3.0, "んんんんんん", "revert"), (True, "", False, 3.0, "今日は良い天気", "keep"),
    ]
    df = spark.createDataFrame(rows, "p boolean, t string, d boolean, s double, o string, w string")
    got = df.select("w", T.unroute_verdict(F.col("p"), F.col("t"), F.col("d"), F.col("s"), F.col("o")).alias("v")).collect()
    assert [r.v for r in got] == [r.w for r in got]


# ---- the rest ---------------------------------------------------------------


def test_corrections_and_rates(spark):
    ops = [(1, "correct_text", '{"segment_id": 1, "text": "a b c d"}', 10), (2, "correct_text", '{"segment_id": 1, "text": "a b c x"}', 20), (3, "correct_text", "{bad", 30), (4, "correct_text", '{"segment_id": 2, "text": null}', 40), (5, "merge", '{"segment_id": 1, "text": "q"}', 50)]
    log = accuracy.correction_log(spark.createDataFrame(ops, "id long, op string, prior_state string, at_utc_ns long"))
    fixed = accuracy.corrections(log, spark.createDataFrame([(1, "a b y x")], "segment_id long, text string"))
    assert sorted((r.original, r.corrected) for r in fixed.collect()) == [("a b c d", "a b c x"), ("a b c x", "a b y x")]
    (r,) = accuracy.edit_rates(fixed).collect()
    assert (r.corrections, r.edit_rate, r.since_ns) == (2, 0.25, 10)
    gone = accuracy.corrections(log, spark.createDataFrame([], "segment_id long, text string"))
    assert accuracy.edit_rates(gone).first().corrections == 1


def test_stale_corrections_are_refused(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    e = spark.createDataFrame([(1, "a2", "a", 1, 1), (1, "a3", "a", 2, 2), (2, "b2", None, 1, 3)], "segment_id long, text string, expected_text string, at_ns long, op_id long")
    assert {r.id: r.text for r in lifecycle.corrected_texts(t, e).collect()} == {1: "a2", 2: "b2"}


def test_deleting_everything_needs_a_word(spark):
    t = spark.createDataFrame([(1, None), (2, None)], "id long, deleted_at long")
    with pytest.raises(core.OperatorError) as e:
        lifecycle.soft_deletes(t, F.lit(True), 5)
    assert e.value.kind == "refused"
    assert lifecycle.soft_deletes(t, F.lit(True), 5, True).count() == 2 and lifecycle.soft_deletes(t, F.col("id") == 1, 5).count() == 1


def test_quantiles_by_rank(spark):
    df = spark.createDataFrame([("k", float(v)) for v in [5, 1, 1, 9, 7, 3]], "k string, v double")
    (r,) = rollups.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    x = sorted([5, 1, 1, 9, 7, 3])
    assert (r.n, r.p50, r.p95) == (6, x[int(5 * 0.5 + 0.5)], x[int(5 * 0.95 + 0.5)])


def test_search_outcomes(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "item_id long, id long, rank int")
    items = spark.createDataFrame([(1, 11, 5), (2, 13, 6), (3, 14, None)], "item_id long, target_id long, target_thread long")
    threads = spark.createDataFrame([(10, 5), (11, 5), (12, 6)], "id long, thread_id long")
    o = accuracy.outcomes(ranked, items, threads)
    assert {r.item_id: (r.exact_rank, r.thread_rank) for r in o.collect()} == {1: (2, 1), 2: (None, 1), 3: (None, None)}
    (m,) = accuracy.search_metrics(o).collect()
    assert (m.n, m.recall5_exact, m.mrr_exact, m.mrr_thread) == (3, 1 / 3, 0.5 / 3, 2 / 3)


def test_gap_causes(spark):
    rows = [(True, 5, 0, 0, 0, "flap"), (False, 5, 0, 900, 9, "queue_overflow"), (None, 0, 2, 0, 9, "pipewire_xrun"), (None, None, None, 600, 9, "session_end"), (None, 0, 0, 100, 9, "scheduler_starvation"), (None, None, None, None, None, "unexplained")]
    df = spark.createDataFrame(rows, "f boolean, e long, x long, s long, t long, w string")
    got = df.select("w", rollups.classify_gap(*(F.col(c) for c in "fexst")).alias("g")).collect()
    assert all(r.g == r.w for r in got) and {r.g for r in got} == set(rollups.GAP_CAUSES)


def test_stamp_worlds_by_the_last_visit_that_is_on(spark):
    visits = spark.createDataFrame([("a", 0, 100), ("b", 20, 30), ("c", 150, None), ("d", 150, None), ("e", 200, 210), ("f", 60, 60), (None, 5, 90), ("g", None, 9)], "world_id string, t_start_ns long, t_end_ns long")
    at = {1: 0, 2: 25, 3: 30, 4: 99, 5: 100, 6: 150, 7: 205, 8: 210, 9: -1, 10: 5000, 11: None, 12: 60}
    threads = spark.createDataFrame([(i, t, None, i) for i, t in at.items()] + [(13, 25, "kept", 0), (2, 25, None, 2)], "id long, started_ns long, world_id string, __b long")
    # nested visits end, ends are exclusive, open ones stay on behind shorter ones, ties go to the greatest world
    want = {1: "a", 2: "b", 3: "a", 4: "a", 5: None, 6: "d", 7: "e", 8: "d", 9: None, 10: "d", 11: None, 12: "a", 13: "kept"}
    for bucket in (7, 1000):
        got = joins.stamp_worlds(threads, visits, bucket)
        assert got.columns == threads.columns
        rows = got.collect()
        assert len(rows) == 14 and {r.id: r.world_id for r in rows} == want
    assert joins.stamp_worlds(threads.limit(0), visits).count() == 0
    assert {r.world_id for r in joins.stamp_worlds(threads, visits.limit(0)).collect()} == {None, "kept"}


def test_worlds_page_lists_who_is_heard_and_what_of(spark):
    visits = spark.createDataFrame([("w", "Hall", 5), ("w", None, 9), ("x", "Quay", 1)], "world_id string, world_name string, t_start_ns long")
    threads = spark.createDataFrame([(1, "w", "boats"), (2, "w", "apples"), (3, "w", "boats"), (4, None, "no"), (5, "w", " ")], "id long, world_id string, topic string")
    turns = spark.createDataFrame([(1, 7, 0, 10), (2, 8, 0, 10), (3, 9, 0, 30), (4, 6, 0, 99), (5, None, 0, 99)], "thread_id long, speaker_id long, t_start_ns long, t_end_ns long")
    got = {r.world_id: (r.name, r.visits, r.last_ns, r.people, r.topics) for r in rollups.worlds_page(visits, threads, turns, 2, 2).collect()}
    assert got == {"w": ("Hall", 2, 9, [9, 7], ["boats", "apples"]), "x": ("Quay", 1, 1, [], [])}
