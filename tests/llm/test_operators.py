import base64
import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe, chat, importance, jaccard, media, mixing, pii, quality_rules, queries, token_counts, toxicity
from colloquy.llm.common import Scratch
from colloquy.llm.components import components
from tests_paths import SF, SMALL


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_pii_base(which, request):
    df = request.getfixturevalue(which)
    want = []
    for i, t in rows_of(df):
        s = brute.spans(t) if (t or "").count("@") < 1000 and len(set(t or "x")) > 1 else []
        want.append((i, *(sum(x[1] == k for x in s) for k in range(4)), brute.sha(brute.listed(s))))
    got = pii.detect(df).collect()
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], want)


def test_pii_patterns(spark):
    texts = ["a@b.c%d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0255.9", "4111 1111-1111 1111 41111111111111111 4111111111111111 5", "+1 (667) 555-4827, +49 30 1234567 ++12 345678901", "é+1 667 555 48274111111111111111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "a.b@c-d.e..f @x.y z@q.r.", "12345678 4111111111111111", "1 4111111111111111", "4111111111111111  4111111111111111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.base_sha256 for r in pii.detect(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute.sha(brute.listed(brute.spans(t))), t


def planted(spark):
    """Names beside addresses, near and far; in one document and in many; words between many spans; other names for columns."""
    rng = np.random.default_rng(8)
    far = "words that all have " * 6
    texts = [f"Quorlix {far}mail zz@mail.example.com {far}QUORLIX" for _ in range(4)] + [f"{far}quorlix, Quorlixes", "\ufeffé\U0001f600 a.b@c.de\ufeff \U0001f600 x"]
    texts += [f"Anna Wexford ({far}) anna.wexford@firm{k}.org or +49 30 123456{k}" for k in range(2)] + [f"agent 4711x9 is 007 at 10.0.0.{k % 2} 1.2.3.4.5.6.7.8" for k in range(8)]
    texts += [" ".join(f"between{k % 7} u{k}@m{k % 5}.org" for k in range(400)) for _ in range(3)] + [None, "", "+1 667 555 4827x@y.zz"]
    texts += [" ".join(rng.choice([f"v{k}" for k in range(60)], 30)) for _ in range(150)]
    rows = [(i, t, "en", "s", 7, 1, 2, b"x", "e") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h long, id0 long, __spans binary, said string")


@pytest.mark.parametrize("which", ["docs", "planted"])
def test_pii_terms_and_sanitise(which, request, spark):
    df = planted(spark) if which == "planted" else request.getfixturevalue(which)
    rows = rows_of(df)
    telling = brute.pii_telling([t for _, t in rows])
    if which == "planted":
        assert {"quorlix", "wexford", "anna", "4711x9", "between3"} <= set(telling) and "v5" not in telling
    want = []
    for i, t in rows:
        terms = [(lo + a, 4, lo + b) for lo, p, _ in brute.pii_pieces(t or "") for a, b, w in brute.pii_words(p) if w in telling]
        want.append((i, brute.listed([*brute.spans(t or ""), *terms]), len(terms)))
    same([(r.doc_id, r.spans, r.n_term) for r in pii.detect(df).collect()], want)
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    expect = []
    for r in df.collect():
        new = brute.pii_sanitised(r.text, telling)
        touched = r.text is not None and (brute.spans(r.text) or new != r.text)
        expect.append(tuple((r.asDict() | {"text": new, "n_chars": len(new) if touched else r.n_chars}).values()))
    same(map(repr, map(tuple, out.collect())), map(repr, expect))


def test_pii_is_linear_in_the_spans_of_a_text(spark):
    import time

    def took(k):
        text = " ".join(f"word{i % 97} user{i}@mail{i % 50}.example.com" for i in range(k))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.time()
        assert pii.detect(df).first().n_email == k
        return time.time() - t

    took(10)
    assert took(20_000) - took(10) < 10


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_jaccard(which, request):
    df = request.getfixturevalue(which)
    rows = rows_of(df)
    comp = brute.components([(i, t) for i, t in rows if i is not None])
    got = jaccard.groups(df).collect()
    known = {(i, brute.sha(repr(sorted(brute.shingles(t))))) for i, t in rows if i is not None}
    assert known
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None], [(i, len(brute.shingles(t)), comp[i]) for i, t in rows if i is not None])
    nulls = sorted((r.n_shingles, str(r.component_id)) for r in got if r.doc_id is None)
    assert nulls == ([] if which == "docs" else [(1, "-5"), (2, "None")])


def test_jaccard_documents_with_several_texts(spark):
    """An id with two texts links what either is like; whole rows may repeat."""
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight nine", "only here and nowhere else at all")
    rows = [(1, a), (3, a), (3, b), (7, b), (9, c), (9, c), (12, c), (None, c), (20, "x"), (20, "y"), (21, "y"), (22, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard.groups(df).collect())
    assert got == Counter([(1, 1), (3, 1), (3, 1), (7, 1), (9, 9), (9, 9), (12, 9), (None, 9), (20, 20), (20, 20), (21, 20), (22, 22)])
    kept = Counter((r.doc_id, r.text) for r in jaccard.keep_one(df).collect())
    assert kept == Counter(r for r in rows if r[0] in (1, 9, 20, 22, None))


def test_jaccard_near_copies_and_passages(spark):
    """Many near copies, some linked only through others; documents that share a passage; the borders of 0.8."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(4000)]
    base = list(rng.choice(words, 150))
    passage = list(rng.choice(words, 60))
    rows, i = [], 0
    for _ in range(250):
        t = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 6)):
            t[k] = f"n{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(t)))
        i += 1
    for _ in range(200):
        t = list(rng.choice(words, rng.integers(20, 200)))
        rows.append((i, " ".join([*t[:10], *passage, *t[10:]])))
        i += 1
    chain = list(rng.choice(words, 104))
    for k in range(0, 60, 3):
        rows.append((i, " ".join([*chain[k:], *(f"c{j}" for j in range(k))])))
        i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute.components(rows)
    got = {r.doc_id: r.component_id for r in jaccard.groups(df).collect()}
    assert got == want
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == set(want.values())


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(1000 + k, 1001 + k) for k in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.comp for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in parent}


def mixed_oddly(spark):
    """A document twenty times in a small source, repeated null ids, ties, texts without words; names that the operator uses itself."""
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1000, n))
    rows = [(i, text(int(rng.integers(1, 300))), "a") for i in range(60)] + [(100, "one two three " * 40, "b")] * 20 + [(200 + i, text(100), "c") for i in range(30)]
    rows += [(None, "x y z", None)] * 5 + [(None, None, "a"), (7, "", "zz"), (8, " \n", "a"), (300, text(20_000), "d"), (301, text(64), "e")]
    rows = [(*r, 1, 2, "clash", 3, b"x") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, epochs long, doc string, copy long, words binary")


@pytest.mark.parametrize("which", ["docs", "odd", "mixed_oddly"])
def test_mixing(which, request, spark):
    df = mixed_oddly(spark) if which == "mixed_oddly" else request.getfixturevalue(which)
    rows = [(r.doc_id, r.source, len(brute.WORD.findall(r.text or ""))) for r in df.collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    target = brute.targets(sizes)
    mixed = mixing.mix(df)
    got = mixed.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n) for i, _, n in rows)
    source = {(i, n, sizes[s]): s for i, s, n in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size, r.source_size]
        assert r.taken <= 3 * r.size and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        taken[s] += r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(3)).collect()))
    # what the documents as mixed hold is what the table says
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    kept, whole = out.collect(), {}
    same([(r.doc_id, len(brute.WORD.findall(r.text))) for r in kept], [(r.doc_id, r.taken) for r in got if r.taken])
    for r in df.collect():
        whole.setdefault((r.doc_id, r.source), set()).update(brute.WORD.findall(r.text or ""))
    assert all(set(brute.WORD.findall(r.text)) <= whole[r.doc_id, r.source] and r.n_chars == len(r.text) for r in kept)
    assert which != "mixed_oddly" or all(tuple(r[4:]) == (2, "clash", 3, b"x") for r in kept)


@pytest.mark.parametrize("which", ["docs", "mixed_oddly"])
def test_mixing_per_document(which, request, spark):
    """Sizes, slots and parts hold what they should; ``taken`` of each document, added up in plain Python from them."""
    df = mixed_oddly(spark) if which == "mixed_oddly" else request.getfixturevalue(which)
    rows = mixing._numbered(mixing._sizes(df, "doc_id", "text", "source")).cache()
    due = Scratch(spark, "due").table(mixing.due(rows))
    sources = {r.source: r for r in due.collect()}
    slots, parts = mixing.slots(due, shard=64).collect(), mixing.parts(rows).collect()
    # each slot of the mix is drawn once; a source's slots are its blocks, each once an epoch
    every = len(slots)
    assert {(r.shard, r.place) for r in slots} == {(k // 64, k % 64) for k in range(every)} and every == sum(r.slots for r in sources.values())
    assert len({(r.source, r.epoch, r.b) for r in slots}) == every and all(0 <= r.b < sources[r.source].blocks and r.epoch < 3 for r in slots)
    shards = Counter((r.shard, r.source) for r in slots)
    if which == "docs":  # draws vary about what is expected, as draws without replacement do
        z = [(shards[h, s] - 64 * r.slots / every) / (64 * r.slots / every * (1 - r.slots / every)) ** 0.5 for h in range(every // 64) for s, r in sources.items() if r.slots]
        assert 0.8 < np.std(z) < 1.2
    # the parts of documents tile each source's stream, block by block
    stream = defaultdict(set)
    for r in parts:
        at = range(r.b * 64 + r.into, r.b * 64 + r.into + r.n)
        assert r.into + r.n <= 64 and not stream[r.source] & set(at)
        stream[r.source].update(at)
    assert all(stream[s] == set(range(r.source_size)) for s, r in sources.items())
    take = defaultdict(list)
    for r in slots:
        take[r.source, r.b].append(r.take)
    want = Counter()
    for r in parts:
        want[r.doc, r.copy] += sum(max(0, min(r.n, t - r.into)) for t in take[r.source, r.b])
    same([(r.doc_id, r.size, r.taken) for r in mixing.mix(df).collect()], [(None if r.doc.none else r.doc.i, r.size, want[r.doc, r.copy]) for r in rows.collect()])


def test_mixed_blocks(spark):
    df = mixed_oddly(spark)
    got = mixing.mixed_blocks(df).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += len(r.text.split())
    want = brute.targets({r.source: r.source_size for r in mixing.due(mixing._numbered(mixing._sizes(df, "doc_id", "text", "source"))).collect()})
    assert {s: round(t) for s, t in want.items() if t} == dict(taken) and len({(r.shard, r.place) for r in got}) == len(got)
    # a source of one document of 64 words is one block: its text, whole
    assert {r.text for r in got if r.source == "e"} == {r.text for r in df.where("source = 'e'").collect()}
    assert mixing.mixed_blocks(df.limit(0)).count() == 0


def test_mixing_small_sources(spark):
    """Sources of less than a block, of a block and a word, and of a few blocks, beside a large one: each comes to its target within a word."""
    sizes = {f"s{k:03d}": n for k, n in enumerate([1, 2, 10, 63, 64, 65, 100, 127, 128, 129, 300, 1000] * 6)} | {None: 65, "t": 10_000}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    want = brute.targets(sizes)
    for i, (s, n) in enumerate(sizes.items()):
        assert got[i].taken <= 3 * n and abs(got[i].taken - want[s]) <= 1, (s, n, got[i])
    # what the pipeline's stage takes is what the table says
    docs = df.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars")
    words = {r.doc_id: len(r.text.split()) for r in mixing.mixed_documents(docs).collect()}
    assert words == {i: r.taken for i, r in got.items() if r.taken}


def test_mixing_targets_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 400, "d": 7000, "é": 1, "z": 2}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute.targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mixing_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        df = mixing.permuted(spark.range(n), "p", "id", str(n), "3")
        back = mixing.permuted(df, "q", "p", str(n), "3", inverse=True).collect()
        assert sorted(r.p for r in back) == list(range(n)) and all(r.id == r.q for r in back)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_rules(which, request):
    df = request.getfixturevalue(which)
    host = [(r.doc_id, r.text, r.source) for r in df.collect()]
    rows = [(i, *brute.rules(t), s) for i, t, s in host]
    failed = lambda m: m[1] < 20 or 100 * m[5] > 30 * m[1]
    by = defaultdict(list)
    for m in rows:
        by[m[6]].append(failed(m))
    rates = [sum(x) / len(x) for x in by.values()]
    mean = sum(rates) / len(rates)
    var = sum((r - mean) ** 2 for r in rates) / len(rates)
    strength = max(1.0, min(1e6, mean * (1 - mean) / var - 1)) if var > 0 else 1e6
    ok = {h: (sum(x) + mean * strength) / (len(x) + strength) <= quality_rules.HOST_LIMIT for h, x in by.items()}
    want = [(*m[:6], failed(m), not failed(m) and ok[m[6]]) for m in rows]
    got = quality_rules.judge(df).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got], want)


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(i, "few", "bad") for i in range(90)] + [(100 + i, good, "bad") for i in range(10)] + [(1000 + 50 * h + i, good, f"h{h}") for h in range(9) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.judge(df).where("kept").collect()}
    assert kept == set(range(1000, 1450))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_media(which, request):
    df = request.getfixturevalue(which)
    want = []
    for i, t in rows_of(df):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64) or bytes(64)
        want.append((i, len(b), len(p), brute.sha(p), zlib.crc32(p[-64:])))
    got = media.digests(df).collect()
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], want)
    by = defaultdict(set)
    for r in got:
        by[r.payload_sha256, r.n_bytes].add((r.feature, r.media_sha256, r.media_bytes))
    assert all(len(x) == 1 for x in by.values())


def test_media_codecs():
    # G.711: known codes; each table is odd about zero
    assert media.MULAW[0xFF] == 0 and media.MULAW[0x80] == 32124 and media.MULAW[0x00] == -32124
    assert media.ALAW[0xD5] == 8 and media.ALAW[0x55] == -8 and media.ALAW[0xAA] == 32256
    rng = np.random.default_rng(2)
    blocks = rng.integers(0, 256, (50, 64), dtype=np.uint8)
    got = media.adpcm_decode(blocks)
    for row, out in zip(blocks.tolist(), got.tolist(), strict=True):
        value, index, want = int.from_bytes(bytes(row[:2]), "little", signed=True), min(row[2], 88), []
        want.append(value)
        for byte in row[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                size = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
                value = max(-32768, min(32767, value + (-size if nibble & 8 else size)))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
                want.append(value)
        assert out == want


def test_media_pcm(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in media.read_media(media.store_texts(df)).collect()}
    pcm = np.frombuffer(out[1].pcm, np.int16)
    assert len(pcm) == 128 and pcm[0] == media.MULAW[ord("a")] and pcm[2] == media.MULAW[ord("b")]
    assert bytes(out[1].payload) == b"abc" + bytes(61) and bytes(out[2].payload) == bytes(64)


def plain_feature(name, samples):
    """Twice the rate by the mean of neighbours; number, mean size, peak, sign changes."""
    out = []
    for k, v in enumerate(samples):
        out += [v, (v + samples[k + 1]) >> 1 if k + 1 < len(samples) else v]
    turns = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:], strict=False))
    return f"{name}:{len(out)}:{sum(map(abs, out)) // len(out)}:{max(map(abs, out))}:{turns}"


def plain_adpcm(block):
    value, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            size = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            value = max(-32768, min(32767, value + (-size if nibble & 8 else size)))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
            out.append(value)
    return out


def test_media_features(spark, docs):
    df = docs.where("n_chars < 800").select("doc_id", "text").limit(40).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 64)], "doc_id long, text string"))
    for r, t in [(r, dict(rows_of(df))[r.doc_id]) for r in media.digests(df).collect()]:
        b = (t or "").encode()
        b = b + bytes(-len(b) % 64) or bytes(64)
        adpcm = [v for k in range(0, len(b), 64) for v in plain_adpcm(b[k : k + 64])]
        assert r.feature == "|".join((plain_feature("adpcm", adpcm), plain_feature("alaw", [int(media.ALAW[c]) for c in b]), plain_feature("mulaw", [int(media.MULAW[c]) for c in b])))


def test_media_files_of_other_formats(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 130, dtype=np.uint8).tobytes()

    def file(tag, block, payload):
        raw = bytearray(media.wav(payload, tag))
        raw[32:34] = block.to_bytes(2, "little")
        return bytes(raw)

    files = [(1, file(6, 1, data)), (2, file(17, 36, data)), (3, file(7, 1, data[:5])), (4, None), (5, file(6, 1, b"")), (6, file(17, 36, data[:10]))]
    df = spark.createDataFrame(files, "id long, media binary")
    got = {r.id: r for r in media.store_pcm(df, f"{tmp_path}/pcm").collect()}
    pcm = lambda k: np.frombuffer(got[k].pcm, np.int16)[::2].tolist()
    assert pcm(1) == [int(media.ALAW[c]) for c in data] and pcm(3) == [int(media.MULAW[c]) for c in data[:5]]
    want = [v for k in (0, 36, 72) for v in plain_adpcm(data[k : k + 36])]
    assert pcm(2) == want and got[2].feature == plain_feature("adpcm", want)
    assert got[4].pcm is None and got[4].payload is None and got[4].feature == "" and got[5].pcm == b"" and got[5].feature == "alaw:0:0:0:0" and got[6].pcm == b""
    with pytest.raises(Exception, match="no decoder"):
        media.read_media(spark.createDataFrame([(1, media.wav(b"ab", 1))], "id long, media binary")).collect()


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.96
    # what carries insults is caught, what doesn't is left alone
    text = dict(rows_of(docs))
    insults = {"loser", "idiot", "pathetic", "scum", "worthless", "moron"}
    hit = [r.predicted for r in got if len(insults & set((text[r.doc_id] or "").lower().split())) >= 3]
    assert np.mean(hit) > 0.95
    clean = [r.predicted for r in got if truth.get(r.doc_id) == 0]
    assert np.mean(clean) < 0.01


def test_toxicity_learns_interactions():
    """Two terms that tell nothing alone and everything together: an additive model can't; pair terms do."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(3000):
        a, b = rng.random(2) < 0.3
        words = [f"f{k}" for k in rng.integers(0, 50, 8)] + ["insult"] * int(a) + ["group"] * int(b)
        of = toxicity._Buckets(12)
        rows.append((int(a and b), of.of(w.encode() for w in words).tobytes()))
    m = toxicity.train(rows, bits=12)
    of = toxicity._Buckets(12)
    p = lambda *w: m.score(m.places(of.of(x.encode() for x in w)))
    assert p("insult", "group") > 0.5 > max(p("insult"), p("group"), p())


def test_toxicity_learns_pairs_of_words_that_tell_nothing_alone():
    """A fifth of all documents is toxic, and a fifth of those with either word: only both together tell."""
    rng = np.random.default_rng(4)
    rows, of = [], toxicity._Buckets(16)
    for k in range(4000):
        toxic = k % 5 == 0
        said = ("insult", "group") if k % 25 == 0 else ("slur",) if toxic else ("insult",) if k % 25 in (1, 2, 3, 4) else ("group",) if k % 25 in (6, 7, 8, 9) else ()
        words = [f"f{x}" for x in rng.integers(0, 50, 8)] + list(said)
        rows.append((int(toxic), of.of(w.encode() for w in words).tobytes()))
    m = toxicity.train(rows, bits=16)
    p = lambda *w: m.score(m.places(of.of(x.encode() for x in w)))
    assert p("insult", "group") > 0.5 > max(p("insult"), p("group"), p())


def plain_score(model, text):
    """The machine's formula, term by term."""
    import regex
    import xxhash

    words = set(regex.findall(r"[a-z0-9\x80-\xff]+", (text or "").encode().lower().decode("latin-1")))
    forms = {f for w in words for f in (w, "^" + w[:4], "^" + w[:6])}
    active = model.active.tolist()
    hit = [k for k, b in enumerate(active) if b in {xxhash.xxh3_64_intdigest(f.encode("latin-1")) % (1 << model.bits) for f in forms}]
    z = model.w0 + sum(model.w[k] for k in hit) + sum(float(np.dot(model.v[i], model.v[j])) for x, i in enumerate(hit) for j in hit[:x])
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_scores_by_formula(docs, odd, spark):
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(model.active) > 5
    for df in (docs.where("n_chars < 2000"), odd):
        text = rows_of(df)
        got = toxicity.score(df, model).collect()
        same([(r.doc_id, round(r.score, 9), r.predicted) for r in got], [(i, round(p, 9), int(p >= 0.5)) for i, p in ((i, plain_score(model, t)) for i, t in text)])
        kept = toxicity.keep_clean(df, model)
        assert kept.columns == df.columns and kept.dtypes == df.dtypes
        same(map(repr, kept.collect()), [repr(r) for r in df.collect() if plain_score(model, r.text) < 0.5])
    assert toxicity.keep_clean(odd.limit(0), model).count() == 0 and toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_is_fitted_in_a_task(docs, spark, monkeypatch):
    """The driver gets the fitted model alone, not the rows: the fit's memory isn't the driver's."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    of = toxicity._Buckets(toxicity.BITS)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = [(r.toxic, of.of(toxicity.terms(texts[r.doc_id])).tobytes()) for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert 0 < len(rows) <= toxicity.SAMPLE
    want = toxicity.train(sorted(rows))
    here, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, **options: here.append(len(rows)) or train(rows, **options))
    got = toxicity.fit(docs, labels)
    assert not here and len(want.active) and all(np.array_equal(a, b) for a, b in zip(got.parts(), want.parts(), strict=True))


def test_toxicity_odd(odd, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, none)).collect()
    assert len(got) == odd.count() and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in got)
    some = spark.createDataFrame([(None, 1), (3, None), (3, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, some)).count() == odd.count()
    assert toxicity.score(odd, toxicity.fit(odd.limit(0), some)).count() == odd.count()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_bpe(which, request):
    import tiktoken

    df = request.getfixturevalue(which)
    path, pattern = queries.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows_of(df):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(brute.ids_bytes(ids)), brute.sha(t or "")))
    got = bpe.digests(bpe.encode_decode(df, path, pattern, chunk_bytes=200_000)).collect()
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got], want)
    back = bpe.decode(bpe.encode(df, path, pattern), path).collect()
    same([(r.id, bytes(r.decoded).decode()) for r in back], [(i, t or "") for i, t in rows_of(df)])


def test_chat_table(spark):
    import duckdb

    got = queries.op10_chat(spark, SF).collect()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute(queries.OP10_SQL).fetchall()
    same([tuple(r) for r in got], want)


def test_chat_trees(spark):
    nodes = [
        ("t", 1, None, "user", "hi | <b>", 1.0), ("t", 2, 1, "assistant", "a%5B[x]", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", "c", 0.0), ("t", 5, 4, "assistant", None, None),
        ("u", 1, 99, None, "lost parent", None),
    ]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r["rank"]): r for r in chat.format_trees(df, best=2).collect()}
    assert [(k, r.leaf, r.n_turns) for k, r in sorted(got.items())] == [(("t", 1), 5, 4), (("t", 2), 2, 2), (("u", 1), 1, 1)]
    f = got["t", 2].formatted
    assert f == "<|user|>hi %7C %3Cb><|end|><|assistant|>a%255B%5Bx]<|end|>"
    (m,) = got["t", 2].mask
    assert f.encode()[m.start : m.start + m.n] == b"a%255B%5Bx]"


def test_chat_circles_and_repeated_nodes(spark):
    nodes = [("a", 1, None, "user", "q", 1.0), ("a", 2, 1, "assistant", "r", 1.0), ("a", 2, 1, "assistant", "r", 1.0), ("a", 2, 1, "assistant", "s", 1.0)]
    # 3 -> 5 -> 4 -> 3 with a leaf 9 under 5; a circle of two without a leaf; a node that is its own parent
    nodes += [("b", 3, 4, "user", "x", None), ("b", 4, 5, "user", "y", None), ("b", 5, 3, "user", "z", None), ("b", 9, 5, "assistant", "w", None)]
    nodes += [("c", 1, 2, "user", "m", 0.0), ("c", 2, 1, "user", "n", 0.0), ("d", 1, 1, "user", "o", 0.0), (None, None, None, None, None, None)]
    df = spark.createDataFrame([(*n, "clash", 1) for n in nodes], "tree string, node long, parent long, role string, text string, score double, leaf string, up long")
    said = {}
    for r in chat.format_trees(df, best=9).collect():
        said.setdefault(r.tree, []).append((r.leaf, r.formatted.replace("<|end|>", "").replace("<|user|>", " ").replace("<|assistant|>", " ").split()))
    # a: one of the repeated nodes; b: opened at 3, so 3 is the root of 5, and 5 of 4 and 9; c: opened at 1; d: a root
    assert said.pop("a") == [(2, ["q", "r"])]
    assert sorted(said.pop("b")) == [(4, ["x", "z", "y"]), (9, ["x", "z", "w"])]
    assert said.pop("c") == [(2, ["m", "n"])] and said.pop("d") == [(1, ["o"])]


def test_chat_long_and_odd(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"é{k}") for k in range(300)] + [(None, 1, None, None), (2, 5, "user", "tie"), (2, 5, "assistant", "tie"), (2, 5, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.turn_trees(df))).collect()}
    assert got[1].n_turns == 300 and got[1].loss_sha256 == brute.sha("".join(f"é{k}" for k in range(1, 300, 2)))
    assert got[1].turns_sha256 == brute.sha("".join(f"{'assistant' if k % 2 else 'user'}\né{k}\n" for k in range(300)))
    assert got[2].n_turns == 3 and got[2].loss_chars == 3 and got[None].n_turns == 1
    empty = spark.createDataFrame([], df.schema)
    assert chat.digests(chat.format_trees(chat.turn_trees(empty))).count() == 0


def test_importance(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = importance.resample(docs, labels, keep=0.3).collect()
    assert sum(r.kept for r in got) == 300
    cut = sorted((r.score for r in got), reverse=True)[299]
    assert all(r.kept == (r.score >= cut) for r in got)
    # weights against counts made in plain Python, through the same buckets
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    from colloquy.llm.common import WordHash

    h, raw, target, per = WordHash(), np.ones(importance.BUCKETS), np.ones(importance.BUCKETS), {}
    for i, t in rows_of(docs):
        per[i] = importance.buckets((t or "").encode(), h)
        np.add.at(raw, per[i], 1)
        if i in good:
            np.add.at(target, per[i], 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert all(abs(r.log_weight - ratio[per[r.doc_id]].sum()) < 1e-4 for r in got)
    # the score is the weight and the noise of the id, and the noise is Gumbel's: mean 0.5772, variance pi^2 / 6
    hashed = dict(docs.select("doc_id", F.xxhash64(F.lit(importance.SEED), "doc_id")).collect())
    noise = {i: -math.log(-math.log((((h % 2**64) >> 11) + 0.5) / 2**53)) for i, h in hashed.items()}
    score = {r.doc_id: ratio[per[r.doc_id]].sum() + noise[r.doc_id] for r in got}
    assert all(abs(r.score - score[r.doc_id]) < 1e-4 for r in got)
    assert abs(np.mean(list(noise.values())) - 0.5772) < 0.1 and abs(np.var(list(noise.values())) - 1.645) < 0.3
    chosen = {i for i in sorted(score, key=lambda i: -score[i])[:300]}
    assert {r.doc_id for r in got if r.kept} == chosen


def test_importance_odd(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = importance.resample(odd, none).collect()
    assert len(got) == odd.count() and all(r.log_weight == 0 for r in got)
    assert importance.resample(odd.limit(0), none).count() == 0


@pytest.mark.parametrize("k", [1, 3, 500, 1000])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(k)
    x = np.round(rng.normal(0, 3, 1000), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert importance.kth_largest(df, "v", k) == sorted(x, reverse=True)[k - 1]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_counts(which, request):
    import tiktoken

    df = request.getfixturevalue(which)
    path, pattern = queries.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    text = [(i, t or "") for i, t in rows_of(df)]
    got = token_counts.attribute(df, path, pattern).collect()
    same([(r.doc_id, r.n_tokens) for r in got], [(i, len(enc.encode_ordinary(t))) for i, t in text])
    for r in got:
        assert sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections and r.first_tokens == r.section_tokens[0]
    same([(r.doc_id, r.n_sections) for r in got], [(i, max(1, t.count("\n") + (not t.endswith("\n")))) for i, t in text])
    # each section's tokens: a token at a time, to the section that has most of its characters
    size = {i: b for b, i in bpe.load_ranks(path).items()}
    want = []
    for i, t in text:
        raw, lines = t.encode(), [len(x.encode()) for x in t.splitlines(keepends=True)] if "\r" not in t and t.isascii() else None
        if lines is None or len(raw) > 50_000:
            continue
        per, at, k, begin, crossing = [0] * max(1, len(lines)), 0, 0, 0, 0
        for token in enc.encode_ordinary(t):
            end, held, j, lo = at + len(size[token]), [], k, begin
            while True:
                hi = lo + lines[j]
                held.append((min(end, hi) - max(at, lo), -j))
                if end <= hi:
                    break
                lo, j = hi, j + 1
            per[-max(held)[1]] += 1
            crossing += sum(n > 0 for n, _ in held) > 1
            at = end
            while k < len(lines) - 1 and at >= begin + lines[k]:
                begin, k = begin + lines[k], k + 1
        want.append((i, tuple(per), crossing))
    left = Counter((r.doc_id, tuple(r.section_tokens), r.n_crossing) for r in got)
    assert want and not Counter(want) - left


def test_allocation_rule():
    ends, sections = np.array([2, 5, 9, 10]), np.array([3, 6, 10])
    # 0-2: first; 2-5: one character in the first, two in the second; 5-9: one and three; 9-10: third
    per, crossing = token_counts.allocate(ends, sections)
    assert per.tolist() == [1, 1, 2] and crossing == 2
    per, _ = token_counts.allocate(np.array([4]), np.array([2, 4]))
    assert per.tolist() == [1, 0]


def test_empty_tables(docs):
    none, (path, pattern) = docs.limit(0), queries.vocabulary()
    for df in (pii.detect(none), jaccard.groups(none), mixing.mix(none), quality_rules.judge(none), media.digests(none), bpe.digests(bpe.encode_decode(none, path, pattern)), token_counts.attribute(none, path, pattern), pii.sanitise(none), jaccard.keep_one(none), mixing.mixed_documents(none)):
        assert df.count() == 0


def test_bpe_chunks_are_not_shuffled_however_few_their_buckets(spark):
    """The packed chunks are most of the bytes: they stay in their buckets, and only word lists and ids are dealt."""
    import public_tokenizers

    from colloquy.llm import bpe

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "51")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(1, "some words, some words"), (2, None)], "doc_id long, text string")
        out = bpe.encode_decode(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2, plan
        assert {r.id: bytes(r.decoded) for r in out.collect()} == {1: b"some words, some words", 2: b""}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
