from collections import Counter

import brute
import tiktoken
from tests_paths import SF

import corpus_pipeline
from colloquy.llm import bpe, mixing, queries, toxicity


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        seen.append(name)
        if name == "toxicity":
            source = spark.read.parquet(f"{SF}/documents.parquet")
            model = toxicity.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(source, model).collect() if r.predicted == 0}
            assert {r.doc_id for r in rows} == want and len(want) < len(before)
        if name == "near_copies":
            assert {r.doc_id for r in rows} == set(brute.components([(i, r.text) for i, r in before.items()]).values())
            assert all(before[r.doc_id].text == r.text for r in rows)
        if name == "pii":
            assert {r.doc_id for r in rows} == set(before) and not any(brute.spans(r.text) for r in rows)
            telling = brute.pii_telling([r.text for r in before.values()])
            assert all(r.text == brute.pii_sanitised(before[r.doc_id].text, telling) and r.n_chars == len(r.text) for r in rows)
            assert sum(r.text == before[r.doc_id].text for r in rows) > 0.9 * len(rows)
        if name == "mixing":
            taken = {r.doc_id: r.taken for r in mixing.mix(spark.read.parquet(f"{tmp_path}/pii")).collect() if r.taken}
            assert {r.doc_id: len(brute.WORD.findall(r.text)) for r in rows} == taken
            assert all(set(brute.WORD.findall(r.text)) <= set(brute.WORD.findall(before[r.doc_id].text)) for r in rows)
        if name == "bpe":
            path, pattern = queries.vocabulary()
            enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
            assert len(rows) == len(before)
            for r in rows:
                ids = enc.encode_ordinary(before[r.doc_id].text)
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(brute.ids_bytes(ids)), brute.sha(before[r.doc_id].text))
        else:
            assert docs.columns == columns
    assert seen == ["toxicity", "near_copies", "pii", "mixing", "bpe"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty and long texts, ties, repeated rows, clashing names, and a table without rows, through each stage."""
    # the plain patterns go back over runs of one character again and again: those are in test_pii_base
    odd = odd.where("text IS NULL OR length(text) < 20000 OR text LIKE 'w0 %'")
    rows, stages = odd.collect(), dict(corpus_pipeline.STAGES)
    got = {name: stage(spark, odd, SF) for name, stage in corpus_pipeline.STAGES}
    for name in ("toxicity", "near_copies", "pii", "mixing"):
        assert got[name].columns == odd.columns and got[name].dtypes == odd.dtypes, name
        assert stages[name](spark, odd.limit(0), SF).count() == 0, name
    assert Counter(map(repr, got["toxicity"].collect())) <= Counter(map(repr, rows))
    comp = brute.components([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
    assert Counter(map(repr, got["near_copies"].collect())) == Counter(repr(r) for r in rows if r.doc_id is None or comp[r.doc_id] == r.doc_id)
    telling = brute.pii_telling([r.text for r in rows])
    assert Counter(r.text for r in got["pii"].collect()) == Counter(brute.pii_sanitised(r.text, telling) for r in rows)
    taken = Counter((r.doc_id, r.taken) for r in mixing.mix(odd).collect() if r.taken)
    assert Counter((r.doc_id, len(brute.WORD.findall(r.text))) for r in got["mixing"].collect()) == taken
    assert Counter((r.doc_id, r.decoded_sha256) for r in got["bpe"].collect()) == Counter((r.doc_id, brute.sha(r.text or "")) for r in rows)
