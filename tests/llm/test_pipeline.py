"""Pipeline stages against the operators' brute-force versions on a small corpus."""

import hashlib

import numpy as np

import corpus_pipeline
from columbine.llm import decontaminate, nbsvm, suffix_dedup
from columbine.llm.common import materialize

from .test_operators import brute_components, brute_fingerprint, brute_removal


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = nbsvm.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = materialize(stage(spark, docs, sf), "test-stage")
        if k < 4:
            assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if k == 0:
            assert set(after) == {i for i, t in before if model.score(t.encode()) >= nbsvm.THRESHOLD}
        elif k == 1:
            comp = brute_components([brute_fingerprint(t) for _, t in before], 2)
            low = {}
            for c, (i, _) in zip(comp, before):
                low[c] = min(low.get(c, i), i)
            assert set(after) == set(low.values())
        elif k == 2:
            want = {r[0]: r[1] - r[2] for r in brute_removal(before, suffix_dedup.PASSAGE)}
            for i, t in before:  # characters cut in two are dropped too
                assert 0 <= want[i] - len(after[i].text.encode()) <= 6 and after[i].n_chars == len(after[i].text)
        elif k == 3:
            held = decontaminate.WindowSet(bench, decontaminate.WINDOW)
            assert set(after) == {i for i, t in before if not held.scan(decontaminate.words_of(t.encode()))[0]}
        else:
            for i, t in before:
                assert after[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
                assert len(np.frombuffer(bytes(after[i].ids), "<u4")) == after[i].n_tokens


def test_repeated_and_missing_ids(spark, sf):
    text = "alpha beta gamma delta " * 20
    rows = [(3, text), (3, text), (5, text), (None, text), (9, None), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    assert sorted(x for x in got if x is not None) == [3, 9] and got.count(None) == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("1 = 0"), sf).count() == 0
        stage(spark, docs, sf).count()


def test_repeated_ids_of_different_texts(spark, sf):
    """Each group keeps one row, whatever other groups have the same id."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma", "delta"))
    rows = [(1, a), (1, b), (2, a), (3, b),  # 1 leads two groups
            (4, c), (0, d), (4, d), (4, c), (5, None), (5, ""), (6, "")]  # 4 leads one and is a copy in another
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(1, a), (1, b), (4, c), (0, d), (5, "")])
