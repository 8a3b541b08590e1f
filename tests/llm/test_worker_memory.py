"""What stays in Python workers between stages, and what moves beside the texts."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from columbine.llm import bpe, common, decontaminate, nbsvm, simhash, suffix_dedup

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


class Held:
    value = bpe.read_driver_file(VOCABULARY)


@pytest.fixture
def functions(docs, monkeypatch):
    """The functions given to ``mapInArrow``, in order."""
    found, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, fn, *a, **k: found.append(fn) or real(df, fn, *a, **k))
    return found


def test_other_operators_free_the_encoder(docs, functions):
    keyed = docs.selectExpr("doc_id as k1", "doc_id as k2", "cast(text as binary) as raw")
    model = nbsvm.fit([], [])
    simhash.fingerprints(docs)
    nbsvm.score(docs, model)
    suffix_dedup._ranges(keyed, 200, 6)
    decontaminate.scan(docs, docs.selectExpr("doc_id as item_id", "text").where("doc_id = 10"))
    assert len(functions) == 4
    for run in functions:
        encoder = bpe._load(Held)
        assert bpe._load(Held) is encoder  # one operator's tasks share it
        list(run(iter([])))
        assert not common._KEPT


def test_encoded_rows_go_out_in_small_batches(docs, functions, monkeypatch):
    bpe.round_trip(docs, VOCABULARY)
    bpe.decode(docs.selectExpr("doc_id", "array(1) as ids"), VOCABULARY)
    monkeypatch.setattr(bpe, "OUT_BYTES", 1000, raising=False)
    texts = [b"some words of text " * 20] * 7 + [b""] * 3 + [b"x y " * 900] + [b"end"]  # one longer than a batch
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "__columbine_raw": pa.array(texts, pa.binary())})
    out = list(functions[0](iter([batch, batch.slice(0, 0)])))
    assert all(b.num_rows == 1 or sum(len(t) for t in b.column(2).to_pylist()) <= 1000 for b in out) and len(out) > 4
    got = pa.Table.from_batches(out)
    assert got.column("doc_id").to_pylist() == list(range(len(texts))) and got.column("decoded").to_pylist() == texts
    ids = [np.frombuffer(x, "<i4").tolist() for x in got.column("ids").to_pylist()]
    ids = pa.array(ids, pa.list_(pa.int32()))
    batch = pa.record_batch({"doc_id": pa.array(range(len(ids))), "ids": ids, "__columbine_ids": ids})
    out = list(functions[1](iter([batch])))
    assert len(out) > 4 and [t.encode() for b in out for t in b.column(2).to_pylist()] == texts


def test_texts_move_once(docs, spark):
    """Removing strings joins spans to the texts, not to texts and their bytes."""
    rows = suffix_dedup.deduplicate(docs.select("doc_id", "text"))
    assert "__columbine_raw" not in rows._jdf.queryExecution().optimizedPlan().toString()
    once = {r.doc_id: r.text for r in rows.collect() if r.doc_id in (1, 2, 9, 10, 18)}
    assert once[1] is None and once[2] == "" and once[10].startswith("head ") and once[18] == ""
