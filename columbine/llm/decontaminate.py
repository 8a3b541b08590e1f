"""Benchmark decontamination by word windows.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and
non-ASCII characters.  Every run of ``window`` consecutive words of a
benchmark item is a test n-gram (an item with fewer words is one n-gram).
The n-grams go to the tasks as a broadcast hash set in blocks of at most
``BLOCK_BYTES`` of benchmark text.  A benchmark of one block is one map-only
pass.  A larger one is worked through block by block: each block's hits are
written, by the hash of the text, and its broadcast is dropped before the next
block, so one broadcast and one Python stage live at a time; the hits join the
documents at the end.  No n-gram is left out.  A task maps words to the block's word ids,
takes rolling hashes of the windows made of known words only, looks them up
in the sorted hash array and verifies every hit by comparing the ids.

Defined cases: a null or empty text or item has no words and no hit; repeated
rows are each scanned; an item without id contributes its windows but cannot
be named in ``items``; an empty benchmark hits nothing; other columns pass
through unchanged.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columbine.llm.common import let_go, materialize, text_bytes

WINDOW = 10
# Benchmark text per broadcast block.
BLOCK_BYTES = 2 << 20

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MULT = 0x9E3779B97F4A7C15
SPANS = "array<struct<first:int,last:int>>"


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_KEEP).split()


class WindowSet:
    """The n-grams of one block of benchmark items, ready for lookup."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], set] = {}
        for item_id, raw in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(raw)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                self.owners.setdefault(tuple(ids[i:i + n]), set()).add(item_id)
        self.hashes: dict[int, np.ndarray] = {}
        for n in sorted({len(g) for g in self.owners}):
            grams = np.array([g for g in self.owners if len(g) == n], dtype=np.uint64)
            self.hashes[n] = np.unique(self._hash(grams.T))

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h + c.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULT)
            h ^= h >> np.uint64(29)
        return h

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans (first, last word) and the items behind them."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        spans, items = [], set()
        for n, known in self.hashes.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = self._hash([ids[at + k] for k in range(n)])
            found = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            for p in at[found].tolist():
                owners = self.owners.get(tuple(ids[p:p + n].tolist()))
                if owners:
                    spans.append((p, p + n - 1))
                    items |= owners
        return merge_spans(spans), items


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """(number of blocks, benchmark items block by block); the driver holds ``BLOCK_BYTES`` of text at a time, more or less."""
    items = benchmark.select(F.col(id_col).alias("i"), text_bytes(text_col).alias("t")).distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    return n, ([(r.i, bytes(r.t)) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]
               for k in range(n))


def _step(held):
    """Counts words, adds the hits of a broadcast ``WindowSet`` (if any) and merges spans."""
    def run(batches):
        let_go()
        for batch in batches:
            names = batch.schema.names
            col = {k: batch.column(names.index(k)) for k in ("__columbine_raw", "__columbine_spans", "__columbine_items")}
            n_words, spans, items = [], [], []
            for raw, s, i in zip(col["__columbine_raw"], col["__columbine_spans"].to_pylist(), col["__columbine_items"].to_pylist()):
                words = words_of(raw.as_py())
                n_words.append(len(words))
                new, owners = held.value.scan(words) if held is not None else ([], set())
                if new or s:
                    s = merge_spans([(x["first"], x["last"]) for x in s] + new)
                    s = [{"first": a, "last": b} for a, b in s]
                    i = list(set(i) | owners - {None})
                spans.append(s)
                items.append(i)
            new = {"__columbine_n_words": n_words, "__columbine_spans": spans, "__columbine_items": items}
            yield pa.record_batch([
                pa.array(new[f.name], f.type) if f.name in new else batch.column(k)
                for k, f in enumerate(batch.schema)], schema=batch.schema)
    return run


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``__columbine_n_words``, ``__columbine_spans`` (hit words, merged) and ``__columbine_items``."""
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType
    out = docs.withColumn("__columbine_raw", text_bytes(text_col))
    n, blocks = _blocks(benchmark, item_col, item_text)
    none = {"__columbine_n_words": F.lit(None).cast("bigint"), "__columbine_spans": F.array().cast(SPANS),
            "__columbine_items": F.array().cast(T.ArrayType(item_type))}
    if n > 1:
        key = {"__columbine_k1": F.xxhash64("__columbine_raw"), "__columbine_k2": F.xxhash64(F.lit(1), "__columbine_raw")}
        texts = out.select("__columbine_raw").withColumns(none)
        hits = []
        for block in blocks:
            held = spark.sparkContext.broadcast(WindowSet(block, window))
            hit = texts.mapInArrow(_step(held), texts.schema).where(F.size("__columbine_spans") > 0)
            hits.append(materialize(hit.withColumns(key).select(*key, "__columbine_spans", "__columbine_items").distinct(),
                                    "decontaminate-hits"))
            held.unpersist()
        found = hits[0]
        for h in hits[1:]:
            found = found.union(h)
        # of one text, at most a list a block
        found = found.groupBy(*key).agg(
            F.flatten(F.collect_list("__columbine_spans")).alias("__columbine_spans"),
            F.array_distinct(F.flatten(F.collect_list("__columbine_items"))).alias("__columbine_items"))
        out = out.withColumns(key).join(found, [*key], "left").select(
            *docs.columns, "__columbine_raw", none["__columbine_n_words"].alias("__columbine_n_words"),
            *[F.coalesce(c, none[c]).alias(c) for c in ("__columbine_spans", "__columbine_items")])
        return out.mapInArrow(_step(None), out.schema).drop("__columbine_raw")
    out = out.withColumns(none)
    held = next((spark.sparkContext.broadcast(WindowSet(block, window)) for block in blocks), None)
    return out.mapInArrow(_step(held), out.schema).drop("__columbine_raw")


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` (and what lies between them)."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.lower())]
    keep, pos = [], 0
    for a, b in spans:
        keep.append(raw[pos:at[a][0]])
        pos = at[b][1]
    keep.append(raw[pos:])
    return b"".join(keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW,
                  text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or without the hit spans.

    ``remove="documents"`` drops every document with a hit;
    ``remove="spans"`` cuts the hit words out of the text.
    """
    found = scan(docs, benchmark, text_col=text_col, window=window)
    if remove == "documents":
        return found.where(F.size("__columbine_spans") == 0).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove: 'documents' or 'spans'")

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd
        return pd.Series([
            cut_words(t.encode(), [(x["first"], x["last"]) for x in s]).decode("utf-8", "replace")
            if t is not None and len(s) else t for t, s in zip(text, spans)])

    return found.withColumn(text_col, cut(text_col, "__columbine_spans")).select(*docs.columns)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from ``scan``'s columns."""
    hit = F.aggregate("__columbine_spans", F.lit(0).cast("bigint"),
                      lambda a, s: a + s["last"].cast("bigint") - s["first"].cast("bigint") + 1)
    names = F.array_join(F.array_sort(F.transform("__columbine_items", lambda i: i.cast("string"))), ",")
    return found.select(
        id_col, F.col("__columbine_n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("__columbine_items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))
