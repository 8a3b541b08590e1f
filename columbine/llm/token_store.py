"""Token-id store: ids bit-packed at the vocabulary's width, in blocks.

Documents are ordered by id (range partitions), encoded, ended with an end id
and packed.  A store is a Parquet folder with one row per block: its shard
(the range partition, in document order) and number, where it starts in the
shard, how many ids it holds, their width in bits, the ids of its documents,
where each document ends in the block, and the packed bytes.  Blocks hold
whole documents, ``BLOCK_IDS`` ids or more where one document is longer; id k
of a block lies at bit k * bits, so numpy unpacks any slice of a block
without touching the rest.

Spark's own Parquet commit makes the write safe against lost tasks.  The
shards' totals (one row a range partition) give every shard its start.

Defined cases: a null or empty text is its end id alone; repeated rows are
stored each, rows with one id in the order of their texts; null ids come
first; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from columbine.llm.common import read_driver_file, text_bytes

BLOCK_IDS = 1 << 16
# Entries a worker's memo of encoded words holds before its older half goes, and
# the longest word in it: under 0.5 GB for words of that length, 0.15 GB for usual ones.
MEMO_ENTRIES = 1_000_000
MEMO_WORD = 64
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def bits_for(vocab_size: int) -> int:
    """Least width that holds every id below ``vocab_size``."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bit first."""
    wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a block."""
    at = np.arange(first, first + n, dtype=np.int64) * bits
    padded = np.frombuffer(packed + bytes(8), np.uint8)
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class WordEncoder:
    """Whole-text encoding by the tokenizers library for files that drop white
    space between words (so words are encoded apart, each distinct one once)."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.memo: dict[bytes, bytes] = {}

    def vocab_size(self) -> int:
        return self.tok.get_vocab_size(with_added_tokens=True)

    def _library(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        for w, e in zip(words, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            self.memo[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, raw: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        # the file lower-cases anyway; special tokens are written in one case only
        plain = b"<|" not in raw
        words = (raw.lower() if plain else raw).split()
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            pass
        if len(memo) > MEMO_ENTRIES:
            for w in list(islice(memo, len(memo) // 2)):
                del memo[w]
        missing = [w for w in set(words) if w not in memo]
        if plain:
            # a run of marks after an ASCII letter is a piece of its own
            parts = {}
            for w in missing:
                core = w.rstrip(_PUNCT)
                if core and core != w and b"a" <= core[-1:] <= b"z":
                    parts[w] = (core, w[len(core):])
            need = {p for w in missing for p in parts.get(w, (w,))}
            self._library([p for p in need if p not in memo])
            for w, (core, tail) in parts.items():
                memo[w] = memo[core] + memo[tail]
        else:
            self._library(missing)
        ids = b"".join([memo[w] for w in words])
        for w in [w for w in missing if len(w) > MEMO_WORD]:
            memo.pop(w, None)
            memo.pop(w.rstrip(_PUNCT), None)
        return ids


_LOADED: dict[int, WordEncoder] = {}


def _load(held) -> WordEncoder:
    key = hash(held.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordEncoder(held.value)
    return _LOADED[key]


BLOCK_SCHEMA = ("shard int, block int, first_id bigint, n_ids bigint, bits int, "
                "doc_ids array<bigint>, doc_ends array<bigint>, ids binary")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` and write the store to the folder ``path``."""
    spec = read_driver_file(tokenizer)
    held = docs.sparkSession.sparkContext.broadcast(spec)
    bits = bits_for(max(WordEncoder(spec).vocab_size(), end_id + 1))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        shard = TaskContext.get().partitionId()
        encoder = _load(held)
        block, first = 0, 0
        ids, names, ends, held_ids = [], [], [], 0

        def flush():
            nonlocal block, first, ids, names, ends, held_ids
            packed = pack(np.frombuffer(b"".join(ids), "<u4"), bits)
            out = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                pa.array([held_ids], pa.int64()), pa.array([bits], pa.int32()),
                pa.array([names], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
                pa.array([packed], pa.binary())],
                names=["shard", "block", "first_id", "n_ids", "bits", "doc_ids", "doc_ends", "ids"])
            block, first = block + 1, first + held_ids
            ids, names, ends, held_ids = [], [], [], 0
            return out

        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                got = encoder.encode(raw.as_py()) + end
                n = len(got) // 4
                if held_ids and held_ids + n > block_ids:
                    yield flush()
                ids.append(got)
                names.append(name)
                held_ids += n
                ends.append(held_ids)
        if held_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(text_col).alias("raw"))
    rows.repartitionByRange("id").sortWithinPartitions("id", "raw") \
        .mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The store's block rows."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every stored document.

    ``start`` counts the ids of all documents before it; ``ids`` are
    little-endian unsigned 32-bit integers.
    """
    blocks = read_blocks(spark, path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    starts = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ends = np.array(r["doc_ends"], np.int64)
                begin = np.concatenate(([0], ends[:-1]))
                all_ids = unpack(r["ids"], r["bits"], 0, r["n_ids"])
                parts = [all_ids[s:e].tobytes() for s, e in zip(begin, ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["shard"]] * len(ends), pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                    pa.array(r["first_id"] + begin, pa.int64()), pa.array(ends - begin, pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array(parts if with_ids else [None] * len(parts), pa.binary())],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    rows = blocks.mapInArrow(
        run, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return rows.join(starts, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def read_span(spark: SparkSession, path: str, shard: int, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a shard, from the blocks that hold them only."""
    rows = read_blocks(spark, path).where(
        (F.col("shard") == shard) & (F.col("first_id") < first + n) & (F.col("first_id") + F.col("n_ids") > first))
    parts = []
    for r in rows.orderBy("block").collect():  # the blocks of one asked-for span
        a, e = max(first - r.first_id, 0), min(first + n - r.first_id, r.n_ids)
        parts.append(unpack(bytes(r.ids), r.bits, a, e - a))
    return np.concatenate(parts) if parts else np.empty(0, "<u4")
