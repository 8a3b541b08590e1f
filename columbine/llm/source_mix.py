"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

**Targets.** Sources in code point order (null last) bear the given weights in
turn.  A source's target is its weight's part of ``share`` times all words, at
most ``most`` times its own words; what that leaves over is dealt to the other
sources by weight.  The factor words = level * weight is raised round by round
(one aggregation over the table of sources each) until no further source
reaches its bound.

**Blocks.** The documents of a source, in the order of a hash, are one stream
of words, cut in blocks of equal length (``MIN_BLOCK`` words, or more so that a
mix has under ``MAX_BLOCKS`` blocks).  A source's quota is the number of blocks
that holds its target; the last one is cut, so that the words are exact.  Each
pass over a source has its own keyed permutation of the block numbers: block b
stands at position pass * n + permuted(b), and the positions below the quota
are taken.  A pass takes a block at most once, so no document is taken more
often than there are passes.

**Tree.** All taken blocks are dealt to output shards of equal size.  A node of
the tree covers a range of shards and holds the quota of every source; its left
half gets a multivariate-hypergeometric draw of them, as many blocks as its
shards hold, the right half the rest, and so down to single shards.  Sources
are split in segments of ``SEGMENT``, each dealt evenly to all shards, so a
task holds ``SEGMENT`` quotas however many sources there are, and one round of
Spark descends six levels.  A node also knows at which position of each source
its part begins; so shards draw disjoint ranges of the permuted blocks.

**Draw and shuffle.** A document's pieces meet their shard by an equi-join on
(source, position bucket), whose groups are bounded; ``place`` is a keyed hash,
the order of blocks inside a shard.  ``texts`` gives the words of the pieces.

A source may hold most rows: running word counts come from range-partitioned
slices with a table of slice offsets, never from one group.  Every random
choice is a hash or a generator seeded by (seed, node), over an order that
content alone decides: reruns agree.

Defined cases: null and empty texts have size 0 and are taken 0 times; null
ids are ordinary; rows that repeat an id and a text are taken each for itself;
sources without words have target 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from columbine.llm.common import materialize
from columbine.operators.closure import ordered_index

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 42
MIN_BLOCK = 256
# numpy's hypergeometric draws are exact for populations below 10^9.
MAX_BLOCKS = 500_000_000
SHARD_BLOCKS = 4096
SEGMENT = 1024
# Children of a node after one round.
FAN = 64
# Positions in a join bucket.
BUCKET = 1024


class Mix(NamedTuple):
    """rows: (row, id, hash, source, rank, size, source_size, target, start);
    pieces: (row, rank, shard, place, within, pass, first_word, n_words)."""
    rows: DataFrame
    pieces: DataFrame


# ---- targets ---------------------------------------------------------------

def _level(sources: DataFrame, total: float, most: float) -> float:
    """Words a unit of weight gets, once sources at their bound are left out."""
    level = None
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.lit(most) * F.col("source_size")
        got = sources.agg(
            F.sum(F.when(full, F.lit(most) * F.col("source_size")).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not got.weight:
            return level or 0.0
        new = (total - got.used) / got.weight
        if level is not None and new <= level:
            return level
        level = new


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with rank, weight and target."""
    turns = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ordered_index(sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "rank", None)
    ranked = materialize(ranked.drop("_null").withColumn(
        "weight", F.element_at(turns, (F.col("rank") % len(weights) + 1).cast("int"))), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = _level(ranked, share * total, most)
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.lit(float(most)) * F.col("source_size")))


# ---- permutations ----------------------------------------------------------

def _stir(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of i under a keyed permutation of [0, n): a Feistel network over
    the next power of four, walked until it falls below n."""
    i, n, key = (np.asarray(x).astype(np.uint64) for x in (i, n, key))
    bits = np.frexp(np.maximum(n, 2).astype(np.float64) - 1)[1]
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.copy(), np.arange(len(i))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = out[todo] >> h, out[todo] & m
        for r in range(4):
            a, b = b, a ^ (_stir(b ^ _stir(k + np.uint64(r))) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _key(seed: int, rank: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return _stir(_stir(np.asarray(rank).astype(np.uint64) + np.uint64(seed)) + np.asarray(turn).astype(np.uint64))


# ---- quotas and tree -------------------------------------------------------

def _quotas(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds blocks (of one pass), quota (blocks taken) and cut (words that the last one loses)."""
    schema = "rank bigint, source_size bigint, words bigint, blocks bigint, quota bigint, cut bigint"

    def run(frames):
        for f in frames:
            size, words = f["source_size"].to_numpy(np.int64), f["words"].to_numpy(np.int64)
            n = -(-size // block)
            turn, rest = words // np.maximum(size, 1), words % np.maximum(size, 1)
            short = permuted(np.maximum(n - 1, 0), np.maximum(n, 1), _key(seed, f["rank"].to_numpy(), turn))
            lacks = n * block - size  # words that a pass's last block lacks
            q = -(-rest // block)
            q = np.where(short < q, -(-(rest + lacks) // block), q)
            cut = q * block - np.where(short < q, lacks, 0) - rest
            whole = rest == 0
            yield f.assign(blocks=n, quota=turn * n + np.where(whole, 0, q), cut=np.where(whole, 0, cut))

    return sources.select("rank", "source_size", F.floor(F.col("target") + 0.5).cast("bigint").alias("words")) \
        .mapInPandas(run, schema)


def _held(shards: int, total: int, turn: int, lo: int, hi: int) -> int:
    """Blocks that the shards [lo, hi) hold of ``total`` dealt evenly, the odd ones from shard -turn on."""
    each, odd = divmod(total, shards)
    at = turn % shards

    def odd_before(k: int) -> int:  # of the shards j < k, those with (j + at) % shards < odd
        return min(max(odd - at, 0), k) + min(max(k - (shards - at), 0), odd)

    return each * (hi - lo) + odd_before(hi) - odd_before(lo)


def _descend(rank, quota, begin, seg, lo, hi, shards, total, width, seed):
    """Nodes of at most ``width`` shards below one node: (lo, hi, rank, quota, begin)."""
    todo, out = [(lo, hi, rank, quota, begin)], []
    while todo:
        lo, hi, rank, quota, begin = todo.pop()
        if not len(rank):
            continue
        if hi - lo <= width:
            out.append((lo, hi, rank, quota, begin))
            continue
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, seg, lo, hi]).multivariate_hypergeometric(
            quota, _held(shards, total, seg, lo, mid), method="marginals")
        for a, b, q, s in ((lo, mid, left, begin), (mid, hi, quota - left, begin + left)):
            some = q > 0
            todo.append((a, b, rank[some], q[some], s[some]))
    return out


def _descender(shards: int, width: int, seed: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        s, t, lo, hi = (int(f[c].iloc[0]) for c in ("seg", "total", "lo", "hi"))
        got = _descend(*(f[c].to_numpy(np.int64) for c in ("rank", "quota", "begin")), s, lo, hi, shards, t, width, seed)
        return pd.concat([pd.DataFrame({"seg": s, "total": t, "lo": a, "hi": b, "rank": r, "quota": q, "begin": x})
                          for a, b, r, q, x in got])

    return run


def split(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(rank, shard, begin, quota): the positions [begin, begin + quota) of
    each source's blocks go to the shard."""
    schema = "seg bigint, total bigint, lo bigint, hi bigint, rank bigint, quota bigint, begin bigint"
    seg = F.floor(F.col("rank") / SEGMENT).cast("bigint")
    rows = quotas.where("quota > 0").withColumn("seg", seg)
    total = rows.groupBy("seg").agg(F.sum("quota").cast("bigint").alias("total"))
    nodes = rows.join(total, "seg").select(
        "seg", "total", F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"), "rank", "quota",
        F.lit(0).cast("bigint").alias("begin"))
    width = shards
    while width > 1:
        width = -(-width // FAN)
        nodes = materialize(nodes.groupBy("seg", "lo", "hi").applyInPandas(_descender(shards, width, seed), schema), "mix-tree")
    return nodes.select("rank", F.col("lo").alias("shard"), "begin", "quota")


# ---- documents -------------------------------------------------------------

def _starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: words of the rows before it in its source's stream."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, "rank", "hash", "row").withColumn("_slice", F.spark_partition_id()),
                        "mix-stream")
    here = Window.partitionBy("rank", "_slice").orderBy("hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("rank").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = dealt.groupBy("rank", "_slice").agg(F.sum("size").alias("_n")) \
        .select("rank", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.withColumn("_here", F.coalesce(F.sum("size").over(here), F.lit(0))).join(slices, ["rank", "_slice"]) \
        .withColumn("start", (F.col("_here") + F.col("_before")).cast("bigint")).drop("_here", "_before", "_slice")


def _pieces(rows: DataFrame, block: int, seed: int) -> DataFrame:
    """Taken pieces of every row: (row, rank, position, within, pass, first_word, n_words)."""
    schema = "row bigint, rank bigint, position bigint, within bigint, pass bigint, first_word bigint, n_words bigint"
    cols = ["row", "rank", "start", "size", "source_size", "blocks", "quota", "cut"]

    def run(batches):
        for b in batches:
            row, rank, start, size, whole, n, quota, cut = (
                b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols)
            first = start // block
            count = (start + size - 1) // block - first + 1
            of = np.repeat(np.arange(len(row)), count)
            no = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            for turn in range(int((-(-quota // np.maximum(n, 1))).max(initial=0))):
                live = turn * n[of] < quota[of]
                o, k = of[live], no[live]
                at = turn * n[o] + permuted(k, n[o], _key(seed, rank[o], np.full(len(o), turn)))
                taken = at < quota[o]
                o, k, at = o[taken], k[taken], at[taken]
                end = np.minimum((k + 1) * block, whole[o]) - np.where(at == quota[o] - 1, cut[o], 0)
                a, z = np.maximum(k * block, start[o]), np.minimum(end, start[o] + size[o])
                some = z > a
                o, k, at, a, z = o[some], k[some], at[some], a[some], z[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (row[o], rank[o], at, a - k * block, np.full(len(o), turn), a - start[o], z - a)],
                    names=["row", "rank", "position", "within", "pass", "first_word", "n_words"])

    return rows.where("size > 0 and quota > 0").select(*cols).mapInArrow(run, schema)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        share: float = SHARE, most: float = MOST, weights=WEIGHTS, seed: int = SEED,
        block: int = MIN_BLOCK, shard_blocks: int = SHARD_BLOCKS) -> Mix:
    """Draws the mix; ``pieces`` name the words of each shard in random order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(id_col), text).alias("hash"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        F.monotonically_increasing_id().alias("row")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    sources = materialize(targets(totals, share, most, weights), "mix-targets")
    taken = sources.agg(F.sum(F.floor(F.col("target") + 0.5))).first()[0] or 0
    block = max(block, -(-int(taken) // MAX_BLOCKS))
    quotas = materialize(_quotas(sources, block, seed), "mix-quotas")
    blocks = quotas.agg(F.sum("quota")).first()[0] or 0
    dealt = split(quotas, max(1, -(-int(blocks) // shard_blocks)), seed)

    known = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    rows = materialize(_starts(sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")), "mix-rows")
    drawn = _pieces(rows.join(quotas.select("rank", "blocks", "quota", "cut"), "rank"), block, seed)
    drawn = drawn.withColumn("bucket", F.floor(F.col("position") / BUCKET))
    ranges = dealt.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("begin") / BUCKET), F.floor((F.col("begin") + F.col("quota") - 1) / BUCKET))))
    pieces = drawn.join(ranges, ["rank", "bucket"]).where("position >= begin and position < begin + quota")
    return Mix(rows, pieces.select(
        "row", "rank", "shard", F.xxhash64(F.lit(seed), "rank", "position").alias("place"), "within", "pass",
        "first_word", "n_words"))


def taken(mixed: Mix, id_col: str = "doc_id") -> DataFrame:
    """(id_col, size, source_size, target, taken) of every row."""
    got = mixed.pieces.groupBy("row").agg(F.sum("n_words").cast("bigint").alias("taken"))
    return mixed.rows.join(got, "row", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def texts(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, place, within, id_col, words): the pieces' words joined by one
    space, shard by shard in the order of ``place``.

    A document meets the list of its own pieces, so its text is read and split once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.xxhash64(F.col(id_col), text).alias("hash"), F.col(id_col).alias("_id"),
                        text.alias("_text")).dropDuplicates(["hash", "_id"])
    lists = mixed.pieces.join(mixed.rows.select("row", "hash", "id"), "row").groupBy("row", "hash", "id").agg(
        F.collect_list(F.struct("shard", "place", "within", "first_word", "n_words")).alias("pieces"))
    same = (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id"))
    cut = lists.join(whole.withColumnRenamed("hash", "_hash"), same).withColumn(
        "_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    got = cut.select("id", F.inline(F.expr(
        "transform(pieces, p -> struct(p.shard as shard, p.place as place, p.within as within, "
        "array_join(slice(_words, cast(p.first_word + 1 as int), cast(p.n_words as int)), ' ') as words))")))
    return got.repartition("shard").sortWithinPartitions("shard", "place", "within").select(
        "shard", "place", "within", F.col("id").alias(id_col), "words")
