"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints: words between ASCII white space, lower-cased (A-Z), shingles of
``shingle`` words, repeats included; a bit is set if it is set in over half of
the shingles' XXH64 values (seed 42).  A text with fewer words is one shingle,
a text without words has fingerprint zero.

Index: distinct fingerprints are range-partitioned by Gray rank into slabs.
Neighbours in Gray order differ in few bits, so the members of a slab share
most leading bits: the shared bits and their values are the slab's node.
Nodes of consecutive slabs are factored again, 16 to a parent, up to the
root.  A fingerprint descends this tree and drops every branch whose shared
bits already differ in more than ``max_bits`` places (a child's shared bits
include its parent's, so differences accumulate); the slabs it reaches get it
as a query.  Inside a slab the members are factored the same way and the
queries descend to single fingerprints.  Pairs of slabs are visited once, and
hot slabs are dealt out over several tasks by query.

Links found in a task are reduced to a spanning forest there, so what leaves
it is bounded by the fingerprints it read, however dense a group is.  Groups
are the connected components of these forests (large-star / small-star
rounds, each written to the shared folder).

Bounds: exact copies are one fingerprint before anything is compared; the
slab nodes in each task are at most ``MAX_SLABS`` rows (slabs grow with the
table beyond that); no links, components or fingerprints reach the driver.

Defined cases: null and empty texts have fingerprint zero and link to each
other; repeated rows have the same component; a null doc_id never names a
component unless the whole component has none; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columbine.llm.common import let_go, materialize, release, text_bytes

SHINGLE = 3
MAX_BITS = 2
SLAB_ROWS = 32_768
MAX_SLABS = 65_536
FANOUT = 16
QUERIES_PER_TASK = 262_144
QUERY_CHUNK = 256
PAIRS_HELD = 1 << 20


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 16384):
        hi = min(n, lo + 16384)
        h = np.array([digest(joined[s:e - 1], 42) for s, e in
                      zip(starts[lo:hi], ends[lo + shingle - 1:hi + shingle - 1])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    set_bits = (2 * votes > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fp bigint: the 64 bits as a signed number) per row."""
    rows = docs.select(id_col, text_bytes(text_col).alias("raw"))
    schema = docs.select(id_col, F.lit(0).cast("bigint").alias("fp")).schema

    def run(batches):
        let_go()
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return rows.mapInArrow(run, schema)


def gray_rank(fp):
    """Position of a code word in Gray order, with the top bit flipped so that
    signed comparison sorts it as unsigned."""
    r = fp
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


def _gray_rank_np(fp: np.ndarray) -> np.ndarray:
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Nodes:
    """Levels of (shared mask, value) nodes over leaves in Gray order."""

    def __init__(self, mask: np.ndarray, value: np.ndarray):
        self.levels = [(mask, value)]
        while len(self.levels[0][0]) > FANOUT:
            m, v = self.levels[0]
            cut = np.arange(0, len(m), FANOUT)
            first = np.repeat(v[cut], np.diff(np.append(cut, len(m))))
            shared = np.bitwise_and.reduceat(m & ~(v ^ first), cut)
            self.levels.insert(0, (shared, v[cut] & shared))

    def search(self, query: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, leaf index) pairs within ``max_bits`` on the leaf's mask."""
        top = len(self.levels[0][0])
        q = np.repeat(np.arange(len(query)), top)
        node = np.tile(np.arange(top), len(query))
        for depth, (mask, value) in enumerate(self.levels):
            if depth:
                n = len(mask)
                q = np.repeat(q, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < n
                q, node = q[inside], node[inside]
            near = np.bitwise_count((query[q] ^ value[node]) & mask[node]) <= max_bits
            q, node = q[near], node[near]
        return q, node


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest value of its component) of the graph of a-b pairs."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Spanning forests (a, b) over the fingerprints that link; ``distinct``
    holds each fingerprint once, in column ``fp``."""
    spark = distinct.sparkSession
    total = distinct.count()
    rows = max(SLAB_ROWS, -(-total // MAX_SLABS))
    slabs = max(1, -(-total // rows))
    placed = materialize(
        distinct.select("fp", gray_rank(F.col("fp")).alias("rank"))
        .repartitionByRange(slabs, "rank").sortWithinPartitions("rank")
        .select("fp", F.spark_partition_id().alias("slab")), "simhash-slabs")
    node = placed.groupBy("slab").agg(
        F.bit_and("fp").alias("all1"), F.bit_or("fp").alias("any1"), F.count(F.lit(1)).alias("n"))
    node = sorted(node.collect())  # one row a slab, at most about MAX_SLABS
    ids = np.array([r.slab for r in node], np.int64)
    all1 = np.array([r.all1 for r in node], np.int64).view(np.uint64)
    any1 = np.array([r.any1 for r in node], np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast((ids, Nodes(~(all1 ^ any1), all1)))

    def route(dealt):
        """Rows (slab, deal, fp, member): members to every deal of their slab,
        queries to one deal of each later slab they may have links in."""
        def run(batches):
            ids, nodes = tree.value
            for b in batches:
                fp = b.column(0).to_numpy()
                own = b.column(1).to_numpy()
                for lo in range(0, len(fp), 4096):
                    f, o = fp[lo:lo + 4096], own[lo:lo + 4096]
                    q, leaf = nodes.search(f.view(np.uint64), max_bits)
                    s = ids[leaf]
                    up = s >= o[q]
                    q, s = q[up], s[up]
                    deals = np.array([dealt.get(int(x), 1) for x in s], np.int64)
                    deal = (f[q].view(np.uint64) % deals.astype(np.uint64)).astype(np.int64)
                    m = np.array([dealt.get(int(x), 1) for x in o], np.int64)
                    mi = np.repeat(np.arange(len(f)), m)
                    md = np.arange(len(mi)) - np.repeat(np.cumsum(m) - m, m)
                    yield pa.record_batch({
                        "slab": np.concatenate([s, o[mi].astype(np.int64)]),
                        "deal": np.concatenate([deal, md]),
                        "fp": np.concatenate([f[q], f[mi]]),
                        "member": np.concatenate([np.zeros(len(q), bool), np.ones(len(mi), bool)])})
        return run

    schema = "slab bigint, deal bigint, fp bigint, member boolean"
    source = placed.select("fp", F.col("slab").cast("bigint").alias("slab"))
    if total > QUERIES_PER_TASK:
        load = source.mapInArrow(route({}), schema).where("not member").groupBy("slab").count()
        dealt = {r.slab: -(-r["count"] // QUERIES_PER_TASK)
                 for r in load.where(F.col("count") > QUERIES_PER_TASK).collect()}  # at most a row a slab
    else:
        dealt = {}

    def search(t: pa.Table) -> pa.Table:
        member = t.column("member").to_numpy()
        fp = t.column("fp").to_numpy().view(np.uint64)
        leaf = fp[member]
        leaf = leaf[np.argsort(_gray_rank_np(leaf))]
        query = fp[~member]
        nodes = Nodes(np.full(len(leaf), ~np.uint64(0)), leaf)
        a, b, held = [], [], 0
        for lo in range(0, len(query), QUERY_CHUNK):
            part = query[lo:lo + QUERY_CHUNK]
            q, n = nodes.search(part, max_bits)
            x, y = part[q], leaf[n]
            other = x != y
            a.append(x[other])
            b.append(y[other])
            held += int(other.sum())
            if held > PAIRS_HELD:
                x, y = _forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
        # rows of a, not held: a fold on the last chunk with pairs leaves held at 0
        x, y = _forest(np.concatenate(a), np.concatenate(b)) if sum(map(len, a)) else (leaf[:0], leaf[:0])
        return pa.table({"a": x.view(np.int64), "b": y.view(np.int64)})

    routed = source.mapInArrow(route(dealt), schema)
    found = materialize(routed.groupBy("slab", "deal").applyInArrow(search, "a bigint, b bigint"), "simhash-links")
    release(placed)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; a root is
    the component's smallest node.  Large-star and small-star rounds until
    nothing changes."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")) \
                .union(e.select(F.col("b"), F.col("a")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u")
        if large:
            out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")) \
                .union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    current = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = state(current)
    while before[0]:
        new = materialize(star(star(current, True), False), "components")
        release(current)
        current, now = new, state(new)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint: 16 hex digits, component_id) per row of ``docs``."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("low")), "simhash-distinct")
    root = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(root, distinct["fp"] == root["node"], "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.select("fp", "root").join(low, "root").select("fp", "component_id")
    out = fps.join(by_fp, "fp")
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
