"""Hard-negative mining with Four-Russians scoring.

Vectors are integers here.  A candidate's vector is stored as bit planes: for
every group of eight dimensions and every bit k of the two's complement, one
byte holds bit k of the eight components.  For an anchor, a table gives per
group the sum of its components over each of the 256 subsets of eight.  The
inner product is then

    sum over bits k of  sign_k * 2^k * sum over groups g of  table[g][byte(g, k)],

one look-up for eight products, shifted and added from the highest plane
down (the highest plane is the negative one).  Scores are exact.

Anchors meet all candidates in blocks: candidates are dealt into chunks, anchors
into blocks, both by a hash of the row, and a task scores one (chunk, block)
tile, in steps whose tables and scores stay in the cache.  A tile sends on the
best rows per anchor only; a window keeps the best of all tiles.  The first pass
scores rows of the anchor's label (positives), the second one rows of other
labels whose score lies in the window of a positive (negatives).

An anchor may have any number of equal rows and a label may hold most rows:
tiles are dealt by row, not by label or value, and a tile has at most about
``CHUNK`` rows and ``BLOCK`` anchors.  No row is dropped: an exact top k of all
tiles is made of exact top ks of single tiles.

Defined cases: rows with a null label, a null vector or a component that is
null, NaN or infinite take no part; shorter vectors count as filled up with
zeros; a null id is no anchor and comes last among equal scores; rows that
repeat an id are rows of their own, and an anchor is only itself no partner;
components beyond 64-bit integers stop at their ends and sums wrap as long
does; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from columbine.llm.common import materialize

GROUP = 8
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative's score lies between these percentages of the positive's.
LOW, HIGH = 80, 100
# Rows and anchors of a tile.
CHUNK = 1 << 16
BLOCK = 1 << 13
# Rows and anchors scored in one step: 2 MB of tables and scores.
STEP_ROWS, STEP_ANCHORS = 1024, 64


# ---- scoring ---------------------------------------------------------------

def planes(vectors: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes (rows, bits, groups) of integer vectors whose width is a multiple of ``GROUP``."""
    n, width = vectors.shape
    v = vectors.astype(np.int64).reshape(n, 1, width // GROUP, GROUP)
    set_bits = (v >> np.arange(bits, dtype=np.int64)[:, None, None]) & 1
    return np.packbits(set_bits.astype(np.uint8), axis=-1, bitorder="little")[..., 0]


def tables(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Subset sums (groups, 256, anchors): entry b adds up the components at the bits of b."""
    n, width = anchors.shape
    parts = anchors.astype(np.int64).astype(kind).T.reshape(width // GROUP, GROUP, n)
    out = np.zeros((width // GROUP, 1 << GROUP, n), kind)
    for bit in range(GROUP):
        out[:, 1 << bit:2 << bit] = out[:, :1 << bit] + parts[:, bit:bit + 1]
    return out


def scores(packed: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors) of bit planes with the anchors of a table."""
    n, bits, groups = packed.shape
    total = np.zeros((n, table.shape[2]), table.dtype)
    part = np.empty_like(total)
    for k in range(bits - 1, -1, -1):
        if k < bits - 1:
            total += total
        for g in range(groups):
            np.take(table[g], packed[:, k, g], axis=0, out=part, mode="clip")
            total += part
        if k == bits - 1:
            np.negative(total, out=total)
    return total


def _kind(anchors: np.ndarray, bits: int, width: int) -> type:
    """32 bits where no score and no partial sum can leave them."""
    most = int(np.abs(anchors.astype(np.float64)).max(initial=0))
    return np.int32 if width * most * (1 << (bits + 1)) < 1 << 31 else np.int64


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, earlier places first among equal ones."""
    at = np.arange(len(score))
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    return at[np.argsort(-score[at], kind="stable")[:k]]


# ---- tiles -----------------------------------------------------------------

def _unpack(t: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("vector").to_pylist()), "<i8").reshape(-1, width)


class _Tile:
    """The rows of a tile in order of id (null last), and its anchors."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, bits: int, width: int):
        ids = rows.column("id")
        self.null = np.asarray(ids.is_null())
        self.id = ids.fill_null(0).to_numpy()
        order = np.lexsort((rows.column("row").to_numpy(), self.id, self.null))
        self.null, self.id = self.null[order], self.id[order]
        self.row, self.label = rows.column("row").to_numpy()[order], rows.column("label").to_numpy()[order]
        packed = np.frombuffer(b"".join(rows.column("planes").to_pylist()), np.uint8)
        self.packed = packed.reshape(len(order), bits, width // GROUP)[order]
        self.anchors, self.bits, self.width = anchors, bits, width
        self.anchor, self.a_label = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
        self.vector = _unpack(anchors, width)

    def score(self, rows: np.ndarray, anchors: np.ndarray):
        """(places of some anchors, scores of all ``rows`` with them), step by step."""
        for a in range(0, len(anchors), STEP_ANCHORS):
            some = anchors[a:a + STEP_ANCHORS]
            v = self.vector[some]
            table = tables(v, _kind(v, self.bits, self.width))
            yield some, np.concatenate([scores(self.packed[rows[r:r + STEP_ROWS]], table)
                                        for r in range(0, len(rows), STEP_ROWS)])

    def ids(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.id[at], pa.int64(), mask=self.null[at])


def _index(rows: DataFrame, bits: int, width: int) -> DataFrame:
    """Every row's bit planes: (row, id, label, planes)."""
    def run(batches):
        for b in batches:
            flat = np.frombuffer(b"".join(_padded(b.column(3), width)), "<i8").reshape(-1, width)
            packed = planes(flat, bits).reshape(len(flat), -1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([x.tobytes() for x in packed], pa.binary())],
                names=["row", "id", "label", "planes"])

    return rows.select("row", "id", "label", "vector").mapInArrow(run, "row bigint, id bigint, label bigint, planes binary")


def _padded(vectors: pa.Array, width: int) -> list[bytes]:
    return [np.asarray(v.values, np.int64).astype("<i8").tobytes().ljust(8 * width, b"\0") for v in vectors]


def _pack_anchors(rows: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(_padded(b.column(3), width), pa.binary())],
                                             names=["row", "id", "label", "vector"])

    return rows.select("row", "id", "label", "vector").mapInArrow(run, "row bigint, id bigint, label bigint, vector binary")


def _tiles(index: DataFrame, anchors: DataFrame, chunks: int, blocks: int, fn, schema: str) -> DataFrame:
    """``fn(rows, anchors)`` of every tile."""
    parts = chunks * blocks

    def number(of: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")

    left = index.withColumn("chunk", number(F.col("row"), chunks)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("block", number(F.col("row"), blocks)).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return left.repartition(parts, "chunk", "block").groupBy("chunk", "block").cogroup(
        right.repartition(parts, "chunk", "block").groupBy("chunk", "block")).applyInArrow(fn, schema)


def _ranked(found: DataFrame, keys: list[str], score: str, row: str, k: int) -> DataFrame:
    """The k best rows per key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last("id"), row)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- operator --------------------------------------------------------------

def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         is_anchor: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor``: condition over the input's columns (default: ids divisible
    by 100).  Components become floor(``scale`` * x).
    """
    spark = vectors.sparkSession
    anchor = (F.col(id_col) % 100 == 0) if is_anchor is None else is_anchor
    whole = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        F.transform(vector_col, lambda x: x.cast("double")),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = materialize(vectors.where(whole).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("vector")), "negatives-rows")
    size = rows.agg(
        F.max(F.size("vector")).alias("dims"), F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors"),
        F.max(F.array_max("vector")).alias("most"), F.min(F.array_min("vector")).alias("least")).first()
    width = max(1, -(-(size.dims or 0) // GROUP)) * GROUP
    bits = 1 + max((size.most or 0).bit_length(), (~min(size.least or 0, 0)).bit_length())
    index = materialize(_index(rows, bits, width), "negatives-planes")
    chosen = materialize(_pack_anchors(rows.where("anchor"), width), "negatives-anchors")
    # As many tiles as keep all cores busy, and none above its bound.
    blocks = max(1, -(-size.anchors // block))
    chunks = max(1, -(-size.rows // chunk), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))

    def near(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 4]
        if rows.num_rows and anchors.num_rows:
            t = _Tile(rows, anchors, bits, width)
            for label in np.intersect1d(t.label, t.a_label):
                same = np.flatnonzero(t.label == label)
                for some, score in t.score(same, np.flatnonzero(t.a_label == label)):
                    for j, a in enumerate(some):
                        own = t.row[same] != t.anchor[a]
                        at = _best(score[own, j], positives)
                        got = same[own][at]
                        out.append((np.full(len(got), t.anchor[a]), t.row[got], got, score[own, j][at].astype(np.int64)))
        a, r, got, s = map(np.concatenate, zip(*out))
        ids = t.ids(got) if len(got) else pa.array([], pa.int64())
        return pa.table({"anchor": a, "row": r, "id": ids, "score": s})

    found = _tiles(index, chosen, chunks, blocks, near, "anchor bigint, row bigint, id bigint, score bigint")
    best = materialize(_ranked(found, ["anchor"], "score", "row", positives), "negatives-positives")
    # Each anchor once, with the scores of its positives in order of rank.
    bounds = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("of")) \
        .select(F.col("anchor").alias("row"), F.col("of.score").alias("bounds"))
    aimed = materialize(chosen.join(bounds, "row"), "negatives-aimed")

    def other(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 5]
        if rows.num_rows and anchors.num_rows:
            t = _Tile(rows, anchors, bits, width)
            bounds = anchors.column("bounds").to_pylist()
            for some, score in t.score(np.arange(len(t.row)), np.arange(len(t.anchor))):
                for j, a in enumerate(some):
                    s = score[:, j]
                    ends = [(-(-low * p // 100), high * p // 100) for p in bounds[a]]
                    apart = np.flatnonzero((t.label != t.a_label[a]) & (s >= min(e[0] for e in ends))
                                           & (s <= max(e[1] for e in ends)))
                    for k, (least, most) in enumerate(ends):
                        inside = apart[(s[apart] >= least) & (s[apart] <= most)]
                        got = inside[_best(s[inside], negatives)]
                        out.append((np.full(len(got), t.anchor[a]), np.full(len(got), k + 1), t.row[got], got,
                                    s[got].astype(np.int64)))
        a, k, r, got, s = map(np.concatenate, zip(*out))
        ids = t.ids(got) if len(got) else pa.array([], pa.int64())
        return pa.table({"anchor": a, "of": k, "row": r, "id": ids, "score": s})

    hard = _tiles(index, aimed, chunks, blocks, other, "anchor bigint, of bigint, row bigint, id bigint, score bigint")
    hard = _ranked(hard, ["anchor", "of"], "score", "row", negatives)
    names = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = best.select("anchor", F.col("rank").cast("bigint").alias("of"), F.col("id").alias("positive_id"),
                        F.col("score").alias("positive_score")).join(names, "anchor")
    return hard.join(pairs, ["anchor", "of"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
