"""Merkle fixity audit of archive replicas.

A record is (file_id, at: byte offset in the file, size, digest: SHA-256 of
its bytes).  The leaves of a replica's tree are its offset ranges of
``LEAF_BYTES``: a leaf's hash covers the records that start in the range, in
offset order.  Each further level joins ``FANOUT`` neighbouring ranges, up to
one node per file, then neighbouring files up to one root.  Ranges are fixed
addresses, so a missing record changes its own branch only.  A node's address is
(file, range), both read as unsigned numbers, and the number of levels follows
from the highest bits of either replica: at most 16 of ranges, 16 of files,
whatever the ids.

The audit compares the roots, then descends level by level into the branches
whose hashes differ, and compares records only in leaves that differ.  A level
is a table with one row per range; a group is at most ``FANOUT`` rows (in a
leaf: the records that start within ``LEAF_BYTES``), so no task gathers more.

Defined cases: an empty payload is hashed like any other; a record that stands
twice at one address counts as two records of its range; equal replicas give
no rows, and so do two empty ones; records with a null address are dropped
(they have no place in a file); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from columbine.llm.common import materialize, release

LEAF_BYTES = 1 << 18
FANOUT_BITS = 4


def warc_record(uri: Column, payload: Column) -> Column:
    """Bytes of one WARC response record."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), payload, F.lit("\r\n\r\n").cast("binary"))


def hash_records(records: DataFrame) -> DataFrame:
    """(file_id, at, size, digest, label) from (file_id, at, record, label)."""
    return records.where("file_id is not null and at is not null").select(
        F.col("file_id").cast("bigint").alias("file_id"), F.col("at").cast("bigint").alias("at"),
        F.octet_length("record").cast("bigint").alias("size"), F.sha2("record", 256).alias("digest"), "label")


def lay_out(records: DataFrame, file_col: str, *order_cols: str) -> DataFrame:
    """``records`` (with ``size``) put end to end within their file: adds ``at``.

    A file's records meet in one task, with no payload: an archive file has a
    size of its own.
    """
    w = Window.partitionBy(file_col).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("at", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("bigint"))


LEAF_SHIFT = (LEAF_BYTES - 1).bit_length()


def _levels(hashed: list[DataFrame]) -> list[str]:
    """What each level above the leaves joins: "node" (ranges), then "file"."""
    bits = {"node": 0, "file": 0}
    for h in hashed:
        top = h.agg(F.bit_or(F.shiftrightunsigned("at", LEAF_SHIFT)), F.bit_or("file_id")).first()
        for k, v in zip(bits, top):
            bits[k] = max(bits[k], ((v or 0) % (1 << 64)).bit_length())
    return [k for k, n in bits.items() for _ in range(-(-n // FANOUT_BITS))]


def _up(nodes: DataFrame, what: str) -> DataFrame:
    """``nodes`` with the address of their parents."""
    at = {k: F.shiftrightunsigned(k, FANOUT_BITS) if k == what else F.col(k) for k in ("file", "node")}
    return nodes.withColumns({"up_file": at["file"], "up_node": at["node"]})


def _roll(nodes: DataFrame) -> DataFrame:
    """Nodes of the next level: hash over the children's places and hashes."""
    return nodes.groupBy("up_file", "up_node").agg(
        F.sha2(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("file", "node", "hash"))),
            lambda c: F.concat_ws(":", c["file"].cast("string"), c["node"].cast("string"), c["hash"])), ","), 256).alias("hash")) \
        .withColumnsRenamed({"up_file": "file", "up_node": "node"})


def build_tree(hashed: DataFrame, levels: list[str]) -> list[DataFrame]:
    """Levels (file, node, hash) from the leaves to the root, each written once."""
    rows = hashed.select(F.col("file_id").alias("file"), F.col("at").alias("node"),
                         F.concat_ws(":", F.col("size").cast("string"), "digest").alias("hash"))
    leaves = rows.withColumns({"up_file": F.col("file"), "up_node": F.shiftrightunsigned("node", LEAF_SHIFT)})
    tree = [materialize(_roll(leaves), "merkle")]
    for what in levels:
        tree.append(materialize(_roll(_up(tree[-1], what)), "merkle"))
    return tree


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places whose hashes differ, or that only one side has."""
    x, y = a.select("file", "node", F.col("hash").alias("ha")), b.select("file", "node", F.col("hash").alias("hb"))
    return x.join(y, ["file", "node"], "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "node")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Damage between two replicas' hashed records.

    Returns (file_id, at, label, status): ``differs`` (another size or hash at
    the same address), ``only_first`` or ``only_second``.
    """
    first, second = materialize(first, "merkle-records"), materialize(second, "merkle-records")
    levels = _levels([first, second])
    a, b = build_tree(first, levels), build_tree(second, levels)
    bad = _differing(a[-1], b[-1])
    for k in range(len(levels) - 1, -1, -1):
        parents = materialize(bad, "merkle-bad").withColumnsRenamed({"file": "up_file", "node": "up_node"})
        below = [_up(t[k], levels[k]).join(parents, ["up_file", "up_node"], "left_semi") for t in (a, b)]
        bad = _differing(*below)
    leaves = materialize(bad, "merkle-bad").select(F.col("file").alias("file_id"), F.col("node").alias("leaf"))
    for t in (*a, *b):
        release(t)

    def inside(records: DataFrame, name: str) -> DataFrame:
        leaf = records.withColumn("leaf", F.shiftrightunsigned("at", LEAF_SHIFT))
        return leaf.join(leaves, ["file_id", "leaf"], "left_semi").groupBy("file_id", "at").agg(
            F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col("size").cast("string"), "digest"))), ",")
            .alias(name), F.min("label").alias(f"{name}_label"))

    both = inside(first, "x").join(inside(second, "y"), ["file_id", "at"], "full_outer")
    status = F.when(F.col("y").isNull(), "only_first").when(F.col("x").isNull(), "only_second").otherwise("differs")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select(
        "file_id", "at", F.coalesce("x_label", "y_label").alias("label"), status.alias("status"))
