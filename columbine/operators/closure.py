"""Iterative graph helpers: frontier reachability and skew-safe numbering.

``reach`` is the one loop shared by the traces (G1, G2), scope walks and
name resolution rounds.  Each round joins the current frontier to the edge
table, removes pairs already visited (``left_anti``) and keeps the new pairs
as the next frontier.  Many seeds share one loop because the seed key is
part of every row.

Scale notes
-----------
* Edges are projected to their distinct key columns and written once; every
  round joins the frontier to them by an ordinary equi-join, whose strategy
  Spark picks at run time by size: it broadcasts a small frontier, and splits
  the partition of a hub node (both sides are shuffled by the join itself).
* Every round's new frontier is written with ``checkpoint()`` to the shared
  checkpoint folder, cutting the plan: planning cost stays flat over the
  rounds and executor loss never replays the whole loop.
* Rounds stop when no new pair appears, or at ``max_rounds``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from columbine.session import RoundState


def reach(
    spark: SparkSession,
    edges: DataFrame,
    seeds: DataFrame,
    node_cols: list[str],
    seed_cols: list[str],
    max_rounds: int | None = None,
) -> DataFrame:
    """All (seed, node, hop) pairs reachable from each seed.

    ``edges`` has columns ``src_<k>`` and ``dst_<k>`` for every ``k`` in
    ``node_cols``; ``seeds`` has ``seed_cols`` and ``node_cols`` (the start
    node, reached at hop 0).  Each pair is reported once, at its smallest
    hop.  Cycles end because a visited pair is never expanded again.
    """
    src = [f"src_{k}" for k in node_cols]
    dst = [f"dst_{k}" for k in node_cols]
    keys = seed_cols + node_cols
    state = RoundState(spark)
    e = state.keep(edges.select(*src, *dst).distinct())

    frontier = state.keep(seeds.select(*keys).distinct().withColumn("hop", F.lit(0)))
    n = frontier.count()
    parts = [frontier]
    rnd = 0
    while n > 0 and (max_rounds is None or rnd < max_rounds):
        rnd += 1
        f = frontier.select(*seed_cols, *[F.col(k).alias(s) for k, s in zip(node_cols, src)])
        step = e.join(f, src).select(*seed_cols, *[F.col(d).alias(k) for d, k in zip(dst, node_cols)])
        visited = parts[0].select(*keys)
        for p in parts[1:]:
            visited = visited.unionByName(p.select(*keys))
        new = step.distinct().join(visited, keys, "left_anti").withColumn("hop", F.lit(rnd))
        frontier = state.keep(new)
        n = frontier.count()
        if n > 0:
            parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordered_index(df: DataFrame, group_cols: list[str], order_cols: list[str],
                  index_col: str = "idx", size_col: str | None = "group_size",
                  partitions: int | None = None) -> DataFrame:
    """0-based position of each row within its group by ``order_cols``.

    Exact and skew-safe: rows are range-partitioned on (group, order) so a
    hot group spreads over many tasks; each task numbers its slice, and a
    small per-(group, slice) count table gives every slice its offset.  No
    task ever holds more than one range partition.  The sliced rows are
    checkpointed before both uses: two exchanges would sample two sets of
    bounds, and the offsets would belong to other slices.  Ties in
    ``order_cols`` are broken arbitrarily.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in group_cols + order_cols]) \
        .withColumn("_slice", F.spark_partition_id())
    ranged = RoundState(spark).keep(ranged)
    w_local = Window.partitionBy(*group_cols, "_slice").orderBy(*order_cols)
    local = ranged.withColumn("_local", F.row_number().over(w_local) - 1)
    counts = ranged.groupBy(*group_cols, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0)))
    if size_col:
        offsets = offsets.withColumn(size_col, F.sum("_n").over(Window.partitionBy(*group_cols)).cast("long"))
    out = local.join(offsets.drop("_n"), group_cols + ["_slice"])
    return out.withColumn(index_col, (F.col("_local") + F.col("_off")).cast("long")).drop("_slice", "_local", "_off")
