"""Version comparison of two mapping tables.

Plan shape at scale: each version is reduced to one row per mapping key by
an aggregation (partial aggregation runs map-side, so a key repeated a
billion times still leaves one row per task before the shuffle), then the
two versions meet in one full outer sort-merge join on the four keys.  Keys
are unique on both sides after the reduction, so the join cannot skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columbine.sources.io import MAPPING_KEYS

CHANGE_TYPES = ["added", "removed", "modified", "unchanged"]
# Strength of a change when a table edge holds several mappings.
CHANGE_RANK = {"added": 4, "modified": 3, "removed": 2, "unchanged": 1}


def last_mapping(mappings: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """One row per mapping key, the last one by ``order_col`` winning.

    Written as ``max_by`` aggregation instead of a window so duplicates of a
    hot key are combined before the shuffle.
    """
    payload = F.struct(
        F.col("rules").alias("rules"),
        F.col("mapping_type").alias("mapping_type"),
        F.col("object_name").alias("object_name"),
    )
    return (
        mappings.groupBy(*MAPPING_KEYS)
        .agg(F.max_by(payload, F.col(order_col)).alias("_m"), F.count(F.lit(1)).alias("copies"))
        .select(*MAPPING_KEYS, "_m.rules", "_m.mapping_type", "_m.object_name",
                F.col("copies").cast("long").alias("copies"))
    )


def mapping_delta(v1: DataFrame, v2: DataFrame, order_col: str = "row_ord") -> DataFrame:
    """Full outer join of two versions on the four keys.

    ``modified`` when rules or mapping type differ (object name does not
    count).  Both sides' values are carried; the absent side is NULL.
    """
    a = last_mapping(v1, order_col).select(
        *MAPPING_KEYS, F.col("rules").alias("v1_rules"), F.col("mapping_type").alias("v1_mapping_type"),
        F.col("object_name").alias("v1_object_name"), F.lit(True).alias("_in1"))
    b = last_mapping(v2, order_col).select(
        *MAPPING_KEYS, F.col("rules").alias("v2_rules"), F.col("mapping_type").alias("v2_mapping_type"),
        F.col("object_name").alias("v2_object_name"), F.lit(True).alias("_in2"))
    j = a.join(b, MAPPING_KEYS, "full_outer")
    change = (
        F.when(F.col("_in2").isNull(), "removed")
        .when(F.col("_in1").isNull(), "added")
        .when((F.col("v1_rules") != F.col("v2_rules")) | (F.col("v1_mapping_type") != F.col("v2_mapping_type")),
              "modified")
        .otherwise("unchanged")
    )
    return j.select(
        *MAPPING_KEYS, change.alias("change_type"),
        "v1_rules", "v2_rules", "v1_mapping_type", "v2_mapping_type", "v1_object_name", "v2_object_name",
    )


def delta_summary(delta: DataFrame) -> DataFrame:
    """One row with the count of every change type, zeros included."""
    return delta.agg(*[
        F.count_if(F.col("change_type") == t).cast("long").alias(f"{t}_count") for t in CHANGE_TYPES
    ])


def by_change(df: DataFrame, types=("added", "removed", "modified"), col: str = "change_type") -> DataFrame:
    """Keep wanted change types; rows without a change type pass."""
    return df.where(F.col(col).isNull() | F.col(col).isin(list(types)))


def delta_nodes(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Tables of the delta graph: those of V2, and those that only edges
    removed since V1 still name (``version`` says which graph a table is from)."""
    def ends(m: DataFrame, name: str) -> DataFrame:
        return m.select(F.explode(F.array("source_table", "dest_table")).alias("table_name"), F.lit(name).alias("version"))

    edge = ["source_table", "dest_table"]
    gone = v1.select(*edge).join(v2.select(*edge), edge, "left_anti")
    return ends(v2, "V2").unionByName(ends(gone, "V1")).groupBy("table_name").agg(F.max("version").alias("version"))


def delta_graph(v1: DataFrame, v2: DataFrame, delta: DataFrame) -> DataFrame:
    """Table edges of V2 marked by the strongest change of their mappings.

    added > modified > removed > unchanged.  Table edges only in V1 are
    appended as removed.  Returns (source_table, dest_table, change_type,
    mapping_count).
    """
    rank = F.create_map(*[x for k, v in CHANGE_RANK.items() for x in (F.lit(k), F.lit(v))])
    unrank = F.create_map(*[x for k, v in CHANGE_RANK.items() for x in (F.lit(v), F.lit(k))])
    marks = delta.where(F.col("change_type") != "unchanged").select(
        *MAPPING_KEYS, rank[F.col("change_type")].alias("_rank"))
    v2_edges = (
        v2.select(*MAPPING_KEYS)
        .join(marks, MAPPING_KEYS, "left")
        .groupBy("source_table", "dest_table")
        .agg(F.max(F.coalesce("_rank", F.lit(1))).alias("_rank"), F.count(F.lit(1)).alias("mapping_count"))
        .select("source_table", "dest_table", unrank[F.col("_rank")].alias("change_type"),
                F.col("mapping_count").cast("long"))
    )
    v1_only = (
        v1.groupBy("source_table", "dest_table").agg(F.count(F.lit(1)).cast("long").alias("mapping_count"))
        .join(v2.select("source_table", "dest_table"), ["source_table", "dest_table"], "left_anti")
        .select("source_table", "dest_table", F.lit("removed").alias("change_type"), "mapping_count")
    )
    return v2_edges.unionByName(v1_only)
