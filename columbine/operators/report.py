"""Outputs: edge table, per-statement stats, summary, QA.

Everything is grouped by ``stmt_id`` (partial aggregation), so per-statement
reports scale with the number of statements; global ordering happens only
at the sink, where the order is the point of the output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columbine.functions.text import simple_refs
from columbine.operators import delta as D
from columbine.operators import graph as G

# Output column lists of the five outputs.
MAPPING_COLUMNS = [
    "sql_file", "object_name", "row_type", "dest_table", "dest_field", "source_type",
    "source_table", "source_field", "source_alias", "original_ref", "full_expression",
    "constant_value", "expression", "dm_match", "trace_path", "notes",
    "table_alias", "join_seq", "join_type", "join_side", "field_role",
    "join_condition", "context_path",
]
JOIN_COLUMNS = [
    "sql_file", "object_name", "join_seq", "join_type", "left_table", "left_field",
    "right_table", "right_field", "join_condition", "join_filters", "context_path",
]
JOIN_KEYS_EXPLODED_COLUMNS = [
    "sql_file", "object_name", "join_seq", "join_type", "join_side",
    "field_role", "original_alias", "original_field", "source_type",
    "physical_table", "physical_field", "constant_value", "dm_match",
    "trace_path", "unresolved_reason", "join_condition", "context_path", "full_expression",
]
SUMMARY_COLUMNS = ["sql_file", "metric", "value", "notes"]
QA_COLUMNS = ["sql_file", "object_name", "check_type", "dest_field", "deep_sources", "simple_sources", "match",
              "notes"]
UNRESOLVED_ALARM_PCT = 20.0


def mapping_edges(assignments: DataFrame, resolved: DataFrame, stmts: DataFrame) -> DataFrame:
    """MAPPING rows: every resolved source of every assignment.

    ``assignments(stmt_id, ord, target_table, target_column, expression, clause_type)``;
    ``resolved`` keyed by (stmt_id, root_ord = ord).
    """
    a = assignments.select("stmt_id", F.col("ord").cast("long").alias("root_ord"), "target_table",
                           "target_column", F.col("expression").alias("_expr"), "clause_type")
    r = resolved.join(a, ["stmt_id", "root_ord"]).join(stmts.select("stmt_id", "sql_file", "object_name"), "stmt_id")
    return r.select(
        "sql_file", "object_name", F.lit("MAPPING").alias("row_type"), F.col("target_table").alias("dest_table"),
        F.col("target_column").alias("dest_field"), "source_type", F.col("table_name").alias("source_table"),
        F.col("column_name").alias("source_field"), "source_alias", "original_ref",
        F.coalesce(F.nullif("full_expression", F.lit("")), "_expr").alias("full_expression"), "constant_value",
        F.col("_expr").alias("expression"), "dm_match", "trace_path",
        F.when(F.col("reason") != "", F.concat("clause_type", F.lit(": "), "reason")).otherwise(F.col("clause_type"))
        .alias("notes"),
        *[F.lit("").alias(c) for c in ("table_alias", "join_seq", "join_type", "join_side", "field_role",
                                       "join_condition", "context_path")],
        "stmt_id")


def drop_merge_targets(exploded: DataFrame) -> DataFrame:
    """MERGE ON rows that stay UNRESOLVED (the target side) leave the edge table."""
    return exploded.where(~((F.col("join_type") == "MERGE") & (F.col("source_type") == "UNRESOLVED")))


def join_edges(exploded: DataFrame, stmts: DataFrame) -> DataFrame:
    """JOIN rows from exploded join keys (C8: unresolved MERGE target sides dropped)."""
    e = drop_merge_targets(exploded).join(stmts.select("stmt_id", "sql_file", "object_name"), "stmt_id")
    oref = F.when(F.col("original_alias") != "", F.concat("original_alias", F.lit("."), "original_field")) \
        .otherwise(F.col("original_field"))
    return e.select(
        "sql_file", "object_name", F.lit("JOIN").alias("row_type"), F.lit("").alias("dest_table"),
        F.lit("").alias("dest_field"), "source_type", F.col("physical_table").alias("source_table"),
        F.col("physical_field").alias("source_field"), F.col("original_alias").alias("source_alias"),
        oref.alias("original_ref"), "full_expression", "constant_value", oref.alias("expression"), "dm_match",
        "trace_path", F.col("unresolved_reason").alias("notes"), F.col("original_alias").alias("table_alias"),
        F.when(F.col("join_seq") > 0, F.col("join_seq").cast("string")).otherwise("").alias("join_seq"),
        "join_type", "join_side", "field_role", "join_condition", "context_path", "stmt_id")


def edge_table(mapping_rows: DataFrame, join_rows: DataFrame) -> DataFrame:
    """C7 + U2: MAPPING and JOIN rows in one table with the fixed columns (and stmt_id)."""
    return mapping_rows.unionByName(join_rows).select(*MAPPING_COLUMNS, "stmt_id")


def sort_edges(edges: DataFrame) -> DataFrame:
    """Per-file order: file, row type, dest table, dest field, join seq (as a number), side."""
    return edges.orderBy("sql_file", "row_type", "dest_table", "dest_field",
                         F.expr("try_cast(join_seq as int)").asc_nulls_first(), "join_side")


def sort_combined(edges: DataFrame) -> DataFrame:
    """Combined order: file, dest table, dest field, source type, table, field (NULL last)."""
    return edges.orderBy(*[F.col(c).asc_nulls_last() for c in
                           ("sql_file", "dest_table", "dest_field", "source_type", "source_table", "source_field")])


def sort_exploded(exploded: DataFrame) -> DataFrame:
    """Exploded join order: file, seq, side, role."""
    return exploded.orderBy("sql_file", "join_seq", "join_side", "field_role")


def edge_stats(edges: DataFrame, join_count: DataFrame | None = None) -> DataFrame:
    """A1: per statement counts of rows, kinds, DM matches and joins."""
    st = edges.groupBy("stmt_id", "sql_file", "object_name").agg(
        F.count(F.lit(1)).cast("long").alias("total_rows"),
        F.count_if(F.col("row_type") == "MAPPING").cast("long").alias("mapping_count"),
        F.count_if(F.col("row_type") == "JOIN").cast("long").alias("join_field_count"),
        F.count_if(F.col("source_type") == "PHYSICAL").cast("long").alias("physical_count"),
        F.count_if(F.col("source_type") == "CONSTANT").cast("long").alias("constant_count"),
        F.count_if(F.col("source_type") == "SEQUENCE").cast("long").alias("sequence_count"),
        F.count_if(F.col("source_type") == "UNRESOLVED").cast("long").alias("unresolved_count"),
        F.count_if(F.col("dm_match") == "Y").cast("long").alias("dm_match_y"),
        F.count_if(F.col("dm_match") == "N").cast("long").alias("dm_match_n"),
        F.count_if((F.col("row_type") == "MAPPING") & (F.col("source_type") == "UNRESOLVED"))
        .cast("long").alias("mapping_unresolved"))
    if join_count is not None:
        st = st.join(join_count, "stmt_id", "left").withColumn("join_count", F.coalesce("join_count", F.lit(0)))
    else:
        st = st.withColumn("join_count", F.lit(0).cast("long"))
    return st


def summary_long(stats: DataFrame) -> DataFrame:
    """A2: the stats in long form, eight metrics per file (the reference's
    always-zero ``total_mappings`` is fixed to the mapping count)."""
    metrics = ["mapping_count", "physical_count", "constant_count", "sequence_count", "unresolved_count",
               "dm_match_y", "dm_match_n", "join_count"]
    names = ["total_mappings", "physical", "constant", "sequence", "unresolved", "dm_match_y", "dm_match_n", "joins"]
    stack = F.expr("stack(8, " + ", ".join(f"'{n}', cast({m} as bigint)" for n, m in zip(names, metrics))
                   + ") as (metric, value)")
    return stats.select("sql_file", stack, F.lit("").alias("notes"))


def unresolved_rate(stats: DataFrame, threshold_pct: float = UNRESOLVED_ALARM_PCT) -> DataFrame:
    """A3: share of UNRESOLVED among MAPPING rows per statement; alarm above the threshold."""
    pct = F.when(F.col("mapping_count") > 0, F.col("mapping_unresolved") * 100.0 / F.col("mapping_count"))
    return stats.select("stmt_id", "sql_file", "object_name", "mapping_count", "mapping_unresolved",
                        F.round(pct, 4).alias("unresolved_pct"),
                        F.coalesce(pct > threshold_pct, F.lit(False)).alias("alarm"))


def qa_compare(edges: DataFrame, stmts: DataFrame, text_col: str = "sql_text") -> DataFrame:
    """A4: per (statement, dest_field): distinct physical sources found by
    resolution vs the dotted pairs of the raw SQL (a coarse flag, as in the
    reference: one field's sources against the whole statement's pairs).

    Both sides are sorted, de-duplicated arrays built by partial aggregation;
    the raw pairs are one array per statement (bounded by its text).
    """
    deep = (edges.where(F.col("source_type") == "PHYSICAL")
            .groupBy("stmt_id", "sql_file", "object_name", "dest_field")
            .agg(F.array_sort(F.collect_set(F.concat_ws(".", "source_table", "source_field"))).alias("_deep")))
    simple = stmts.select("stmt_id", F.array_sort(F.transform(simple_refs(F.col(text_col)), lambda p: F.concat_ws(
        ".", p["table"], p["column"]))).alias("_simple"))
    j = deep.join(simple, "stmt_id", "left").withColumn("_simple", F.coalesce("_simple", F.array()))
    return j.select(
        "stmt_id", "sql_file", "object_name", F.lit("SOURCE_SET").alias("check_type"), "dest_field",
        F.array_join("_deep", ", ").alias("deep_sources"), F.array_join("_simple", ", ").alias("simple_sources"),
        F.when(F.col("_deep") == F.col("_simple"), "Y").otherwise("N").alias("match"), F.lit("").alias("notes"))


def join_table(joins: DataFrame, stmts: DataFrame) -> DataFrame:
    """The join-key table (``JOIN_COLUMNS``), a row per key of every join.

    ``joins``: output of ``join_conditions`` and ``merge_on_keys``; ``stmts``
    has ``stmt_id``, ``sql_file`` and ``object_name``.
    """
    return joins.join(stmts.select("stmt_id", "sql_file", "object_name"), "stmt_id").select(*JOIN_COLUMNS)


def write_outputs(outputs: dict[str, DataFrame], path: str, per_object: bool = False, mode: str = "overwrite") -> None:
    """Write the outputs (edges, joins, join_keys_exploded, summary, qa)
    as parquet, one folder each; ``per_object`` partitions by object name."""
    for name, df in outputs.items():
        w = df.write.mode(mode)
        if per_object and "object_name" in df.columns:
            w = w.partitionBy("object_name")
        w.parquet(f"{path.rstrip('/')}/{name}")


def graph_json(v1: DataFrame, v2: DataFrame | None = None, catalog: DataFrame | None = None,
               v1_name: str = "Version 1", v2_name: str = "Version 2") -> DataFrame:
    """The viewer's data as JSON lines (kind, json), written with ``df.write.text``.

    Kinds: ``config`` (one row), ``node`` (a table of either version) and its
    ``column`` rows, ``edge`` and ``mapping`` rows of both versions' graphs,
    ``delta_mapping`` (a field mapping with its change) and ``delta`` (the
    counts).  Rows instead of nested lists: mappings belong to an edge by
    version and tables, a node's upstream and downstream tables are those of
    the edges of V2, or of V1 without V2.  Edges and mappings have ``version``
    V1 or V2, whose names are in the config.
    """
    versions = [("V1", v1)] + ([("V2", v2)] if v2 is not None else [])
    tables = G.all_tables(*[m for _, m in versions])
    parts = [("config", tables.agg(F.count(F.lit(1)).alias("table_count")).select(
        F.lit(v1_name).alias("v1_name"), F.lit(v2_name if v2 is not None else None).cast("string").alias("v2_name"),
        F.lit(v2 is not None).alias("has_v2"), F.lit(v2 is not None).alias("has_delta"), "table_count"))]
    parts.append(("node", G.graph_nodes(v1, v2, catalog)))
    if catalog is not None:
        parts.append(("column", catalog.join(tables, "table_name", "left_semi")))
    for version, m in versions:
        parts.append(("edge", G.graph_edges(m).withColumn("version", F.lit(version))))
        parts.append(("mapping", G.field_edges(m).withColumn("version", F.lit(version))))
    if v2 is not None:
        delta = D.mapping_delta(v1, v2)
        parts += [("delta_mapping", delta), ("delta", D.delta_summary(delta))]
    # an absent side's values are left out of a delta row, as in the reference
    rows = [df.select(F.lit(kind).alias("kind"), F.to_json(
        F.struct("*"), {"ignoreNullFields": str(kind == "delta_mapping").lower()}).alias("json")) for kind, df in parts]
    return reduce(DataFrame.unionByName, rows)
