"""Assignments, join conditions and join-key resolution.

Statement parts arrive as normalized tables (one row per item), so every
operator is an equi-join or a window per statement; a statement's items are
bounded by its SQL text, and statements spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from columbine.functions.text import (
    WS, char_count, column_refs, is_constant, join_type_label, normalize_ws, original_ref, strip_target_prefix,
)
from columbine.operators.resolve import Catalog, resolve_refs
from columbine.session import RoundState

# Schema names that are never table aliases (join filter clean-up).
KNOWN_SCHEMAS = ["ATOMIC", "DBO", "PUBLIC", "SYS", "SCHEMA", "ADMIN", "APP"]

# One name part (Oracle names may hold # and $, quoted ones anything) and up to
# three parts of a column reference.
PART = r'(?:"[^"]+"|[\p{L}_][\p{L}\p{N}_#$]*)'
REF = rf"{PART}(?:\.{PART}){{0,2}}"
COL_EQ_COL = rf"^\(?{WS}*({REF}){WS}*={WS}*({REF}){WS}*\)?$"
# An equality: the sign is no part of <=, >=, != or <>.
ANY_EQ = rf"^{WS}*(.*?[^<>!={WS[1:-1]}]){WS}*={WS}*([^=].*?){WS}*$"
# Conditions under one OR or AND within a conjunct.
BRANCH = rf"(?i){WS}+(?:OR|AND){WS}+"


def _parts(ref: Column) -> tuple[Column, Column]:
    """(qualifier or '', name) of a reference: its last two parts, upper case,
    without quotes."""
    parts = F.transform(F.regexp_extract_all(ref, F.lit(f"({PART})"), 1),
                        lambda p: F.upper(F.regexp_replace(p, '"', "")))
    qualifier = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    return qualifier, F.element_at(parts, -1)


def _is_key(condition: Column) -> Column:
    """Whether a condition equates two column references."""
    return (condition.rlike(COL_EQ_COL) & ~is_constant(F.regexp_extract(condition, COL_EQ_COL, 1))
            & ~is_constant(F.regexp_extract(condition, COL_EQ_COL, 2)))


def _branches(condition: Column) -> Column:
    """The conditions inside a conjunct (one, unless it holds OR or AND), each
    without the parenthesis that its group opens, closes, or both."""
    def bare(b):
        b = F.trim(F.regexp_replace(b, r"^\(([^()]*)\)$", "$1"))
        more = char_count(b, "(") - char_count(b, ")")
        return F.when(more > 0, F.regexp_replace(b, r"^\( *", "")) \
            .when(more < 0, F.regexp_replace(b, r" *\)$", "")).otherwise(b)
    return F.transform(F.split(condition, BRANCH), bare)


def insert_assignments(insert_cols: DataFrame, projections: DataFrame, root_scopes: DataFrame) -> DataFrame:
    """Pair INSERT columns with the SELECT list by position.

    ``insert_cols(stmt_id, target_table, pos, target_column)`` lists explicit
    column lists; ``root_scopes(stmt_id, scope_id, target_table)`` names each
    INSERT's SELECT scope.  With a list, the i-th column takes the i-th select
    item (a column without one gets a warning and no expression); without a
    list, the select item names are the targets.
    """
    w = Window.partitionBy("stmt_id", "scope_id").orderBy("ord")
    items = (projections.join(root_scopes.select("stmt_id", "scope_id"), ["stmt_id", "scope_id"])
             .withColumn("pos", F.row_number().over(w) - 1))
    listed = insert_cols.select("stmt_id", "pos", F.upper("target_column").alias("target_column"))
    with_list = (listed.join(items, ["stmt_id", "pos"], "left")
                 .select("stmt_id", "pos", "target_column", "expression",
                         F.when(F.col("expression").isNull(), F.format_string(
                             "INSERT column %s at position %d has no matching SELECT expression",
                             "target_column", "pos")).otherwise("").alias("warning")))
    no_list = (items.join(insert_cols.select("stmt_id").distinct(), "stmt_id", "left_anti")
               .select("stmt_id", "pos", F.upper("output_name").alias("target_column"), "expression",
                       F.lit("").alias("warning")))
    out = with_list.unionByName(no_list).join(root_scopes, "stmt_id")
    return out.select("stmt_id", "scope_id", "target_table", F.col("pos").cast("long").alias("ord"),
                      "target_column", "expression", F.lit("INSERT_VALUES").alias("clause_type"), "warning")


def merge_assignments(merge_sets: DataFrame, insert_cols: DataFrame, insert_vals: DataFrame) -> DataFrame:
    """J13 + B20: SET pairs and INSERT column/value pairs of MERGE statements.

    ``merge_sets(stmt_id, when_ord, pos, target_table, target_alias, target, expression)``;
    ``insert_cols(stmt_id, when_ord, pos, col)``, ``insert_vals(stmt_id, when_ord, pos, val)``:
    columns and values pair by position (the shorter list wins).  DELETE
    clauses have no rows.  Order = (when_ord, pos).
    """
    sets = merge_sets.select(
        "stmt_id", "when_ord", "pos",
        strip_target_prefix(F.upper(F.trim("target")), F.upper("target_alias"), F.upper("target_table"))
        .alias("target_column"),
        "expression", F.lit("UPDATE_SET").alias("clause_type"))
    ins = insert_cols.join(insert_vals, ["stmt_id", "when_ord", "pos"]).select(
        "stmt_id", "when_ord", "pos", F.upper(F.trim("col")).alias("target_column"),
        F.col("val").alias("expression"), F.lit("INSERT_VALUES").alias("clause_type"))
    return sets.unionByName(ins)


def number_assignments(assignments: DataFrame) -> DataFrame:
    """``ord``: place of an assignment in its statement, over all WHEN clauses
    (the window holds one statement's assignments)."""
    w = Window.partitionBy("stmt_id").orderBy("when_ord", "pos")
    return assignments.withColumn("ord", F.row_number().over(w).cast("long"))


def first_assignment(assignments: DataFrame) -> DataFrame:
    """The first assignment per (statement, target column) in statement order.

    ``min_by`` aggregation (partial, map-side) rather than a window.
    """
    payload = F.struct("when_ord", "pos", "expression", "clause_type")
    return (assignments.groupBy("stmt_id", "target_column")
            .agg(F.min_by(payload, F.struct("when_ord", "pos")).alias("_a"))
            .select("stmt_id", "target_column", "_a.when_ord", "_a.pos", "_a.expression", "_a.clause_type"))


def join_conditions(conjuncts: DataFrame, scopes: DataFrame) -> DataFrame:
    """J14 + W2 + B16: join keys and filters of every join of every scope.

    ``conjuncts(stmt_id, scope_id, join_pos, side, kind, right_alias, conj_pos, condition)``;
    a join without ON has one row with a NULL condition (it still counts
    for ``join_seq``).  ``col = col`` conjuncts are KEY rows (original
    aliases kept), and so is every such equality inside an OR; every conjunct
    that is not one such equality is a filter, and a join's filters, joined by
    ``; ``, go onto each of its key rows.  A join without a key gives no row
    here (see ``theta_joins``).  Conjuncts are dealt over the tasks by statement
    before their texts are read, as a table of them may be one small file.
    """
    conjuncts = conjuncts.repartition("stmt_id")
    wseq = Window.partitionBy("stmt_id", "scope_id").orderBy("join_pos")
    joins = conjuncts.select("stmt_id", "scope_id", "join_pos", "side", "kind").distinct().withColumn(
        "join_seq", F.dense_rank().over(wseq).cast("long"))
    c = conjuncts.where(F.col("condition").isNotNull()).withColumn("_cond", normalize_ws("condition"))
    c = c.withColumn("_key", _is_key(F.col("_cond")))
    each = c.select("stmt_id", "scope_id", "join_pos", "conj_pos", F.explode_outer(_branches(F.col("_cond"))).alias("_b")) \
        .where(_is_key(F.col("_b")))
    l_ref, r_ref = F.regexp_extract("_b", COL_EQ_COL, 1), F.regexp_extract("_b", COL_EQ_COL, 2)
    (lt, lf), (rt, rf) = _parts(l_ref), _parts(r_ref)
    keys = each.select(
        "stmt_id", "scope_id", "join_pos", "conj_pos", F.concat(l_ref, F.lit(" = "), r_ref).alias("join_condition"),
        lt.alias("left_table"), lf.alias("left_field"), rt.alias("right_table"), rf.alias("right_field"))
    filters = (c.where(~F.col("_key")).groupBy("stmt_id", "scope_id", "join_pos")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conj_pos", "_cond"))),
                                             lambda x: x["_cond"]), "; ").alias("join_filters")))
    names = scopes.select("stmt_id", "scope_id", F.col("scope_name").alias("context_path"))
    out = (keys.join(joins, ["stmt_id", "scope_id", "join_pos"]).join(filters, ["stmt_id", "scope_id", "join_pos"], "left")
           .join(names, ["stmt_id", "scope_id"], "left"))
    return out.select(
        "stmt_id", "scope_id", "join_seq", join_type_label("side", "kind").alias("join_type"),
        "left_table", "left_field", "right_table", "right_field", "join_condition",
        F.coalesce("join_filters", F.lit("")).alias("join_filters"), "context_path", "conj_pos")


def theta_joins(conjuncts: DataFrame) -> DataFrame:
    """Joins whose ON holds no ``col = col`` equality (only filters), kept visible."""
    c = conjuncts.where(F.col("condition").isNotNull()).withColumn("_cond", normalize_ws("condition"))
    is_key = F.exists(_branches(F.col("_cond")), _is_key)
    return (c.groupBy("stmt_id", "scope_id", "join_pos").agg(
        F.max(is_key.cast("int")).alias("_k"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conj_pos", "_cond"))), lambda x: x["_cond"]),
                     "; ").alias("join_filters"))
        .where(F.col("_k") == 0).drop("_k"))


def merge_on_keys(merge_on: DataFrame) -> DataFrame:
    """Each equality of a MERGE ON -> one key row (type MERGE, path MERGE_ON);
    other comparisons give none.

    ``merge_on(stmt_id, conj_pos, target_table, target_alias, using_alias, condition)``.
    Sides keep their last two name parts; a blank alias becomes the target
    alias (left) or the USING alias (right).
    """
    m = merge_on.repartition("stmt_id").select("*", F.posexplode_outer(_branches(normalize_ws("condition"))).alias("_branch", "_cond")) \
        .where(F.col("_cond").rlike(ANY_EQ))
    w = Window.partitionBy("stmt_id").orderBy("conj_pos", "_branch")
    l, r = F.trim(F.regexp_extract("_cond", ANY_EQ, 1)), F.trim(F.regexp_extract("_cond", ANY_EQ, 2))
    lp, rp = F.split(l, r"\."), F.split(r, r"\.")

    def two(parts):
        return (F.when(F.size(parts) >= 2, F.upper(F.element_at(parts, -2))).otherwise(F.lit("")),
                F.upper(F.element_at(parts, -1)))

    lt, lf = two(lp)
    rt, rf = two(rp)
    return m.select(
        "stmt_id", F.row_number().over(w).cast("long").alias("join_seq"), F.lit("MERGE").alias("join_type"),
        F.when(lt == "", F.upper("target_alias")).otherwise(lt).alias("left_table"), lf.alias("left_field"),
        F.when(rt == "", F.upper("using_alias")).otherwise(rt).alias("right_table"), rf.alias("right_field"),
        F.concat(l, F.lit(" = "), r).alias("join_condition"), F.lit("").alias("join_filters"),
        F.lit("MERGE_ON").alias("context_path"))


def drop_non_columns(refs: DataFrame, dm_tables: DataFrame, relations: DataFrame) -> DataFrame:
    """C4: drop tokens of join filters that are not columns.

    ``refs(stmt_id, scope_id, ..., ref)``.  Dropped: ``SCHEMA.TABLE`` of a
    known schema; ``X.TABLE`` whose right side is a DM table and left side
    not an alias of the scope; a bare DM table name; a bare alias of the scope.
    """
    t = dm_tables.select(F.upper("table_name").alias("_t")).distinct().withColumn("_is_table", F.lit(True))
    aliases = relations.select("stmt_id", "scope_id", F.upper("alias").alias("_a")).distinct() \
        .withColumn("_is_alias", F.lit(True))
    parts = F.split(F.upper("ref"), r"\.", 2)
    x = refs.withColumns({"_left": F.when(F.size(parts) > 1, parts[0]),
                          "_right": F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0])})
    x = x.join(t.withColumnRenamed("_t", "_right").withColumnRenamed("_is_table", "_right_table"), "_right", "left")
    x = x.join(aliases.withColumnRenamed("_a", "_left").withColumnRenamed("_is_alias", "_left_alias"),
               ["stmt_id", "scope_id", "_left"], "left")
    x = x.join(aliases.withColumnRenamed("_a", "_right").withColumnRenamed("_is_alias", "_bare_alias"),
               ["stmt_id", "scope_id", "_right"], "left")
    dotted = F.col("_left").isNotNull()
    drop = (
        (dotted & F.col("_left").isin(KNOWN_SCHEMAS) & F.col("_right_table").isNotNull())
        | (dotted & F.col("_right_table").isNotNull() & F.col("_left_alias").isNull())
        | (~dotted & F.col("_right_table").isNotNull())
        | (~dotted & F.col("_bare_alias").isNotNull())
    )
    return x.where(~drop).select(*refs.columns)


def join_key_items(joins: DataFrame, cat: Catalog, dm_tables: DataFrame | None) -> DataFrame:
    """J17, first half: the LEFT key, RIGHT key and FILTER references of every
    join, each with the join's own scope and a per-statement ``root_ord``."""
    keyed = joins.select(
        "stmt_id", "scope_id", "join_seq", "join_type", "join_condition", "join_filters", "context_path",
        "conj_pos", F.inline(F.array(
            F.struct(F.lit("LEFT").alias("join_side"), F.lit("KEY").alias("field_role"),
                     original_ref("left_table", "left_field").alias("ref"), F.lit(0).alias("ref_pos")),
            F.struct(F.lit("RIGHT").alias("join_side"), F.lit("KEY").alias("field_role"),
                     original_ref("right_table", "right_field").alias("ref"), F.lit(0).alias("ref_pos")))))
    keyed = keyed.withColumn("full_expression", F.col("join_condition"))
    flt = (joins.where(F.col("join_filters") != "")
           .select("stmt_id", "scope_id", "join_seq", "join_type", "join_filters", "context_path")
           .dropDuplicates(["stmt_id", "scope_id", "join_seq", "join_type"])
           .select("*", F.posexplode_outer(column_refs("join_filters")).alias("ref_pos", "ref")).where("ref_pos is not null"))
    if dm_tables is not None:
        flt = drop_non_columns(flt, dm_tables, cat.relations)
    flt = flt.select("stmt_id", "scope_id", "join_seq", "join_type", F.col("join_filters").alias("join_condition"),
                     "join_filters", "context_path", F.lit(-1).alias("conj_pos"), F.lit("FILTER").alias("join_side"),
                     F.lit("FILTER").alias("field_role"), "ref", "ref_pos",
                     F.col("join_filters").alias("full_expression"))
    items = keyed.unionByName(flt)
    w = Window.partitionBy("stmt_id").orderBy("scope_id", "join_type", "join_seq", "conj_pos", "join_side",
                                              "ref_pos", "ref")
    return items.withColumn("root_ord", F.row_number().over(w).cast("long"))


def join_key_rows(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """J17, second half: one exploded row per resolved source of each item."""
    parts = F.split(F.upper(normalize_ws("ref")), r"\.", 2)
    out = items.join(resolved.drop("full_expression"), ["stmt_id", "root_ord"])
    return out.select(
        "stmt_id", "join_seq", "join_type", "join_side", "field_role",
        F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("original_alias"),
        F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0]).alias("original_field"),
        "source_type", F.col("table_name").alias("physical_table"), F.col("column_name").alias("physical_field"),
        "constant_value", "dm_match", "trace_path",
        F.when(F.col("source_type") == "UNRESOLVED", F.col("reason")).otherwise("").alias("unresolved_reason"),
        "join_condition", "context_path", "full_expression")


def explode_join_keys(spark: SparkSession, joins: DataFrame, cat: Catalog, dm_tables: DataFrame | None,
                      max_depth: int = 50) -> DataFrame:
    """LEFT key, RIGHT key and FILTER references of every join, each
    resolved in the join's own scope; one row per physical source.

    ``joins``: output of ``join_conditions`` / ``merge_on_keys`` with the
    scope they belong to (stmt_id, scope_id, join_seq, ...).
    """
    # read twice, as seeds and with their results: the conditions are taken apart once
    items = RoundState(spark).keep(join_key_items(joins, cat, dm_tables))
    seeds = items.select("stmt_id", "root_ord", "scope_id", F.col("ref").alias("expression"))
    res = resolve_refs(spark, seeds, None, None, None, None, max_depth=max_depth, catalog=cat)
    return join_key_rows(items, res)


# ---- v1: mapping spec ----------------------------------------------------------


def spec_for_object(spec: DataFrame, stmts: DataFrame) -> DataFrame:
    """Spec rows whose Name is the statement's object (and Type T2T when a
    Type column exists); compared trimmed, upper, NULL-safe; one join for all."""
    norm = lambda c: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    s = spec.withColumn("_name", norm("name"))
    if "type" in [c.lower() for c in spec.columns]:
        s = s.where(norm("type") == "T2T")
    st = stmts.select("stmt_id", F.upper(F.trim("object_name")).alias("_name"))
    return s.join(st, "_name").drop("_name")


def is_direct(spec: DataFrame) -> F.Column:
    """No expression, source table and column both set, source table not EXPRESSION."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return (blank("expression") & ~blank("source_table") & ~blank("source_column")
            & (F.upper(F.trim("source_table")) != "EXPRESSION"))


def spec_expression(spec: DataFrame) -> F.Column:
    """Direct -> TABLE.COLUMN; else the first non-blank of Expression,
    Source Column, Target Column."""
    nb = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    direct = F.concat(F.upper(F.trim("source_table")), F.lit("."), F.upper(F.trim("source_column")))
    return F.when(is_direct(spec), direct).otherwise(
        F.coalesce(nb("expression"), nb("source_column"), nb("target_column"), F.lit("")))


def direct_fallback(spec_rows: DataFrame, resolved: DataFrame, dm: DataFrame | None = None) -> DataFrame:
    """A direct spec mapping without a resolved row, or with UNRESOLVED
    ones only, gets one direct edge (path DIRECT_MAPPING) instead; others keep
    their rows.  ``dm(table_name, column_name)`` decides ``dm_match``.

    ``spec_rows(stmt_id, root_ord, direct, source_table, source_column, ...)``;
    ``resolved`` is ``resolve_refs`` output keyed by (stmt_id, root_ord).
    """
    found = resolved.where("source_type <> 'UNRESOLVED'").select("stmt_id", "root_ord").distinct()
    fall = spec_rows.where("direct").join(found, ["stmt_id", "root_ord"], "left_anti")
    keep = resolved.join(fall.select("stmt_id", "root_ord"), ["stmt_id", "root_ord"], "left_anti")
    if dm is not None:
        known = dm.select(F.col("table_name").alias("_dt"), F.col("column_name").alias("_dc")).distinct()
        fall = fall.join(known, (F.upper(F.trim("source_table")) == F.col("_dt"))
                         & (F.upper(F.trim("source_column")) == F.col("_dc")), "left")
    in_dm = F.when(F.col("_dt").isNotNull(), "Y").otherwise("N") if dm is not None else F.lit("N")
    direct_rows = fall.select(
        "stmt_id", "root_ord", F.lit("PHYSICAL").alias("source_type"),
        F.upper(F.trim("source_table")).alias("table_name"), F.upper(F.trim("source_column")).alias("column_name"),
        F.lit("").alias("constant_value"), F.lit("").alias("reason"), in_dm.alias("dm_match"),
        F.lit("DIRECT_MAPPING").alias("trace_path"), F.lit("").alias("source_alias"),
        F.lit("").alias("original_ref"), F.lit("").alias("full_expression"))
    return keep.unionByName(direct_rows.select(*keep.columns))
