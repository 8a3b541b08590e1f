"""Graph over a mapping table (viewer operators).

The flat field-level mapping table (one row per source field -> dest field)
is the working form; table-level edges are aggregations of it.  Nested lists
of mappings per table edge are never built in a job (a hub edge could hold a
third of all mappings): per-edge lists are served from the flat table keyed
by the edge, numbered by ``ordered_index``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from columbine.functions.text import layer_order, mapping_class, table_layer
from columbine.operators.closure import ordered_index, reach
from columbine.operators.reach_index import ReachIndex, build, build_both
from columbine.operators.substring_index import SubstringIndex
from columbine.session import RoundState

DIRECT_TYPES = ["MAP", "MAPPING", ""]
PREVIEW_FIELDS = 8
SEARCH_LIMIT = 15


# ----------------------------------------------------------------------------
# tables and fields
# ----------------------------------------------------------------------------


def all_tables(*versions: DataFrame) -> DataFrame:
    """Every table name at either end of any version (distinct)."""
    out = None
    for v in versions:
        if v is None:
            continue
        part = v.select(F.col("source_table").alias("table_name")).unionByName(
            v.select(F.col("dest_table").alias("table_name")))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def table_edges(mappings: DataFrame) -> DataFrame:
    """Distinct (source_table, dest_table) pairs."""
    return mappings.select("source_table", "dest_table").distinct()


def graph_edges(mappings: DataFrame) -> DataFrame:
    """A5: per table edge the mapping count and its distinct mapping types."""
    return mappings.groupBy("source_table", "dest_table").agg(
        F.count(F.lit(1)).cast("long").alias("mapping_count"),
        F.array_sort(F.collect_set("mapping_type")).alias("mapping_types"),
    )


def field_edges(mappings: DataFrame) -> DataFrame:
    """C9 + W4: one row per mapping with its index in the table edge and the edge size."""
    return ordered_index(
        mappings, ["source_table", "dest_table"], ["source_field", "dest_field", "rules", "mapping_type", "object_name"],
        index_col="edge_index", size_col="edge_size")


def mapped_fields(mappings: DataFrame) -> DataFrame:
    """Distinct (table_name, field_name) over both ends of every mapping."""
    return (mappings.select(F.col("source_table").alias("table_name"), F.col("source_field").alias("field_name"))
            .unionByName(mappings.select(F.col("dest_table").alias("table_name"),
                                         F.col("dest_field").alias("field_name")))
            .distinct())


def field_roles(mappings: DataFrame) -> DataFrame:
    """A10: per (table, field): source and/or target role, mappings out and in."""
    out_side = mappings.select(F.col("source_table").alias("table_name"), F.col("source_field").alias("field_name"),
                               F.lit(1).alias("_out"), F.lit(0).alias("_in"))
    in_side = mappings.select(F.col("dest_table").alias("table_name"), F.col("dest_field").alias("field_name"),
                              F.lit(0).alias("_out"), F.lit(1).alias("_in"))
    return out_side.unionByName(in_side).groupBy("table_name", "field_name").agg(
        (F.sum("_out") > 0).alias("is_source"),
        (F.sum("_in") > 0).alias("is_target"),
        F.sum("_out").cast("long").alias("mappings_out"),
        F.sum("_in").cast("long").alias("mappings_in"),
    )


def neighbour_counts(mappings: DataFrame) -> DataFrame:
    """Distinct upstream and downstream table counts per table."""
    e = table_edges(mappings)
    down = e.groupBy(F.col("source_table").alias("table_name")).agg(
        F.count(F.lit(1)).cast("long").alias("downstream_count"))
    up = e.groupBy(F.col("dest_table").alias("table_name")).agg(
        F.count(F.lit(1)).cast("long").alias("upstream_count"))
    return up.join(down, "table_name", "full_outer")


def graph_nodes(v1: DataFrame, v2: DataFrame | None, catalog: DataFrame | None) -> DataFrame:
    """Per table of either version: layer, catalog columns, neighbour counts.

    Neighbour counts come from V2 when present, else V1 (as the viewer does).
    """
    tables = all_tables(v1, v2)
    counts = neighbour_counts(v2 if v2 is not None else v1)
    out = tables.join(counts, "table_name", "left")
    if catalog is not None:
        cols = catalog.groupBy("table_name").agg(
            F.count(F.lit(1)).cast("long").alias("column_count"),
            F.count_if(F.col("is_pk")).cast("long").alias("pk_count"),
            F.count_if(F.col("is_fk")).cast("long").alias("fk_count"))
        out = out.join(cols, "table_name", "left")
    else:
        out = out.withColumns({"column_count": F.lit(None).cast("long"), "pk_count": F.lit(None).cast("long"),
                               "fk_count": F.lit(None).cast("long")})
    return out.select(
        "table_name", table_layer("table_name").alias("layer"),
        F.coalesce("column_count", F.lit(0)).cast("long").alias("column_count"),
        F.coalesce("pk_count", F.lit(0)).cast("long").alias("pk_count"),
        F.coalesce("fk_count", F.lit(0)).cast("long").alias("fk_count"),
        F.coalesce("upstream_count", F.lit(0)).cast("long").alias("upstream_count"),
        F.coalesce("downstream_count", F.lit(0)).cast("long").alias("downstream_count"),
    )


def objects_index(mappings: DataFrame) -> DataFrame:
    """Mappings per object; blank and 'nan' object names skipped."""
    return (mappings.where(~F.col("object_name").isin("", "nan"))
            .groupBy("object_name").agg(F.count(F.lit(1)).cast("long").alias("mapping_count")))


def object_profile(mappings: DataFrame) -> DataFrame:
    """Per object: mapping count, distinct source and target tables."""
    return (mappings.where(~F.col("object_name").isin("", "nan"))
            .groupBy("object_name").agg(
                F.count(F.lit(1)).cast("long").alias("mapping_count"),
                F.count_distinct("source_table").cast("long").alias("source_table_count"),
                F.count_distinct("dest_table").cast("long").alias("target_table_count")))


def object_targets(mappings: DataFrame) -> DataFrame:
    """Mappings of each object grouped by target table."""
    return (mappings.where(~F.col("object_name").isin("", "nan"))
            .groupBy("object_name", "dest_table").agg(F.count(F.lit(1)).cast("long").alias("mapping_count")))


def unmapped_columns(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog columns that no mapping reads or fills, one row each."""
    cat = catalog.select("table_name", F.col("column_name").alias("field_name"), "is_pk", "is_fk")
    return cat.join(mapped_fields(mappings), ["table_name", "field_name"], "left_anti")


def table_profile(mappings: DataFrame, catalog: DataFrame, v1: DataFrame | None = None) -> DataFrame:
    """Per table: neighbours, mapped fields with PK/FK flags, number of
    other catalog columns (``unmapped_columns`` lists them)."""
    tables = all_tables(*(x for x in (v1, mappings) if x is not None))
    fields = mapped_fields(mappings)
    cat = catalog.select(F.col("table_name"), F.col("column_name").alias("field_name"), "is_pk", "is_fk")
    mapped = fields.join(cat, ["table_name", "field_name"], "left").groupBy("table_name").agg(
        F.count(F.lit(1)).cast("long").alias("mapped_field_count"),
        F.count_if(F.coalesce("is_pk", F.lit(False))).cast("long").alias("mapped_pk_count"),
        F.count_if(F.coalesce("is_fk", F.lit(False))).cast("long").alias("mapped_fk_count"))
    others = unmapped_columns(mappings, catalog).groupBy("table_name").agg(
        F.count(F.lit(1)).cast("long").alias("other_column_count"))
    out = (tables.join(neighbour_counts(mappings), "table_name", "left")
           .join(mapped, "table_name", "left").join(others, "table_name", "left"))
    return out.select(
        "table_name",
        F.coalesce("upstream_count", F.lit(0)).cast("long").alias("upstream_count"),
        F.coalesce("downstream_count", F.lit(0)).cast("long").alias("downstream_count"),
        F.coalesce("mapped_field_count", F.lit(0)).cast("long").alias("mapped_field_count"),
        F.coalesce("mapped_pk_count", F.lit(0)).cast("long").alias("mapped_pk_count"),
        F.coalesce("mapped_fk_count", F.lit(0)).cast("long").alias("mapped_fk_count"),
        F.coalesce("other_column_count", F.lit(0)).cast("long").alias("other_column_count"),
    )


def table_list(v1: DataFrame, v2: DataFrame | None = None) -> DataFrame:
    """Tables sorted by name with layer and mapped-field count (graph = V2 else V1)."""
    g = v2 if v2 is not None else v1
    counts = mapped_fields(g).groupBy("table_name").agg(F.count(F.lit(1)).cast("long").alias("mapped_field_count"))
    return (all_tables(v1, v2).join(counts, "table_name", "left")
            .select("table_name", table_layer("table_name").alias("layer"),
                    layer_order(table_layer("table_name")).alias("layer_order"),
                    F.coalesce("mapped_field_count", F.lit(0)).cast("long").alias("mapped_field_count"))
            .orderBy("table_name"))


def edge_profile(mappings: DataFrame) -> DataFrame:
    """Mappings of table edges with type (blank -> MAP) and rule ('nan' -> '')."""
    return mappings.select(
        "source_table", "dest_table", "source_field", "dest_field",
        F.when(F.col("mapping_type") == "", "MAP").otherwise(F.col("mapping_type")).alias("mapping_type"),
        F.when(F.col("rules") == "nan", "").otherwise(F.col("rules")).alias("rule"),
        mapping_class("mapping_type").alias("mapping_class"),
        F.when(F.col("object_name").isin("", "nan"), "").otherwise(F.col("object_name")).alias("object_name"),
    )


def direct_only(mappings: DataFrame) -> DataFrame:
    """Mappings whose type is MAP, MAPPING or blank (NULL counts as MAP)."""
    return mappings.where(F.upper(F.coalesce("mapping_type", F.lit("MAP"))).isin(DIRECT_TYPES))


def preview_fields(mappings: DataFrame, k: int = PREVIEW_FIELDS) -> DataFrame:
    """First ``k`` mapped fields per table (by name) and how many more.

    The ``row_number() <= k`` filter becomes a partial window group limit
    before the shuffle, and the totals are a partial aggregation, so a table
    with millions of fields never lands whole in one task.
    """
    fields = mapped_fields(mappings)
    w = Window.partitionBy("table_name").orderBy("field_name")
    top = fields.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    totals = fields.groupBy("table_name").agg(F.count(F.lit(1)).cast("long").alias("_n"))
    return top.join(totals, "table_name").select(
        "table_name", "field_name", F.col("position").cast("long").alias("position"),
        F.greatest(F.col("_n") - k, F.lit(0)).cast("long").alias("more_count"))


# ----------------------------------------------------------------------------
# search
# ----------------------------------------------------------------------------


def search_index(v1: DataFrame, v2: DataFrame | None = None) -> DataFrame:
    """Tables, ``TABLE.FIELD`` of mapped fields, objects with mapping count.

    ``ord_kind`` 0/1/2 and the names give the index order (table before its
    fields, objects last).
    """
    g = v2 if v2 is not None else v1
    tables = all_tables(v1, v2).select(
        F.lit("table").alias("kind"), "table_name", F.lit(None).cast("string").alias("field_name"),
        F.lit(None).cast("string").alias("object_name"), F.col("table_name").alias("display"),
        F.lit(None).cast("long").alias("mapping_count"), F.lit(0).alias("ord_kind"))
    fields = mapped_fields(g).select(
        F.lit("field").alias("kind"), "table_name", "field_name", F.lit(None).cast("string").alias("object_name"),
        F.concat_ws(".", "table_name", "field_name").alias("display"),
        F.lit(None).cast("long").alias("mapping_count"), F.lit(1).alias("ord_kind"))
    objects = objects_index(g).select(
        F.lit("object").alias("kind"), F.lit(None).cast("string").alias("table_name"),
        F.lit(None).cast("string").alias("field_name"), "object_name", F.col("object_name").alias("display"),
        "mapping_count", F.lit(2).alias("ord_kind"))
    return tables.unionByName(fields).unionByName(objects).withColumn("search_text", F.lower("display"))


def all_names(*versions: DataFrame) -> DataFrame:
    """Every object name and every field name of both ends, of each version, as ``term`` (repeats kept)."""
    out = None
    for v in versions:
        if v is None:
            continue
        part = v.select(F.explode(F.array("object_name", "source_field", "dest_field")).alias("term"))
        out = part if out is None else out.unionByName(part)
    return out


def _terms_hit(text_col, terms: list[str]):
    arr = F.array(*[F.lit(t.lower().strip()) for t in terms])
    return F.filter(arr, lambda t: (t != "") & F.lower(text_col).contains(t))


def search(index: DataFrame, terms: list[str], limit: int = SEARCH_LIMIT) -> DataFrame:
    """T4: per term, the first ``limit`` index entries containing it.

    The terms are a user-given list, matched as an array expression per
    index row (map-only, no join); the per-term top-``limit`` is a window
    group limit, applied partially before the shuffle.
    """
    return _top(index.withColumn("term", F.explode(_terms_hit(F.col("search_text"), terms))), limit)


def search_terms(index: DataFrame, terms: DataFrame, by: SubstringIndex, limit: int = SEARCH_LIMIT) -> DataFrame:
    """T4 for a table of terms (``term``) through a substring index of the
    entries' ``search_text``: terms read the list of their first characters, not
    every entry."""
    return _top(index.join(by.lookup(terms).withColumnRenamed("text", "search_text"), "search_text"), limit)


def _top(hits: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("term").orderBy(
        F.when(F.col("kind") == "object", 1).otherwise(0), F.coalesce("table_name", "object_name"),
        "ord_kind", F.coalesce("field_name", F.lit("")))
    return (hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("term", F.col("rank").cast("long").alias("rank"), "kind", "display", "table_name",
                    "field_name", "object_name", "mapping_count"))


def filter_tables(v1: DataFrame, v2: DataFrame | None, terms: list[str]) -> DataFrame:
    """Per term, tables whose name or a mapped field contains it.

    ``matching_field_count`` counts mapped fields containing the term;
    ``table_match`` tells whether the name itself matched.
    """
    g = v2 if v2 is not None else v1
    tables = all_tables(v1, v2)
    name_hits = tables.select("table_name", F.explode(_terms_hit(F.col("table_name"), terms)).alias("term"))
    field_hits = (mapped_fields(g).select("table_name", F.explode(_terms_hit(F.col("field_name"), terms)).alias("term"))
                  .groupBy("table_name", "term").agg(F.count(F.lit(1)).cast("long").alias("matching_field_count")))
    hits = name_hits.withColumn("table_match", F.lit(True)).join(field_hits, ["table_name", "term"], "full_outer")
    return hits.select("term", "table_name", F.coalesce("table_match", F.lit(False)).alias("table_match"),
                       F.coalesce("matching_field_count", F.lit(0)).cast("long").alias("matching_field_count"))


# ----------------------------------------------------------------------------
# traversal
# ----------------------------------------------------------------------------


def _field_graph(mappings: DataFrame, upstream: bool) -> DataFrame:
    if upstream:  # walk dest -> source
        return mappings.select(F.col("dest_table").alias("src_t"), F.col("dest_field").alias("src_f"),
                               F.col("source_table").alias("dst_t"), F.col("source_field").alias("dst_f"))
    return mappings.select(F.col("source_table").alias("src_t"), F.col("source_field").alias("src_f"),
                           F.col("dest_table").alias("dst_t"), F.col("dest_field").alias("dst_f"))


def trace_fields(spark: SparkSession, mappings: DataFrame, seeds: DataFrame, upstream: bool = True,
                 max_rounds: int | None = None) -> DataFrame:
    """G1: all field mappings upstream (or downstream) of each seed (table, field).

    ``seeds`` has ``seed_table``, ``seed_field``.  A mapping belongs to the
    upstream trace when its destination field is reached from the seed (the
    seed included), to the downstream trace when its source field is.  Each
    mapping is reported once per seed with the hop at which it is met.

    Seeds that lead to one field only have that field's trace, a hop further, and
    their own mappings: such fields are walked from once, for all of their seeds.
    """
    cols = ["seed_table", "seed_field"]
    s = seeds.select(*cols).distinct()
    graph = _field_graph(mappings, upstream)
    kt, kf = ("dest_table", "dest_field") if upstream else ("source_table", "source_field")
    m = mappings.select("source_table", "source_field", "dest_table", "dest_field", "rules", "mapping_type",
                        "object_name")

    def walked(starts: DataFrame, rounds: int | None) -> DataFrame:
        begin = starts.select(*cols, F.col("seed_table").alias("t"), F.col("seed_field").alias("f"))
        nodes = reach(spark, graph, begin, ["t", "f"], cols, max_rounds=rounds)
        return nodes.join(m, (nodes["t"] == m[kt]) & (nodes["f"] == m[kf])).select(
            *cols, *m.columns, F.col("hop").cast("long").alias("hop"))

    if max_rounds is not None and max_rounds < 1:
        return walked(s, max_rounds)
    to = F.struct("dst_t", "dst_f")
    known = F.col("src_t").isNotNull() & F.col("src_f").isNotNull()
    onward = graph.where(known).groupBy(F.col("src_t").alias("seed_table"), F.col("src_f").alias("seed_field")) \
        .agg(F.min(to).alias("_to"), F.max(to).alias("_last"))
    at = RoundState(spark).keep(s.join(onward, cols, "left").select(
        *cols, F.when((F.col("_to") == F.col("_last")) & F.col("_to.dst_t").isNotNull() & F.col("_to.dst_f").isNotNull(),
                      F.col("_to")).alias("_to")))
    single = at.where("_to is not null").select(*cols, F.col("_to.dst_t").alias("_t"), F.col("_to.dst_f").alias("_f"))
    rest = walked(at.where("_to is null").select(*cols), max_rounds)
    far = walked(single.select(F.col("_t").alias("seed_table"), F.col("_f").alias("seed_field")).distinct(),
                 None if max_rounds is None else max_rounds - 1).withColumnsRenamed({"seed_table": "_t", "seed_field": "_f"})
    # a seed that its own trace comes back to has its mappings at hop 0
    back = (F.col("seed_table") == F.col(kt)) & (F.col("seed_field") == F.col(kf))
    behind = single.join(far, ["_t", "_f"]).where(~F.coalesce(back, F.lit(False))).select(
        *cols, *m.columns, (F.col("hop") + 1).alias("hop"))
    own = single.select(*cols).join(m, (F.col("seed_table") == m[kt]) & (F.col("seed_field") == m[kf])).select(
        *cols, *m.columns, F.lit(0).cast("long").alias("hop"))
    return rest.unionByName(own).unionByName(behind)


def trace_objects(spark: SparkSession, mappings: DataFrame, objects: DataFrame | None = None,
                  up: bool = True, down: bool = True) -> DataFrame:
    """Each object's own mappings (flagged) plus upstream of their sources
    and downstream of their targets; one row per (object, mapping)."""
    own = mappings.where(~F.col("object_name").isin("", "nan"))
    if objects is not None:
        own = own.join(objects.select("object_name").distinct(), "object_name", "left_semi")
    cols = ["source_table", "source_field", "dest_table", "dest_field", "rules", "mapping_type", "object_name"]
    m = mappings.select(*cols)
    parts = [own.select(F.col("object_name").alias("traced_object"), *cols, F.lit(True).alias("is_object_mapping"))]
    if up:
        seeds = own.select(F.col("object_name").alias("traced_object"), F.col("source_table").alias("t"),
                           F.col("source_field").alias("f"))
        nodes = reach(spark, _field_graph(mappings, True), seeds, ["t", "f"], ["traced_object"])
        parts.append(nodes.join(m, (nodes["t"] == m["dest_table"]) & (nodes["f"] == m["dest_field"]))
                     .select("traced_object", *cols, F.lit(False).alias("is_object_mapping")))
    if down:
        seeds = own.select(F.col("object_name").alias("traced_object"), F.col("dest_table").alias("t"),
                           F.col("dest_field").alias("f"))
        nodes = reach(spark, _field_graph(mappings, False), seeds, ["t", "f"], ["traced_object"])
        parts.append(nodes.join(m, (nodes["t"] == m["source_table"]) & (nodes["f"] == m["source_field"]))
                     .select("traced_object", *cols, F.lit(False).alias("is_object_mapping")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("traced_object", *cols).agg(F.max("is_object_mapping").alias("is_object_mapping"))


def field_index(spark: SparkSession, mappings: DataFrame, upstream: bool = True) -> ReachIndex:
    """Reach index of the fields of a mapping table in one direction, for any
    number of selections (``trace_selection``, ``object_selection``)."""
    return build(spark, _field_graph(mappings, upstream), ["t", "f"])


def field_indexes(spark: SparkSession, mappings: DataFrame) -> tuple[ReachIndex, ReachIndex]:
    """``field_index`` upstream and downstream, of one pass over the graph."""
    down, up = build_both(spark, _field_graph(mappings, False), ["t", "f"])
    return up, down


def _mappings_at(nodes: DataFrame, mappings: DataFrame, seed_cols: list[str], upstream: bool) -> DataFrame:
    """The mappings that enter (upstream) or leave the reached fields."""
    m = mappings.select("source_table", "source_field", "dest_table", "dest_field", "rules", "mapping_type",
                        "object_name")
    kt, kf = ("dest_table", "dest_field") if upstream else ("source_table", "source_field")
    return nodes.join(m, (nodes["t"] == m[kt]) & (nodes["f"] == m[kf])).select(*seed_cols, *m.columns)


def trace_selection(index: ReachIndex, mappings: DataFrame, seeds: DataFrame, upstream: bool = True) -> DataFrame:
    """G1 for selected fields: the rows of ``trace_fields`` without the hop.

    ``seeds`` has ``seed_table``, ``seed_field``; ``index`` is the
    ``field_index`` of ``mappings`` in the same direction.  No rounds: label
    rows of the seeds, the members behind them, and their mappings.  A seed
    that no mapping knows gives no row.
    """
    s = seeds.select("seed_table", "seed_field", F.col("seed_table").alias("t"), F.col("seed_field").alias("f"))
    cols = ["seed_table", "seed_field"]
    return _mappings_at(index.reached(s, cols), mappings, cols, upstream)


def object_selection(up: ReachIndex, down: ReachIndex, mappings: DataFrame, objects: DataFrame) -> DataFrame:
    """G2 for selected objects (``object_name``): the rows of ``trace_objects``
    by the indexes of both directions."""
    cols = ["source_table", "source_field", "dest_table", "dest_field", "rules", "mapping_type", "object_name"]
    own = mappings.where(~F.col("object_name").isin("", "nan")).join(
        objects.select("object_name").distinct(), "object_name", "left_semi")
    name = F.col("object_name").alias("traced_object")
    above = up.reached(own.select(name, F.col("source_table").alias("t"), F.col("source_field").alias("f")),
                       ["traced_object"])
    below = down.reached(own.select(name, F.col("dest_table").alias("t"), F.col("dest_field").alias("f")),
                         ["traced_object"])
    far = _mappings_at(above, mappings, ["traced_object"], True).unionByName(
        _mappings_at(below, mappings, ["traced_object"], False)).withColumn("is_object_mapping", F.lit(False))
    return own.select(name, *cols, F.lit(True).alias("is_object_mapping")).unionByName(far) \
        .groupBy("traced_object", *cols).agg(F.max("is_object_mapping").alias("is_object_mapping"))


def regroup_trace(traced: DataFrame, key_cols=("seed_table", "seed_field")) -> DataFrame:
    """Traced field mappings -> table edges with their mapping count and,
    where the mappings have a ``change_type``, that of the edge's first mapping
    (by field names)."""
    first = [F.min_by("change_type", F.struct("source_field", "dest_field")).alias("change_type")] \
        if "change_type" in traced.columns else []
    return traced.groupBy(*key_cols, "source_table", "dest_table").agg(
        F.count(F.lit(1)).cast("long").alias("mapping_count"), *first)


def neighbourhood(mappings: DataFrame, seeds: DataFrame, up: bool = True, down: bool = True) -> DataFrame:
    """Two-hop table neighbourhood of each seed table.

    First hop: edges leaving (down) or entering (up) the seed.  Second hop:
    edges leaving (down) or entering (up) any first-hop table other than the
    seed, so siblings reached through a shared neighbour are included.
    Returns distinct (seed_table, source_table, dest_table).
    """
    e = table_edges(mappings).persist()
    s = seeds.select("seed_table").distinct()
    parts = []
    first = s.select("seed_table", F.col("seed_table").alias("table_name"))
    if down:
        d1 = s.join(e, s["seed_table"] == e["source_table"]).select("seed_table", "source_table", "dest_table")
        parts.append(d1)
        first = first.unionByName(d1.select("seed_table", F.col("dest_table").alias("table_name")))
    if up:
        u1 = s.join(e, s["seed_table"] == e["dest_table"]).select("seed_table", "source_table", "dest_table")
        parts.append(u1)
        first = first.unionByName(u1.select("seed_table", F.col("source_table").alias("table_name")))
    first = first.distinct().where(F.col("table_name") != F.col("seed_table"))
    if down:
        parts.append(first.join(e, first["table_name"] == e["source_table"])
                     .select("seed_table", "source_table", "dest_table"))
    if up:
        parts.append(first.join(e, first["table_name"] == e["dest_table"])
                     .select("seed_table", "source_table", "dest_table"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def table_depth(spark: SparkSession, mappings: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Longest path (in table edges) from any root to each table.

    Tables are peeled in rounds: a table gets its depth, one more than its
    deepest source, once all of its sources have theirs.  Roots are tables
    with no incoming edge.  Tables on a cycle or behind one are never peeled;
    they are entered from the peeled part (one more than their deepest peeled
    source) and take from there the least number of further edges, so their
    depth depends on the tables before them only.  Tables that no root
    reaches, and all tables where there is no root, get 0.

    A round is one aggregation of the edges that leave the tables of the last
    round; there are as many as the longest path has tables, and one more.
    """
    state = RoundState(spark)
    e = state.keep(table_edges(mappings).where(F.col("source_table") != F.col("dest_table")))
    tables = state.keep((nodes if nodes is not None else all_tables(mappings)).select("table_name").distinct())
    # a table that only feeds itself is no root (no depth), and waits for no other
    own = table_edges(mappings).where(F.col("source_table") == F.col("dest_table")).select(
        F.col("dest_table").alias("table_name"), F.lit(True).alias("own"))
    waits = e.groupBy(F.col("dest_table").alias("table_name")).agg(F.count(F.lit(1)).alias("open"))
    rest = state.keep(tables.join(waits, "table_name", "left").join(own, "table_name", "left").select(
        "table_name", F.coalesce("open", F.lit(0)).cast("long").alias("open"),
        F.when(F.col("open").isNull() & F.col("own").isNull(), 0).cast("long").alias("depth"),
        F.col("own").isNotNull().alias("own")))
    front, rest = rest.where("open = 0"), rest.where("open > 0")
    done = [front.select("table_name", "depth")]
    while not front.isEmpty():
        seen = front.join(e, front["table_name"] == e["source_table"]).groupBy(F.col("dest_table").alias("table_name")) \
            .agg(F.count(F.lit(1)).alias("n"), (F.max("depth") + 1).alias("cand"))
        moved = state.keep(rest.join(seen, "table_name", "left").select(
            "table_name", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"),
            F.greatest("depth", "cand").alias("depth"), "own"))
        front, rest = moved.where("open = 0"), moved.where("open > 0")
        done.append(front.select("table_name", "depth"))
    # on or behind a cycle: breadth first from the tables with a peeled source
    front = rest.where("depth is not null").select("table_name", "depth")
    left = rest.where("depth is null").select("table_name")
    while not front.isEmpty():
        done.append(front)
        step = front.join(e, front["table_name"] == e["source_table"]).groupBy(F.col("dest_table").alias("table_name")) \
            .agg((F.min("depth") + 1).alias("depth"))
        moved = state.keep(left.join(step, "table_name", "left"))
        front, left = moved.where("depth is not null"), moved.where("depth is null").select("table_name")
    depth = done[0]
    for d in done[1:]:
        depth = depth.unionByName(d)
    return tables.join(depth, "table_name", "left").select(
        "table_name", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def depth_layers(depths: DataFrame) -> DataFrame:
    """Tables grouped by depth: each table's position in its layer (by
    name) and the layer size, numbered without collecting a layer."""
    return ordered_index(depths, ["depth"], ["table_name"], index_col="layer_position", size_col="layer_size")


def leaf_fields(mappings: DataFrame) -> DataFrame:
    """Seed helper: destination fields of tables that feed no other table."""
    sources = mappings.select(F.col("source_table").alias("dest_table")).distinct()
    return (mappings.join(sources, "dest_table", "left_anti")
            .select(F.col("dest_table").alias("seed_table"), F.col("dest_field").alias("seed_field")).distinct())


def root_fields(mappings: DataFrame) -> DataFrame:
    """Seed helper: source fields of tables that no other table feeds."""
    targets = mappings.select(F.col("dest_table").alias("source_table")).distinct()
    return (mappings.join(targets, "source_table", "left_anti")
            .select(F.col("source_table").alias("seed_table"), F.col("source_field").alias("seed_field")).distinct())
