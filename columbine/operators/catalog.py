"""Scope catalog operators.

A SQL statement's scope tree arrives as tables, one row per item, all keyed
by ``stmt_id`` first:

``scopes(stmt_id, scope_id, parent_id, scope_name, kind, branch_ord)``
  kind: ROOT | SUBQUERY | CTE | UNION | UNION_BRANCH | SCALAR | USING | INSERT_SELECT
``relations(stmt_id, scope_id, ord, alias, rel_kind, table_name, child_scope_id)``
  rel_kind: PHYSICAL (table_name) or SCOPE (child_scope_id)
``projections(stmt_id, scope_id, ord, output_name, expression[, origin_alias])``

All joins below carry ``stmt_id`` in their keys, so statements are
independent and the work spreads over statements; one statement's tree is
bounded by its SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from columbine.operators.closure import reach


def with_defaults(scopes: DataFrame) -> DataFrame:
    cols = set(scopes.columns)
    extra = {}
    if "kind" not in cols:
        extra["kind"] = F.when(F.col("parent_id").isNull(), "ROOT").otherwise("SUBQUERY")
    if "branch_ord" not in cols:
        extra["branch_ord"] = F.lit(None).cast("int")
    return scopes.withColumns(extra) if extra else scopes


def scope_closure(spark: SparkSession, scopes: DataFrame) -> DataFrame:
    """Every scope with each of its ancestors (itself at distance 0).

    Returns (stmt_id, scope_id, ancestor_id, distance).  Built by the shared
    frontier loop over child -> parent edges; rounds = deepest nesting.
    """
    edges = scopes.where(F.col("parent_id").isNotNull()).select(
        F.col("stmt_id").alias("src_stmt_id"), F.col("scope_id").alias("src_scope_id"),
        F.col("stmt_id").alias("dst_stmt_id"), F.col("parent_id").alias("dst_scope_id"))
    seeds = scopes.select(F.col("scope_id").alias("from_scope"), "stmt_id", "scope_id")
    r = reach(spark, edges, seeds, ["stmt_id", "scope_id"], ["from_scope"])
    return r.select("stmt_id", F.col("from_scope").alias("scope_id"), F.col("scope_id").alias("ancestor_id"),
                    F.col("hop").cast("int").alias("distance"))


def cte_name(scope_name_col) -> F.Column:
    """Name of a CTE scope: the last component of its scope name."""
    return F.upper(F.regexp_extract(scope_name_col, r"([^/:]+)$", 1))


def nearest_cte(relations: DataFrame, scopes: DataFrame, closure: DataFrame) -> DataFrame:
    """Physical relations whose table name is a CTE visible from their
    scope become SCOPE relations of the nearest such CTE (innermost first)."""
    ctes = scopes.where(F.col("kind") == "CTE").select(
        "stmt_id", F.col("parent_id").alias("ancestor_id"), F.col("scope_id").alias("cte_scope_id"),
        cte_name(F.col("scope_name")).alias("cte"))
    phys = relations.where(F.col("rel_kind") == "PHYSICAL")
    cand = (phys.join(closure, ["stmt_id", "scope_id"])
            .join(ctes, ["stmt_id", "ancestor_id"])
            .where(F.upper("table_name") == F.col("cte")))
    w = Window.partitionBy("stmt_id", "scope_id", "ord").orderBy("distance")
    best = (cand.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("stmt_id", "scope_id", "ord", "cte_scope_id"))
    out = relations.join(best, ["stmt_id", "scope_id", "ord"], "left")
    return out.select(
        "stmt_id", "scope_id", "ord", "alias",
        F.when(F.col("cte_scope_id").isNotNull(), "SCOPE").otherwise(F.col("rel_kind")).alias("rel_kind"),
        F.when(F.col("cte_scope_id").isNotNull(), F.lit(None)).otherwise(F.col("table_name")).alias("table_name"),
        F.coalesce("cte_scope_id", "child_scope_id").alias("child_scope_id"),
        *[c for c in relations.columns if c not in
          ("stmt_id", "scope_id", "ord", "alias", "rel_kind", "table_name", "child_scope_id")])


def nested_scopes(spark: SparkSession, relations: DataFrame) -> DataFrame:
    """Scopes that a scope reads through its relations, at any depth:
    (stmt_id, scope_id, desc_id, sub_dist >= 1).  CTE bodies that nothing
    reads and subqueries outside FROM are not among them."""
    reads = relations.where((F.col("rel_kind") == "SCOPE") & F.col("child_scope_id").isNotNull())
    edges = reads.select(F.col("stmt_id").alias("src_stmt_id"), F.col("scope_id").alias("src_scope_id"),
                         F.col("stmt_id").alias("dst_stmt_id"), F.col("child_scope_id").alias("dst_scope_id"))
    seeds = reads.select(F.col("scope_id").alias("from_scope"), "stmt_id", "scope_id").distinct()
    found = reach(spark, edges, seeds, ["stmt_id", "scope_id"], ["from_scope"])
    return found.where("hop > 0").select(
        "stmt_id", F.col("from_scope").alias("scope_id"), F.col("scope_id").alias("desc_id"),
        F.col("hop").alias("sub_dist"))


def relations_at(scopes: DataFrame, relations: DataFrame) -> DataFrame:
    """The relation an alias means at a scope before its ancestors are
    asked: (stmt_id, anc_id, alias, rel_kind, table_name, child_scope_id).

    Own relations first (0), then CTEs defined there (1), SCOPE relations of the
    scopes it reads (2), PHYSICAL relations of those (3), and then, for a
    union, the same four at each of its branches in turn (4); nested candidates
    by depth, then scope id, then relation order.  One row per scope and alias,
    reduced before any scope is paired with its ancestors.
    """
    rel = relations.select("stmt_id", F.col("scope_id").alias("at_scope"), "ord", F.upper("alias").alias("alias"),
                           "rel_kind", "table_name", "child_scope_id")
    own = rel.select("*", F.col("at_scope").alias("anc_id"), F.lit(0).alias("cat"), F.lit(0).alias("sub_dist"))
    ctes = scopes.where(F.col("kind") == "CTE").select(
        "stmt_id", F.col("parent_id").alias("at_scope"), F.lit(0).alias("ord"),
        cte_name(F.col("scope_name")).alias("alias"), F.lit("SCOPE").alias("rel_kind"),
        F.lit(None).cast("string").alias("table_name"), F.col("scope_id").alias("child_scope_id"),
        F.col("parent_id").alias("anc_id"), F.lit(1).alias("cat"), F.lit(0).alias("sub_dist"))
    below = nested_scopes(scopes.sparkSession, relations).select(
        "stmt_id", F.col("scope_id").alias("anc_id"), F.col("desc_id").alias("at_scope"), "sub_dist")
    nested = below.join(rel, ["stmt_id", "at_scope"]).select(
        "stmt_id", "at_scope", "ord", "alias", "rel_kind", "table_name", "child_scope_id", "anc_id",
        F.when(F.col("rel_kind") == "SCOPE", 2).otherwise(3).alias("cat"), "sub_dist")
    means = F.struct("rel_kind", "table_name", "child_scope_id")
    keys = ["stmt_id", "anc_id", "alias"]

    def first(df, *rank):
        return df.groupBy(*keys).agg(F.min(F.struct(*rank)).alias("rank"),
                                     F.min_by(means, F.struct(*rank)).alias("means"))

    plain = first(own.unionByName(ctes).unionByName(nested).withColumn("branch", F.lit(-1)),
                  "cat", "branch", F.lit(0).alias("branch_cat"), "sub_dist", "at_scope", "ord", "child_scope_id")
    branches = scopes.where(F.col("kind") == "UNION_BRANCH").select(
        "stmt_id", F.col("scope_id").alias("anc_id"), F.col("parent_id").alias("union_id"),
        F.coalesce("branch_ord", F.lit(0)).alias("branch"))
    r = F.col("rank")
    in_branch = plain.join(branches, ["stmt_id", "anc_id"]).select(
        "stmt_id", F.col("union_id").alias("anc_id"), "alias", F.struct(
            F.lit(4).alias("cat"), "branch", r["cat"].alias("branch_cat"), r["sub_dist"].alias("sub_dist"),
            r["at_scope"].alias("at_scope"), r["ord"].alias("ord"),
            r["child_scope_id"].alias("child_scope_id")).alias("rank"), "means")
    return plain.unionByName(in_branch).groupBy(*keys).agg(F.min_by("means", "rank").alias("m")).select(*keys, "m.*")


def visible_asked(asked: DataFrame, at: DataFrame, closure: DataFrame) -> DataFrame:
    """J4 for the (stmt_id, scope_id, alias) rows of ``asked`` only.

    Each is matched to ``relations_at`` of its scope and of its ancestors in
    turn; the nearest wins.  Rows grow with what is asked and how deep it
    stands, not with the relations that could be seen.  Columns as in
    ``visible_relations``; what nothing answers is absent.
    """
    up = closure.select("stmt_id", "scope_id", F.col("ancestor_id").alias("anc_id"), F.col("distance").alias("level"))
    cand = asked.select("stmt_id", "scope_id", "alias").distinct().join(up, ["stmt_id", "scope_id"]) \
        .join(at, ["stmt_id", "anc_id", "alias"])
    return _nearest(cand)


def _nearest(cand: DataFrame) -> DataFrame:
    return cand.groupBy("stmt_id", "scope_id", "alias").agg(F.min_by(
        F.struct("rel_kind", "table_name", "child_scope_id", "level"), "level").alias("m")) \
        .select("stmt_id", "scope_id", "alias", "m.*")


def visible_relations(scopes: DataFrame, relations: DataFrame, closure: DataFrame) -> DataFrame:
    """Which relation each alias means in each scope: the one of
    ``relations_at`` at the scope itself, else at the nearest ancestor that has
    the alias (``level`` edges up).  All aliases of all scopes; for those
    that references name see ``visible_asked``.
    Returns (stmt_id, scope_id, alias, rel_kind, table_name, child_scope_id, level).
    """
    up = closure.select("stmt_id", "scope_id", F.col("ancestor_id").alias("anc_id"), F.col("distance").alias("level"))
    return _nearest(up.join(relations_at(scopes, relations), ["stmt_id", "anc_id"]))


def exists_relations(relations: DataFrame, exists_tables: DataFrame) -> DataFrame:
    """Tables read inside EXISTS bodies become relations of the outer
    scope unless the alias is already taken there.

    ``exists_tables(stmt_id, scope_id, alias, table_name)``: the outer scope
    and the EXISTS body's table with its alias (or name when unaliased).
    """
    taken = relations.select("stmt_id", "scope_id", F.upper("alias").alias("alias"))
    add = exists_tables.select("stmt_id", "scope_id", F.upper(F.coalesce("alias", "table_name")).alias("alias"),
                               F.upper("table_name").alias("table_name"))
    add = add.dropDuplicates(["stmt_id", "scope_id", "alias"]).join(taken, ["stmt_id", "scope_id", "alias"],
                                                                     "left_anti")
    base = relations.groupBy("stmt_id", "scope_id").agg(F.max("ord").alias("_max"))
    w = Window.partitionBy("stmt_id", "scope_id").orderBy("alias")
    new = (add.join(base, ["stmt_id", "scope_id"], "left")
           .select("stmt_id", "scope_id",
                   (F.coalesce("_max", F.lit(-1)) + F.row_number().over(w)).alias("ord"), "alias",
                   F.lit("PHYSICAL").alias("rel_kind"), "table_name",
                   F.lit(None).cast(relations.schema["child_scope_id"].dataType).alias("child_scope_id")))
    keep = relations.select("stmt_id", "scope_id", "ord", "alias", "rel_kind", "table_name", "child_scope_id")
    return keep.unionByName(new.withColumn("ord", F.col("ord").cast(keep.schema["ord"].dataType)))


def unpivot_columns(projections: DataFrame, unpivots: DataFrame) -> DataFrame:
    """UNPIVOT value and FOR columns become projections
    ``UNPIVOT_VALUE(c)`` / ``UNPIVOT_FOR(c)`` (constants, so they carry no refs).

    ``unpivots(stmt_id, scope_id, value_col, for_col)``.
    """
    base = projections.groupBy("stmt_id", "scope_id").agg(F.max("ord").alias("_max"))
    pairs = unpivots.select(
        "stmt_id", "scope_id",
        F.inline(F.array(
            F.struct(F.lit(1).alias("_k"), F.upper("value_col").alias("output_name"),
                     F.concat(F.lit("UNPIVOT_VALUE("), F.upper("value_col"), F.lit(")")).alias("expression")),
            F.struct(F.lit(2).alias("_k"), F.upper("for_col").alias("output_name"),
                     F.concat(F.lit("UNPIVOT_FOR("), F.upper("for_col"), F.lit(")")).alias("expression")))))
    new = pairs.join(base, ["stmt_id", "scope_id"], "left").select(
        "stmt_id", "scope_id", (F.coalesce("_max", F.lit(-1)) + F.col("_k")).alias("ord"), "output_name",
        "expression")
    keep = projections.select("stmt_id", "scope_id", "ord", "output_name", "expression")
    return keep.unionByName(new.withColumn("ord", F.col("ord").cast(keep.schema["ord"].dataType)))


# Scopes that share a copy of a filled-in select list.
LIST_BLOCK = 64


def _levels(closure: DataFrame) -> DataFrame:
    """Nesting level of every scope (distance to its root)."""
    return closure.groupBy("stmt_id", "scope_id").agg(F.max("distance").alias("level"))


def expand_stars(spark: SparkSession, scopes: DataFrame, relations: DataFrame, projections: DataFrame,
                 dm: DataFrame | None, closure: DataFrame | None = None) -> DataFrame:
    """Expand ``*`` and ``A.*`` select items, innermost scopes first.

    ``projections`` carries ``star_kind`` (NULL | ALL | QUALIFIED) and
    ``star_alias``.  A star over a child scope copies that scope's (already
    expanded) projections with ``origin_alias`` = the alias; over a physical
    table in the data model, its columns by ordinal as ``ALIAS.COL``; over
    any other table, one placeholder ``*_ALIAS`` = ``ALIAS.*``.  ``ALL``
    expands every relation in order; ``QUALIFIED`` the named one.  A later
    item of the same name replaces the value and keeps the first position.
    Rounds = nesting depth, each checkpointed.

    The rounds move select items only: a table of the data model stays one item
    until the end, so their rows are bounded by the SQL texts.  Select lists that
    agree in every item are then filled in once, and the scopes that have a list
    are joined to its columns, ``LIST_BLOCK`` scopes at a time; the rows returned
    (scopes times columns) are neither shuffled nor kept, but a filled-in list is:
    where every scope has a list of its own, that is as much as the result.

    Returns (stmt_id, scope_id, ord, output_name, expression, origin_alias).
    """
    from columbine.session import RoundState

    keep = RoundState(spark).keep
    closure = closure if closure is not None else scope_closure(spark, scopes)
    lv = _levels(closure)
    rel = relations.select("stmt_id", "scope_id", F.col("ord").alias("rel_ord"), F.upper("alias").alias("alias"),
                           "rel_kind", F.upper("table_name").alias("table_name"), "child_scope_id")
    if "origin_alias" not in projections.columns:
        projections = projections.withColumn("origin_alias", F.lit(None).cast("string"))
    p = projections.select(
        "stmt_id", "scope_id", F.col("ord").cast("long").alias("ord"), F.array().cast("array<bigint>").alias("sub"),
        F.upper("output_name").alias("output_name"), "expression", "origin_alias", F.lit(None).cast("string").alias("dm_table"),
        F.upper("star_kind").alias("star_kind"), F.upper("star_alias").alias("star_alias"))
    p = keep(p.join(lv, ["stmt_id", "scope_id"]))
    dmc = (dm.select(F.upper("table_name").alias("dm_table"), F.upper("column_name").alias("column_name"),
                     F.col("ordinal").cast("long").alias("ordinal")) if dm is not None else None)
    in_dm = (keep(rel.select("table_name").distinct().join(dmc.select(F.col("dm_table").alias("table_name")), "table_name", "left_semi")
                  .withColumn("_in", F.lit(True))) if dm is not None else None)
    max_level = lv.agg(F.max("level")).first()[0] or 0
    for level in range(max_level, -1, -1):
        stars = p.where((F.col("level") == level) & F.col("star_kind").isNotNull()).drop("dm_table")
        targets = stars.join(rel, ["stmt_id", "scope_id"]).where(
            (F.col("star_kind") == "ALL") | (F.col("alias") == F.col("star_alias")))
        done = p.where(F.col("star_kind").isNull()).select(
            "stmt_id", F.col("scope_id").alias("child_scope_id"), F.col("output_name").alias("c_name"),
            F.col("expression").alias("c_expr"), F.col("ord").alias("c_ord"), F.col("sub").alias("c_sub"), "dm_table")
        from_scope = targets.where(F.col("rel_kind") == "SCOPE").join(done, ["stmt_id", "child_scope_id"]).select(
            "stmt_id", "scope_id", "ord",
            F.concat(F.array(F.col("rel_ord").cast("long"), F.col("c_ord")), "c_sub").alias("sub"), F.col("c_name").alias("output_name"), F.col("c_expr").alias("expression"),
            F.col("alias").alias("origin_alias"), "dm_table")
        phys = targets.where(F.col("rel_kind") == "PHYSICAL")
        phys = phys.join(in_dm, "table_name", "left") if in_dm is not None else phys.withColumn("_in", F.lit(None).cast("boolean"))
        # of a table in the data model: the alias's prefix, the columns follow at the end
        known = F.col("_in").isNotNull()
        expanded = from_scope.unionByName(phys.select(
            "stmt_id", "scope_id", "ord", F.array(F.col("rel_ord").cast("long")).alias("sub"),
            F.when(~known, F.concat(F.lit("*_"), "alias")).alias("output_name"),
            F.when(known, F.concat("alias", F.lit("."))).otherwise(F.concat("alias", F.lit(".*"))).alias("expression"),
            F.lit(None).cast("string").alias("origin_alias"), F.when(known, F.col("table_name")).alias("dm_table")))
        expanded = expanded.withColumns({"star_kind": F.lit(None).cast("string"),
                                         "star_alias": F.lit(None).cast("string"), "level": F.lit(level)})
        rest = p.where(~((F.col("level") == level) & F.col("star_kind").isNotNull()))
        p = keep(rest.unionByName(expanded.select(*rest.columns)))
    item = F.struct("ord", "sub", "output_name", "expression", "origin_alias", "dm_table")
    scope_lists = p.where(F.col("star_kind").isNull()).groupBy("stmt_id", "scope_id").agg(
        F.array_sort(F.collect_set(item)).alias("items"))
    scope_lists = keep(scope_lists.withColumn("list", F.sha2(F.to_json("items"), 256)))
    copies = scope_lists.groupBy("list").agg(
        F.any_value("items").alias("items"), F.ceil(F.count(F.lit(1)) / F.lit(LIST_BLOCK)).cast("int").alias("blocks"))
    x = copies.select("list", F.inline("items"))
    filled = x.where(F.col("dm_table").isNull())
    if dmc is not None:
        columns = x.where(F.col("dm_table").isNotNull()).join(dmc, "dm_table")
        filled = filled.unionByName(columns.withColumns({
            "sub": F.concat("sub", F.array("ordinal")), "output_name": F.col("column_name"),
            "expression": F.concat("expression", "column_name")}).drop("column_name", "ordinal"))
    per_name = filled.groupBy("list", "output_name").agg(
        F.min(F.struct("ord", "sub")).alias("_first"),
        F.max_by(F.struct("expression", "origin_alias"), F.struct("ord", "sub")).alias("_v"))
    w = Window.partitionBy("list").orderBy("_first")
    once = keep(per_name.select("list", (F.row_number().over(w) - 1).cast("long").alias("ord"), "output_name",
                                "_v.expression", "_v.origin_alias"))
    blocks = copies.select("list", "blocks")
    rows = once.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    scopes_of = scope_lists.select("stmt_id", "scope_id", "list").join(blocks, "list").withColumn(
        "block", F.pmod(F.xxhash64("stmt_id", "scope_id"), F.col("blocks")).cast("int")).drop("blocks")
    return rows.join(scopes_of, ["list", "block"]).select("stmt_id", "scope_id", "ord", "output_name", "expression", "origin_alias")


def merge_union(scopes: DataFrame, relations: DataFrame, projections: DataFrame) -> DataFrame:
    """Output columns of every UNION scope.

    Names and expressions come from the first branch; ``source_refs`` gathers
    the references of the same position in every branch, in branch order,
    first occurrence kept.  An unqualified reference is qualified by the
    branch's first relation that can hold it (a physical table, or a child
    scope projecting the name); texts with blanks or parentheses stay as is.
    Returns (stmt_id, scope_id, pos, output_name, expression, source_refs).
    """
    from columbine.functions.text import column_refs

    br = scopes.where(F.col("kind") == "UNION_BRANCH").select(
        "stmt_id", F.col("parent_id").alias("union_id"), F.col("scope_id").alias("branch_id"),
        F.coalesce("branch_ord", F.lit(0)).alias("branch_ord"))
    w = Window.partitionBy("stmt_id", "scope_id").orderBy("ord")
    bp = (projections.withColumn("pos", F.row_number().over(w) - 1)
          .join(br.withColumnRenamed("branch_id", "scope_id"), ["stmt_id", "scope_id"]))
    refs = bp.select("stmt_id", "union_id", "scope_id", "branch_ord", "pos",
                     F.posexplode(column_refs("expression")).alias("ref_pos", "ref"))
    rel = relations.select("stmt_id", "scope_id", F.col("ord").alias("rel_ord"), F.upper("alias").alias("alias"),
                           "rel_kind", F.upper("table_name").alias("table_name"), "child_scope_id")
    child_names = projections.select("stmt_id", F.col("scope_id").alias("child_scope_id"),
                                     F.upper("output_name").alias("ref"), F.lit(True).alias("_has"))
    plain = refs.where(~F.col("ref").contains(".") & ~F.col("ref").rlike(r"[ ()\n\r\t]"))
    cand = (plain.join(rel, ["stmt_id", "scope_id"])
            .join(child_names, ["stmt_id", "child_scope_id", "ref"], "left")
            .where((F.col("rel_kind") == "PHYSICAL") | F.col("_has").isNotNull())
            .groupBy("stmt_id", "scope_id", "pos", "ref_pos", "ref")
            .agg(F.min_by(F.when(F.col("rel_kind") == "PHYSICAL", F.col("table_name")).otherwise(F.col("alias")),
                          "rel_ord").alias("_q")))
    q = (refs.join(cand, ["stmt_id", "scope_id", "pos", "ref_pos", "ref"], "left")
         .withColumn("qualified", F.when(F.col("_q").isNotNull(), F.concat("_q", F.lit("."), "ref"))
                     .otherwise(F.col("ref"))))
    firsts = q.groupBy("stmt_id", "union_id", "pos", "qualified").agg(
        F.min(F.struct("branch_ord", "ref_pos")).alias("_k"))
    srcs = firsts.groupBy("stmt_id", "union_id", "pos").agg(
        F.array_sort(F.collect_list(F.struct("_k", "qualified"))).alias("_s"))
    first_branch = br.withColumn("_r", F.row_number().over(
        Window.partitionBy("stmt_id", "union_id").orderBy("branch_ord"))).where("_r = 1")
    names = bp.join(first_branch.select("stmt_id", "union_id", F.col("branch_id").alias("scope_id")),
                    ["stmt_id", "union_id", "scope_id"]).select(
        "stmt_id", "union_id", "pos", F.upper("output_name").alias("output_name"), "expression")
    return (names.join(srcs, ["stmt_id", "union_id", "pos"], "left")
            .select("stmt_id", F.col("union_id").alias("scope_id"), F.col("pos").cast("long").alias("pos"),
                    "output_name", "expression",
                    F.array_join(F.transform(F.coalesce("_s", F.array()), lambda x: x["qualified"]), ",")
                    .alias("source_refs")))
