"""Column resolution over the scope catalog.

Resolution works on *nodes*, each resolved once however often it is read:

* **Discovery** walks rounds over new nodes (stmt_id, scope_id, mode, ref) of
  all statements at once.  The rules below turn a node into edges: results, or
  further nodes, in numbered groups where one result excludes another.
* **Choice** is a bottom-up fixpoint over the nodes of statements that have such
  groups: a node's first group with a result (or whose first result is
  resolved) is taken.
* **Expansion** walks the chosen edges from the seeds.  Rows that agree are one
  row with a multiplicity, so an expression that reads a column twice, twelve
  levels deep, is a dozen rows until the results are written out.  The path of
  scopes is put together here, as are the guards that depend on it.

Modes and rules (first that applies):

``R`` a reference ``R`` read in scope ``S``:

1. constant -> CONSTANT;  ``X.NEXTVAL`` / ``X.CURRVAL`` -> SEQUENCE.
2. ``A.C``: A by visible relations (J4); none -> ALIAS_NOT_FOUND;
   physical -> PHYSICAL (with DM match); the scope itself -> a physical table
   of that alias in the scope or below it, else its own projection C, else
   MISSING_PROJECTION; a union scope -> every branch's projection C by name,
   else by the first branch's position of C; a scope with projection C -> that
   expression in it; else ``M``.
3. ``C``: a union scope -> per branch: by name, by position, else C itself in
   the branch keeping resolved results only; own projection C that is not an
   identity -> its expression; an identity -> the first child scope projecting C
   (``origin_alias`` first) whose descent ``I`` gives a result or, with no child
   scopes, every physical relation; no own projection -> every child scope
   projecting C, else physical relations whose DM has C, else the parent
   scope, else COLUMN_NOT_FOUND.

``M`` a qualified reference that scope T does not project: the first scope below
T in depth-first order (relations, then union branches) that projects C; else
T's star placeholders (``S``); else T's first physical relation; else
MISSING_PROJECTION.
``S`` star placeholders ``*_X`` of a scope in turn: X physical -> PHYSICAL; X a
scope -> C read in it, if that is resolved; X no relation here, so the
placeholder was copied with a star -> ``S`` in the scope it came from.
``I`` identity descent into a scope, at most ``DESCENT`` levels: the references
(``J``) of its projection C; without one, the first child projecting C with a
result.  An unqualified reference prefers child scopes over physical tables.
``B`` as ``R`` in a branch that its union asks: the way up would lead back to the
union, so it ends in CYCLE_DETECTED (and the union goes on with rule 3).
``E`` an own projection.  An expression with scalar subqueries (``scalars``)
reads the subquery's select list inside and its other aliases outside (J10).

Guards: a node read again on a path since the last scope was entered by its
alias -> CYCLE_DETECTED; a path of more than ``max_depth`` scopes ->
DEPTH_GUARD.

Scale: nodes, edges and paths are keyed by ``stmt_id``; every step is an
equi-join, so statements spread over the cluster and no statement's tree is
ever collected.  Each round is checkpointed (``columbine.session.RoundState``).
Searches below a scope (``M``) start only for references that need them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from columbine.functions.text import column_refs, is_constant, normalize_identifier, normalize_ws, py_strip
from columbine.operators.catalog import relations_at, scope_closure, visible_asked, with_defaults
from columbine.session import RoundState

MAX_DEPTH = 50

# Levels of an identity descent below its first scope.
DESCENT = 10
KEY = ["stmt_id", "scope_id", "mode", "ref"]
_PARTS = "array<struct<scope_id: bigint, mode: string, ref: string, add: array<string>>>"


def _null(t="string"):
    return F.lit(None).cast(t)


def _clean(ref):
    return F.upper(normalize_ws(ref))


def with_parts(expressions: DataFrame, scalars: DataFrame | None = None, projections: DataFrame | None = None,
               relations: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """``expressions`` (stmt_id, scope_id, expression, ...) with ``refs``,
    ``is_const`` and ``parts``: the nodes an expression stands for (scope_id
    null: its own scope).

    ``scalars(stmt_id, scope_id, expression, sub_scope_id, subquery)``: the
    scalar subqueries of an expression, whose scopes are in the catalog.  Their
    projections are read inside (``E``), dotted references whose alias is no
    relation of theirs outside, each as often as it is written.
    """
    plain = F.transform("refs", lambda r: F.struct(
        _null("bigint").alias("scope_id"), F.lit("R").alias("mode"), r.alias("ref"),
        F.array().cast("array<string>").alias("add")))
    out = expressions.withColumns({"refs": F.transform(column_refs(F.coalesce("expression", F.lit(""))), _clean),
                                   "is_const": is_constant(F.coalesce("expression", F.lit("")))})
    if scalars is None:
        return out.withColumn("parts", plain.cast(_PARTS))
    sub = scalars.select("stmt_id", "scope_id", "expression", F.col("sub_scope_id").cast("long").alias("sub_scope_id"), "subquery")
    inside = sub.join(projections.select("stmt_id", F.col("scope_id").cast("long").alias("sub_scope_id"),
                                         F.upper("output_name").alias("ref"), F.col("ord").cast("long").alias("at")),
                      ["stmt_id", "sub_scope_id"]) \
        .join(names.select("stmt_id", F.col("scope_id").cast("long").alias("sub_scope_id"), "scope_name"), ["stmt_id", "sub_scope_id"]) \
        .select("stmt_id", "scope_id", "expression", "sub_scope_id", F.lit(0).alias("side"), "at", F.struct(
            F.col("sub_scope_id").alias("scope_id"), F.lit("E").alias("mode"), "ref", F.array("scope_name").alias("add")).alias("part"))
    own = relations.select("stmt_id", F.col("scope_id").cast("long").alias("sub_scope_id"), F.upper("alias").alias("_alias"))
    outside = sub.select("stmt_id", "scope_id", "expression", "sub_scope_id",
                         F.posexplode(column_refs("subquery")).alias("at", "ref")) \
        .where(F.col("ref").contains(".")).withColumn("_alias", F.split("ref", r"\.", 2)[0]) \
        .join(own, ["stmt_id", "sub_scope_id", "_alias"], "left_anti") \
        .select("stmt_id", "scope_id", "expression", "sub_scope_id", F.lit(1).alias("side"), F.col("at").cast("long").alias("at"),
                F.struct(_null("bigint").alias("scope_id"), F.lit("R").alias("mode"), _clean(F.col("ref")).alias("ref"),
                         F.array().cast("array<string>").alias("add")).alias("part"))
    lists = inside.unionByName(outside).groupBy("stmt_id", "scope_id", "expression").agg(F.array_sort(F.collect_list(
        F.struct("sub_scope_id", "side", "at", "part"))).getField("part").cast(_PARTS).alias("_scalar"))
    return out.join(lists, ["stmt_id", "scope_id", "expression"], "left") \
        .withColumn("parts", F.coalesce("_scalar", plain.cast(_PARTS))) \
        .withColumn("is_const", F.col("is_const") & F.col("_scalar").isNull()).drop("_scalar")


class Catalog:
    """Precomputed look-up tables of a scope catalog (all keyed by stmt_id)."""

    def __init__(self, spark: SparkSession, scopes: DataFrame, relations: DataFrame, projections: DataFrame,
                 dm: DataFrame | None, scalars: DataFrame | None = None):
        # The five tables joined inside the loop are checkpointed (plan
        # leaves: persisted tables would drag their build plans into every
        # round's optimization, measured 4x slower per round); build-only
        # inputs are persisted and released at the end.
        keep = RoundState(spark).keep
        held = []

        def hold(df):
            held.append(df.persist())
            return held[-1]

        scopes = hold(with_defaults(scopes))
        self.scopes = scopes
        rel = hold(relations.withColumn("alias", F.upper("alias")).withColumn("table_name", F.upper("table_name")))
        self.relations = rel
        if "origin_alias" not in projections.columns:
            projections = projections.withColumn("origin_alias", _null())
        # a later projection of the same name overwrites the value, keeping the first position
        p = projections.withColumn("output_name", F.upper("output_name"))
        agg = p.groupBy("stmt_id", "scope_id", "output_name").agg(
            F.min("ord").alias("first_ord"),
            F.max_by(F.struct("expression", "origin_alias"), "ord").alias("_v"))
        w = Window.partitionBy("stmt_id", "scope_id").orderBy("first_ord")
        plain = agg.select("stmt_id", "scope_id", "output_name", "_v.expression", "_v.origin_alias",
                           (F.row_number().over(w) - 1).alias("pos"))
        self.scalars = scalars
        self.proj = hold(with_parts(plain, scalars, projections, rel, scopes))
        # aliases are looked up when references name them, from these two
        self.closure = keep(scope_closure(spark, scopes))
        self.rel_at = keep(relations_at(scopes, rel))
        self.names = scopes.select("stmt_id", "scope_id", "scope_name", "parent_id")
        br = scopes.where(F.col("kind") == "UNION_BRANCH").select(
            "stmt_id", F.col("parent_id").alias("union_id"), F.col("scope_id").alias("branch_id"),
            F.col("scope_name").alias("branch_name"), F.coalesce("branch_ord", F.lit(0)).alias("branch_ord"))
        self.branches = hold(br)
        self.unions = hold(br.select("stmt_id", F.col("union_id").alias("scope_id")).distinct())
        self.union_pick = hold(self._union_pick())
        self.first_phys = hold(rel.where(F.col("rel_kind") == "PHYSICAL").groupBy("stmt_id", "scope_id")
                           .agg(F.min_by(F.struct("table_name", "alias"), "ord").alias("_f"))
                           .select("stmt_id", "scope_id", F.col("_f.table_name").alias("fp_table")))
        self.phys = keep(rel.where(F.col("rel_kind") == "PHYSICAL").select(
            "stmt_id", "scope_id", F.col("alias").alias("rel_alias"), F.col("table_name").alias("rel_table"),
            F.col("ord").alias("rel_ord")))
        child = rel.where(F.col("rel_kind") == "SCOPE").select(
            "stmt_id", "scope_id", F.col("alias").alias("child_alias"), "child_scope_id",
            F.col("ord").alias("rel_ord"))
        self.has_child = hold(child.select("stmt_id", "scope_id").distinct())
        self.child_proj = hold(child.join(self.proj.select("stmt_id", F.col("scope_id").alias("child_scope_id"),
                                                       "output_name"),
                                      ["stmt_id", "child_scope_id"])
                           .join(self.names.select("stmt_id", F.col("scope_id").alias("child_scope_id"),
                                                   F.col("scope_name").alias("child_name")),
                                 ["stmt_id", "child_scope_id"]))
        self.aliases = rel.groupBy("stmt_id", "scope_id").agg(F.collect_set("alias").alias("aliases"))
        # only tables that a relation names are ever looked up
        named = rel.select("table_name").distinct()
        self.dm = (keep(dm.select(F.upper("table_name").alias("table_name"), F.upper("column_name").alias("column_name"))
                        .join(named, "table_name", "left_semi").distinct())
                   if dm is not None else None)
        # what depth-first searches walk: scope relations in order, then union branches
        self.reads = keep(child.select("stmt_id", "scope_id", F.col("child_scope_id").cast("long").alias("child"),
                                       F.struct(F.lit(0).alias("k"), F.col("rel_ord").cast("int").alias("o")).alias("at"))
                          .unionByName(br.select("stmt_id", F.col("union_id").alias("scope_id"),
                                                 F.col("branch_id").cast("long").alias("child"),
                                                 F.struct(F.lit(1).alias("k"), F.col("branch_ord").cast("int").alias("o")).alias("at"))))
        self.scope_info = keep(self._scope_info())
        self.name_info = keep(self._name_info())
        # everything the loop joins is checkpointed now; free the build inputs
        for df in held:
            df.unpersist(blocking=False)

    def _scope_info(self) -> DataFrame:
        """Per scope: name, parent, union branches, physical relations, aliases."""
        br = self.branches.groupBy("stmt_id", F.col("union_id").alias("scope_id")).agg(
            F.array_sort(F.collect_list(F.struct("branch_ord", "branch_id", "branch_name"))).alias("_b"))
        br = br.select("stmt_id", "scope_id", F.transform("_b", lambda b: F.struct(
            b["branch_id"].cast("long").alias("branch_id"), b["branch_name"].alias("branch_name"))).alias("branches"))
        ph = self.phys.groupBy("stmt_id", "scope_id").agg(
            F.array_sort(F.collect_list(F.struct("rel_ord", "rel_alias", "rel_table"))).alias("_p"))
        ph = ph.select("stmt_id", "scope_id",
                       F.transform("_p", lambda p: F.struct(p["rel_alias"].alias("alias"),
                                                            p["rel_table"].alias("table_name"))).alias("phys"),
                       F.try_element_at("_p", F.lit(1))["rel_table"].alias("first_phys"))
        # star placeholders in order: a table, a scope, or the scope they were copied from
        at = self.relations.select("stmt_id", "scope_id", "alias", "table_name",
                                   F.col("child_scope_id").cast("long").alias("child_scope_id"))
        star = self.proj.where(F.col("output_name").startswith("*_")).select(
            "stmt_id", "scope_id", "pos", F.substring("output_name", 3, 1 << 20).alias("alias"),
            F.upper("origin_alias").alias("_origin"))
        star = star.join(at, ["stmt_id", "scope_id", "alias"], "left").join(
            at.select("stmt_id", "scope_id", F.col("alias").alias("_origin"), F.col("child_scope_id").alias("_from")),
            ["stmt_id", "scope_id", "_origin"], "left").join(
            self.names.select("stmt_id", F.col("scope_id").cast("long").alias("child_scope_id"), F.col("scope_name").alias("_name")),
            ["stmt_id", "child_scope_id"], "left")
        star = star.groupBy("stmt_id", "scope_id").agg(F.array_sort(F.collect_list(F.struct(
            "pos", "table_name", F.col("child_scope_id").alias("to_scope"), F.col("_name").alias("to_name"), "_from"))).alias("stars"))
        return (self.names.join(br, ["stmt_id", "scope_id"], "left").join(star, ["stmt_id", "scope_id"], "left")
                .join(self.has_child.withColumn("has_child", F.lit(True)), ["stmt_id", "scope_id"], "left")
                .join(ph, ["stmt_id", "scope_id"], "left").join(self.aliases, ["stmt_id", "scope_id"], "left")
                .select("stmt_id", "scope_id", "scope_name", "parent_id",
                        F.col("branches").isNotNull().alias("is_union"), "branches",
                        F.coalesce("has_child", F.lit(False)).alias("has_child"), "phys", "aliases", "first_phys", "stars"))

    def _name_info(self) -> DataFrame:
        """Per (scope, name): own projection, union branch picks, child scopes
        projecting it.  Every expression carries its references, its constant
        flag and (own projections) the identity flag, computed here once so
        the loop never re-parses catalog text."""
        pr = self.proj.select("stmt_id", "scope_id", F.col("output_name").alias("name"), "expression",
                              F.col("origin_alias").alias("origin"), "refs", "is_const", "parts")
        pr = pr.join(self.aliases, ["stmt_id", "scope_id"], "left")
        first = F.split(F.try_element_at("refs", F.lit(1)), r"\.", 2)
        single_col = F.when(F.size(first) > 1, F.trim(first[1])).otherwise(F.trim(first[0]))
        single_alias = F.when(F.size(first) > 1, F.trim(first[0]))
        ident = (normalize_identifier("expression") == F.col("name")) | (
            (F.size("refs") == 1) & (single_col == F.col("name")) &
            ~(single_alias.isNotNull() & F.coalesce(F.array_contains("aliases", single_alias), F.lit(False))))
        pr = pr.select("stmt_id", "scope_id", "name", F.col("expression").alias("expr"), "origin", "refs", "is_const",
                       "parts", ident.alias("ident"))
        pk = self.union_pick.groupBy("stmt_id", "scope_id", "name").agg(
            F.array_sort(F.collect_list(F.struct("branch_ord", "branch_id", "branch_name", "expr", "refs", "is_const",
                                                 "parts"))).alias("pick"))
        ch = self.child_proj.groupBy("stmt_id", "scope_id", F.col("output_name").alias("name")).agg(
            F.array_sort(F.collect_list(F.struct("rel_ord", F.col("child_scope_id").cast("long").alias("child_scope_id"),
                                                 "child_name", "child_alias"))).alias("children"))
        keys = ["stmt_id", "scope_id", "name"]
        return pr.join(pk, keys, "full_outer").join(ch, keys, "full_outer")

    def _union_pick(self) -> DataFrame:
        """For each union scope and column name: the branch projections it means.

        By name in the branch; else the projection at the first branch's
        position of the name.  Names a branch cannot answer are absent.
        """
        br, p = self.branches, self.proj
        bp = br.join(p.withColumnRenamed("scope_id", "branch_id"), ["stmt_id", "branch_id"])
        first = br.withColumn("_r", F.row_number().over(
            Window.partitionBy("stmt_id", "union_id").orderBy("branch_ord", "branch_id"))).where("_r = 1")
        first_pos = first.join(p.withColumnRenamed("scope_id", "branch_id"), ["stmt_id", "branch_id"]).select(
            "stmt_id", "union_id", F.col("output_name").alias("name"), F.col("pos").alias("target_idx"))
        names = bp.select("stmt_id", "union_id", F.col("output_name").alias("name")).distinct()
        grid = names.join(br, ["stmt_id", "union_id"]).join(first_pos, ["stmt_id", "union_id", "name"], "left")
        said = F.struct(F.col("expression").alias("expr"), "refs", "is_const", "parts")
        by_name = grid.join(bp.select("stmt_id", "branch_id", F.col("output_name").alias("name"), said.alias("_n")),
                            ["stmt_id", "branch_id", "name"], "left")
        by_pos = bp.select("stmt_id", "branch_id", F.col("pos").alias("target_idx"), said.alias("_p"))
        g = by_name.join(by_pos, ["stmt_id", "branch_id", "target_idx"], "left")
        return (g.withColumn("_x", F.coalesce("_n", "_p")).where(F.col("_x").isNotNull())
                .select("stmt_id", F.col("union_id").alias("scope_id"), "name",
                        F.col("branch_id").cast("long").alias("branch_id"), "branch_name", "branch_ord", "_x.*"))


# ---- discovery -------------------------------------------------------------

def _edge(grp=0, crit="all", scope=None, mode=None, ref=None, add=None, reset=False, drop=False, source_type=None,
          table=None, column=None, const=None, reason=None, suffix=None, alias=None, oref=None, dm_needed=False):
    """One edge of a node: to another node (``mode``) or to a result.

    Of a node's groups the first that meets its criterion is taken: ``any`` (it
    has a result), ``first`` (its first result is resolved), ``all`` (always).
    """
    def v(x, t="string"):
        if x is None:
            return _null(t)
        return F.lit(x) if isinstance(x, (str, bool, int)) else x
    return F.struct(
        v(grp).cast("int").alias("grp"), F.lit(crit).alias("crit"), v(scope, "bigint").cast("bigint").alias("to_scope"),
        v(mode).alias("to_mode"), v(ref).alias("to_ref"),
        (add if add is not None else F.array().cast("array<string>")).alias("add"), F.lit(reset).alias("reset"),
        F.lit(drop).alias("drop"), v(source_type).alias("source_type"), v(table).alias("table_name"),
        v(column).alias("column_name"), v(const).alias("constant_value"), v(reason).alias("reason"),
        v(suffix).alias("suffix"), v(alias).alias("source_alias"), v(oref).alias("original_ref"),
        F.lit(dm_needed).alias("dm_needed"))


def _constant(value, **how):
    return _edge(source_type="CONSTANT", const=value, suffix=F.concat(F.lit(":CONSTANT("), value, F.lit(")")), **how)


def _physical(table, column, **how):
    return _edge(source_type="PHYSICAL", table=table, column=column, dm_needed=True,
                 suffix=F.concat(F.lit(":"), table, F.lit("."), column), **how)


def _unresolved(reason, column, **how):
    return _edge(source_type="UNRESOLVED", reason=reason, column=column, **how)


def _expression(scope, expr, is_const, parts, add=None, **how):
    """Edges of an expression read in ``scope``."""
    begin = add if add is not None else F.array().cast("array<string>")
    text = F.coalesce(expr, F.lit(""))
    return (F.when(is_const, F.array(_constant(py_strip(text), add=begin, **how)))
            .when(F.size(parts) == 0, F.array(_constant(text, add=begin, **how)))
            .otherwise(F.transform(parts, lambda p: _edge(
                scope=F.coalesce(p["scope_id"], scope), mode=p["mode"], ref=p["ref"], add=F.concat(begin, p["add"]), **how))))


def _looked_up(tasks: DataFrame, cat: Catalog) -> DataFrame:
    """Nodes with what the catalog has about their scope S, their name there
    (SN), the scope T their alias means, and the name there (TN)."""
    dotted = F.col("mode").substr(1, 1).isin("R", "B", "J", "M", "S", "P")
    part = F.split("ref", r"\.", 2)
    has = dotted & (F.size(part) > 1)
    f = tasks.withColumns({"_alias": F.when(has, F.trim(part[0])),
                           "_col": F.when(has, F.trim(part[1])).otherwise(F.trim("ref"))})
    asked = f.where(F.col("_alias").isNotNull()).select("stmt_id", "scope_id", F.col("_alias").alias("alias"))
    v = visible_asked(asked, cat.rel_at, cat.closure).select(
        "stmt_id", "scope_id", F.col("alias").alias("_alias"), F.col("rel_kind").alias("_rk"),
        F.col("table_name").alias("_rt"), F.col("child_scope_id").cast("long").alias("_target"))
    f = f.join(v, ["stmt_id", "scope_id", "_alias"], "left")
    si, ni = cat.scope_info, cat.name_info
    f = f.join(si.select("stmt_id", "scope_id", *[F.col(c).alias("S_" + c) for c in si.columns[2:]]),
               ["stmt_id", "scope_id"], "left")
    f = f.join(ni.select("stmt_id", "scope_id", F.col("name").alias("_col"),
                         *[F.col(c).alias("SN_" + c) for c in ni.columns[3:]]), ["stmt_id", "scope_id", "_col"], "left")
    f = f.join(si.select("stmt_id", F.col("scope_id").cast("long").alias("_target"),
                         *[F.col(c).alias("T_" + c) for c in ("scope_name", "is_union")]), ["stmt_id", "_target"], "left")
    return f.join(ni.select("stmt_id", F.col("scope_id").cast("long").alias("_target"), F.col("name").alias("_col"),
                            *[F.col(c).alias("TN_" + c) for c in ("expr", "is_const", "parts", "pick")]),
                  ["stmt_id", "_target", "_col"], "left")


def _first_below(tops: DataFrame, reads: DataFrame, own: DataFrame, state: RoundState, rounds: int) -> DataFrame:
    """(stmt_id, scope_id, name, found): the first scope below ``tops``
    (stmt_id, scope_id, name) in depth-first order with a row in
    ``own(stmt_id, found, name)``.

    Children of all tops are walked level by level, each scope with its least
    path of child positions; paths compare as depth-first order does.  A scope
    with the name is not walked further.
    """
    walk = tops.select("stmt_id", "scope_id", "name", F.col("scope_id").alias("at"),
                       F.array().cast("array<struct<k:int,o:int>>").alias("path"))
    step = reads.select("stmt_id", F.col("scope_id").cast("long").alias("at"), "child", F.col("at").alias("_o"))
    mark = own.select("stmt_id", F.col("found").alias("child"), "name", F.lit(True).alias("_has")).distinct()
    hits = []
    for _ in range(rounds):
        seen = walk.join(step, ["stmt_id", "at"]).groupBy("stmt_id", "scope_id", "name", "child").agg(
            F.min(F.concat("path", F.array("_o"))).alias("path")).join(mark, ["stmt_id", "child", "name"], "left")
        seen = state.keep(seen)
        hits.append(seen.where("_has"))
        walk = seen.where("_has is null").select("stmt_id", "scope_id", "name", F.col("child").alias("at"), "path")
        if walk.isEmpty():
            break
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.groupBy("stmt_id", "scope_id", "name").agg(F.min_by("child", "path").alias("found"))


def _edges(tasks: DataFrame, cat: Catalog, state: RoundState, max_depth: int, searches: bool) -> DataFrame:
    """Edges of new nodes (KEY): (KEY, pos, edge...)."""
    f = _looked_up(tasks, cat)
    col, alias, u, scope = F.col("_col"), F.col("_alias"), F.col("ref"), F.col("scope_id")
    empty = F.filter(F.array(_edge()), lambda _: F.lit(False))
    own = lambda **how: _expression(scope, F.col("SN_expr"), F.col("SN_is_const"), F.col("SN_parts"), **how)
    named = F.col("SN_expr").isNotNull()
    kids = F.coalesce(F.col("SN_children"), F.array())
    phys = F.coalesce(F.col("S_phys"), F.array())
    # --- R, qualified
    picks = F.coalesce(F.col("TN_pick"), F.array())
    in_branches = lambda p, **how: F.flatten(F.transform(p, lambda b: _expression(
        b["branch_id"], b["expr"], b["is_const"], b["parts"], add=F.array(b["branch_name"]), **how)))
    qualified = (
        F.when(F.col("_rk").isNull(), F.array(_unresolved("ALIAS_NOT_FOUND", u)))
        .when(F.col("_rk") == "PHYSICAL", F.array(_physical(F.col("_rt"), col, alias=alias, oref=u)))
        .when(F.col("_target") == scope, F.array(_edge(scope=scope, mode="P", ref=u)))
        .when(F.col("T_is_union") & (F.size(picks) > 0), in_branches(picks, reset=True))
        .when(F.col("TN_expr").isNotNull(), _expression(F.col("_target"), F.col("TN_expr"), F.col("TN_is_const"),
                                                        F.col("TN_parts"), add=F.array("T_scope_name"), reset=True))
        .otherwise(F.array(_edge(scope=F.col("_target"), mode="M", ref=u, reset=True))))
    # --- R, unqualified
    own_picks = F.coalesce(F.col("SN_pick"), F.array())
    picked = F.transform(own_picks, lambda b: b["branch_id"])
    union_out = F.when(F.coalesce("S_is_union", F.lit(False)), F.concat(
        in_branches(own_picks, crit="any"),
        F.transform(F.filter(F.coalesce(F.col("S_branches"), F.array()), lambda b: ~F.array_contains(picked, b["branch_id"])),
                    lambda b: _edge(crit="any", scope=b["branch_id"], mode="B", ref=col, add=F.array(b["branch_name"]),
                                    drop=True)))).otherwise(empty)
    origin = F.upper(F.coalesce("SN_origin", F.lit("")))
    ordered = F.concat(F.filter(kids, lambda c: c["child_alias"] == origin), F.filter(kids, lambda c: c["child_alias"] != origin))
    last = F.size(kids) + 1
    descents = F.concat(
        F.transform(ordered, lambda c, i: _edge(grp=i + 1, crit="any", scope=c["child_scope_id"], mode="I0", ref=col,
                                                add=F.array(c["child_name"]))),
        F.when(~F.coalesce("S_has_child", F.lit(False)) & (F.size(phys) > 0),
               F.transform(phys, lambda p: _physical(p["table_name"], col, alias=p["alias"], oref=col, grp=last)))
        .otherwise(F.array(_unresolved("COLUMN_NOT_FOUND", col, grp=last))))
    entered = F.transform(kids, lambda c: _edge(grp=1, scope=c["child_scope_id"], mode="E", ref=col, add=F.array(c["child_name"])))
    unqualified = F.concat(union_out, F.when(
        named, F.when(F.coalesce(F.col("SN_ident"), F.lit(False)), descents).otherwise(own(grp=1)))
        .when(F.size(kids) > 0, entered).otherwise(F.array(_edge(grp=1, scope=scope, mode="D", ref=col))))
    reference = (F.when(is_constant("ref"), F.array(_constant(u)))
                 .when(alias.isNotNull() & col.isin("NEXTVAL", "CURRVAL"),
                       F.array(_edge(source_type="SEQUENCE", table=alias, column=col, alias=alias, oref=u,
                                     suffix=F.concat(F.lit(":SEQUENCE("), alias, F.lit("."), col, F.lit(")")))))
                 .when(alias.isNotNull(), qualified).otherwise(unqualified))
    # --- I, J: identity descent
    level = F.col("mode").substr(F.lit(2), F.lit(9)).cast("int")
    deeper = F.concat(F.lit("I"), (level + 1).cast("string"))
    same = F.concat(F.lit("J"), level.cast("string"))
    branch_refs = F.flatten(F.transform(own_picks, lambda b: F.transform(
        b["refs"], lambda r: _edge(scope=b["branch_id"], mode=same, ref=r))))
    first_pick = F.try_element_at(own_picks, F.lit(1))
    descent = (
        F.when(level > DESCENT, empty)
        .when(named, F.when(F.size("SN_refs") > 0, F.transform("SN_refs", lambda r: _edge(scope=scope, mode=same, ref=r)))
              .when(F.col("SN_is_const"), F.array(_constant(py_strip(F.col("SN_expr"))))).otherwise(empty))
        .when(F.size(own_picks) > 0, F.when(F.size(branch_refs) > 0, branch_refs)
              .when(first_pick["is_const"], F.array(_constant(py_strip(first_pick["expr"])))).otherwise(empty))
        .otherwise(F.transform(kids, lambda c, i: _edge(grp=i, crit="any", scope=c["child_scope_id"], mode=deeper, ref=col,
                                                        add=F.array(c["child_name"])))))
    one = (F.when(alias.isNotNull(),
                  F.when(F.col("_rk").isNull(), empty)
                  .when(F.col("_rk") == "PHYSICAL", F.array(_physical(F.col("_rt"), col, alias=alias, oref=u)))
                  .otherwise(F.array(_edge(scope=F.col("_target"), mode=deeper, ref=col, add=F.array("T_scope_name")))))
           .otherwise(F.concat(
               F.transform(kids, lambda c: _edge(crit="any", scope=c["child_scope_id"], mode=deeper, ref=col,
                                                 add=F.array(c["child_name"]))),
               F.transform(phys, lambda p: _physical(p["table_name"], col, alias=p["alias"], oref=col, grp=1)))))
    # --- S: star placeholders
    stars = F.flatten(F.transform(F.coalesce("S_stars", F.array()), lambda x, i: (
        F.when(x["table_name"].isNotNull(), F.array(_physical(x["table_name"], col, alias=alias, oref=u, grp=i, crit="any")))
        .when(x["to_scope"].isNotNull(), F.array(_edge(grp=i, crit="first", scope=x["to_scope"], mode="R", ref=col,
                                                        add=F.array(x["to_name"]), reset=True)))
        .when(x["_from"].isNotNull(), F.array(_edge(grp=i, crit="any", scope=x["_from"], mode="S", ref=u)))
        .otherwise(empty))))
    # --- M, P: searches below a scope
    if searches:
        m = tasks.where(F.col("mode") == "M").select("stmt_id", "scope_id", F.trim(F.split("ref", r"\.", 2)[1]).alias("name"))
        found = _first_below(m.distinct(), cat.reads, cat.name_info.where(F.col("expr").isNotNull()).select(
            "stmt_id", F.col("scope_id").cast("long").alias("found"), "name"), state, max_depth)
        found = found.join(cat.scope_info.select("stmt_id", F.col("scope_id").cast("long").alias("found"),
                                                 F.col("scope_name").alias("_found_name")), ["stmt_id", "found"])
        p = tasks.where(F.col("mode") == "P").select("stmt_id", "scope_id", F.trim(F.split("ref", r"\.", 2)[0]).alias("name"))
        tables = cat.phys.select("stmt_id", F.col("scope_id").cast("long").alias("found"), F.col("rel_alias").alias("name"),
                                 "rel_table", "rel_ord")
        here = p.distinct().join(tables.withColumnRenamed("found", "scope_id"), ["stmt_id", "scope_id", "name"]) \
            .select("stmt_id", "scope_id", "name", F.col("scope_id").alias("found"))
        below = _first_below(p.distinct().join(here, ["stmt_id", "scope_id", "name"], "left_anti"),
                             cat.reads.where("at.k = 0"), tables, state, max_depth)
        alike = here.unionByName(below).join(tables, ["stmt_id", "found", "name"]).groupBy("stmt_id", "scope_id", "name") \
            .agg(F.min_by("rel_table", "rel_ord").alias("_alike"))
        f = f.join(found.withColumnRenamed("name", "_col"), ["stmt_id", "scope_id", "_col"], "left") \
            .join(alike.withColumnRenamed("name", "_alias"), ["stmt_id", "scope_id", "_alias"], "left")
        first = F.col("S_first_phys")
        nested = (F.when(F.col("found").isNotNull(), F.array(_edge(scope=F.col("found"), mode="E", ref=col,
                                                                   add=F.array("_found_name"), reset=True)))
                  .otherwise(F.array(
                      _edge(crit="any", scope=scope, mode="S", ref=u),
                      F.when(first.isNotNull(), _physical(first, col, alias=alias, oref=u, grp=1))
                      .otherwise(_unresolved("MISSING_PROJECTION", F.concat(alias, F.lit("."), col), grp=1)))))
        itself = (F.when(F.col("_alike").isNotNull(), F.array(_physical(F.col("_alike"), col)))
                  .when(named, own())
                  .otherwise(F.array(_unresolved("MISSING_PROJECTION", F.concat(alias, F.lit("."), col)))))
    else:
        nested = itself = empty
    kind = F.col("mode").substr(1, 1)
    outs = (F.when(kind.isin("R", "B"), reference).when(kind == "E", F.when(named, own()).otherwise(empty))
            .when(kind == "I", descent).when(kind == "J", one).when(kind == "S", stars)
            .when(kind == "M", nested).otherwise(itself))
    # outer, as Spark filters an inner one by a second evaluation of all the rules
    x = f.select(*KEY, F.col("S_parent_id").cast("long").alias("_parent"), F.posexplode_outer(outs).alias("pos", "o")) \
        .where("pos is not null").select(*KEY, "_parent", "pos", "o.*")
    # --- D: the DM, then the parent scope
    d = x.where(F.col("to_mode") == "D")
    if cat.dm is not None:
        tables = cat.phys.select("stmt_id", F.col("scope_id").cast("long").alias("to_scope"), "rel_ord", "rel_table")
        hits = d.select("stmt_id", "to_scope", "to_ref").distinct().join(tables, ["stmt_id", "to_scope"]).join(
            cat.dm.select(F.col("table_name").alias("rel_table"), F.col("column_name").alias("to_ref")), ["rel_table", "to_ref"]) \
            .groupBy("stmt_id", "to_scope", "to_ref").agg(F.array_sort(F.collect_list(F.struct("rel_ord", "rel_table"))).alias("_tables"))
        d = d.join(hits, ["stmt_id", "to_scope", "to_ref"], "left")
    else:
        d = d.withColumn("_tables", _null("array<struct<rel_ord:int,rel_table:string>>"))
    name = F.col("to_ref")
    up = (F.when(F.size(F.coalesce("_tables", F.array())) > 0,
                 F.transform("_tables", lambda t: _physical(t["rel_table"], name, grp=1)))
          .when(F.col("mode") == "B", F.array(_unresolved("CYCLE_DETECTED", name, grp=1)))
          .when(F.col("_parent").isNotNull(), F.array(_edge(grp=1, scope=F.col("_parent"), mode="R", ref=name)))
          .otherwise(F.array(_unresolved("COLUMN_NOT_FOUND", name, grp=1))))
    more = d.select(*KEY, "_parent", "pos", F.posexplode_outer(up).alias("_p", "o")).where("_p is not null").select(
        *KEY, "_parent", (F.col("pos") * 1000 + F.col("_p")).alias("pos"), "o.*")
    return x.where(F.col("to_mode").isNull() | (F.col("to_mode") != "D")).unionByName(more).drop("_parent")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def discover(first: DataFrame, cat: Catalog, state: RoundState, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Edges of all nodes reached from ``first`` (KEY): (KEY, round, pos, edge...)."""
    tasks = state.keep(first.select(*KEY).distinct())
    known, found, n = tasks, [], 0
    while True:
        modes = {r[0] for r in tasks.select(F.col("mode").substr(1, 1)).distinct().collect()}  # seven at most
        if not modes:
            break
        edges = state.keep(_edges(tasks, cat, state, max_depth, bool(modes & {"M", "P"})).withColumn("round", F.lit(n)))
        found.append(edges)
        to = edges.where(F.col("to_mode").isNotNull()).select(
            "stmt_id", F.col("to_scope").alias("scope_id"), F.col("to_mode").alias("mode"), F.col("to_ref").alias("ref"))
        tasks = state.keep(to.distinct().join(known, KEY, "left_anti"))
        known = known.unionByName(tasks)
        n += 1
    return _union(found) if found else _edges(tasks, cat, state, max_depth, False).withColumn("round", F.lit(0))


# ---- choice ----------------------------------------------------------------

def choose(edges: DataFrame, state: RoundState, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``edges`` without the groups that a node does not take.

    A node's value is whether it has results, whether its first one is resolved
    and whether any is.  Values start empty and rise from the results up, a
    level a round; after as many rounds as a path can have levels they stand.
    """
    several = edges.where(F.col("crit") != "all").select("stmt_id").distinct()
    if several.isEmpty():
        return edges
    part = state.keep(edges.join(several, "stmt_id", "left_semi").select(
        *KEY, "grp", "crit", "pos", "drop", "to_scope", "to_mode", "to_ref",
        F.when(F.col("to_mode").isNull(), F.col("source_type") != "UNRESOLVED").alias("resolved")))
    value = None
    for _ in range(2 * max_depth):
        if value is None:
            e = part.withColumns({c: F.lit(False) for c in ("_ne", "_fi", "_an")})
        else:
            e = part.join(value.select("stmt_id", F.col("scope_id").alias("to_scope"), F.col("mode").alias("to_mode"),
                                       F.col("ref").alias("to_ref"), F.col("ne").alias("_ne"), F.col("fi").alias("_fi"),
                                       F.col("an").alias("_an")), ["stmt_id", "to_scope", "to_mode", "to_ref"], "left")
        leaf = F.col("to_mode").isNull()
        false = F.lit(False)
        any_ = F.when(leaf, F.col("resolved")).otherwise(F.coalesce("_an", false))
        has = F.when(leaf, F.col("resolved") | ~F.col("drop")).when(F.col("drop"), any_).otherwise(F.coalesce("_ne", false))
        first = F.when(leaf, F.col("resolved")).when(F.col("drop"), any_).otherwise(F.coalesce("_fi", false))
        groups = e.withColumns({"_h": has, "_f": first, "_a": any_}).groupBy(*KEY, "grp", "crit").agg(
            F.max("_h").alias("ne"), F.coalesce(F.min_by("_f", F.when(F.col("_h"), F.col("pos"))), false).alias("fi"), F.max("_a").alias("an"))
        meets = (F.col("crit") == "all") | F.when(F.col("crit") == "any", F.col("ne")).otherwise(F.col("ne") & F.col("fi"))
        new = state.keep(groups.groupBy(*KEY).agg(F.min(F.when(meets, F.struct("grp", "ne", "fi", "an"))).alias("_t")).select(
            *KEY, F.col("_t.grp").alias("taken"), *[F.coalesce(f"_t.{c}", false).alias(c) for c in ("ne", "fi", "an")]))
        if value is not None and new.join(value.select(*KEY, *[F.col(c).alias("_" + c) for c in ("taken", "ne", "fi", "an")]), KEY).where(
                "not (taken <=> _taken and ne = _ne and fi = _fi and an = _an)").isEmpty():
            break
        value = new
    taken = value.select(*KEY, F.col("taken"), F.lit(True).alias("_known"))
    return edges.join(taken, KEY, "left").where(F.col("_known").isNull() | (F.col("grp") == F.col("taken"))).drop("taken", "_known")


# ---- expansion -------------------------------------------------------------

_RESULT = ["source_type", "table_name", "column_name", "constant_value", "reason", "suffix", "source_alias", "original_ref",
           "dm_needed"]


def expand(start: DataFrame, edges: DataFrame, state: RoundState, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Results along all paths from ``start`` (stmt_id, root_ord, scope_id, mode,
    ref, trace, n): (stmt_id, root_ord, trace, result..., n)."""
    # Only statements where a node comes back to one found no later can run in circles.
    to = edges.where(F.col("to_mode").isNotNull() & ~F.col("reset"))
    rounds = edges.select("stmt_id", F.col("scope_id").alias("to_scope"), F.col("mode").alias("to_mode"),
                          F.col("ref").alias("to_ref"), F.col("round").alias("_r")).distinct()
    circles = to.join(rounds, ["stmt_id", "to_scope", "to_mode", "to_ref"]).where(F.col("_r") <= F.col("round")) \
        .select("stmt_id").distinct().withColumn("track", F.lit(True))
    edges = state.keep(edges.join(circles, "stmt_id", "left"))
    key = F.concat(F.col("scope_id").cast("string"), F.lit(":"), F.col("ref"))
    path = ["stmt_id", "root_ord", "scope_id", "mode", "ref", "trace", "seen", "only"]
    walk = start.withColumns({"seen": F.array().cast("array<string>"), "only": F.lit(False)}).groupBy(*path).agg(F.sum("n").alias("n"))
    out = []
    while True:
        stop = F.when(F.col("mode").isin("R", "B"), F.when(F.array_contains("seen", key), "CYCLE_DETECTED")
                      .when(F.size("trace") > max_depth, "DEPTH_GUARD"))
        # a path that stops joins no edge and is a result itself
        halted = walk.withColumn("_stop", stop).withColumn("mode", F.when(F.col("_stop").isNull(), F.col("mode")))
        step = halted.join(edges, KEY, "left").withColumns({
            "trace": F.concat("trace", F.coalesce("add", F.array().cast("array<string>"))),
            "seen": F.when(F.col("reset"), F.array().cast("array<string>"))
                     .when(F.col("track") & F.col("mode").isin("R", "B"), F.concat("seen", F.array(key))).otherwise(F.col("seen")),
            "only": F.col("only") | F.coalesce("drop", F.lit(False)),
            "source_type": F.when(F.col("_stop").isNotNull(), "UNRESOLVED").otherwise(F.col("source_type")),
            "reason": F.coalesce("_stop", "reason"), "dm_needed": F.coalesce("dm_needed", F.lit(False))})
        step = state.keep(step.select("stmt_id", "root_ord", "to_scope", "to_mode", "to_ref", "trace", "seen", "only", *_RESULT, "n"))
        out.append(step.where(F.col("source_type").isNotNull() & ~(F.col("only") & (F.col("source_type") == "UNRESOLVED")))
                   .select("stmt_id", "root_ord", "trace", *_RESULT, "n"))
        on = step.where(F.col("to_mode").isNotNull())
        if on.isEmpty():
            return _union(out)
        walk = on.select(
            "stmt_id", "root_ord", F.col("to_scope").alias("scope_id"), F.col("to_mode").alias("mode"),
            F.col("to_ref").alias("ref"), "trace", "seen", "only", "n").groupBy(*path).agg(F.sum("n").alias("n"))


def resolve_refs(spark: SparkSession, seeds: DataFrame, scopes: DataFrame, relations: DataFrame,
                 projections: DataFrame, dm: DataFrame | None = None, max_depth: int = MAX_DEPTH,
                 catalog: Catalog | None = None, scalars: DataFrame | None = None) -> DataFrame:
    """Resolve every seed expression to its physical sources.

    ``seeds(stmt_id, root_ord, scope_id, expression)``: the expression to
    resolve and the scope it is written in.  Returns one row per source
    (stmt_id, root_ord, source_type, table_name, column_name, constant_value,
    reason, dm_match, trace_path, source_alias, original_ref,
    full_expression); an expression gives several rows when it reads several
    columns, duplicates kept.  ``scalars``: see ``with_parts``.
    """
    cat = catalog or Catalog(spark, scopes, relations, projections, dm, scalars)
    state = RoundState(spark)
    names = cat.names.select("stmt_id", F.col("scope_id").cast("long").alias("scope_id"), "scope_name")
    roots = seeds.select("stmt_id", F.col("root_ord").cast("long").alias("root_ord"),
                         F.col("scope_id").cast("long").alias("scope_id"), "expression")
    # a node without edges cannot tell that its seed was there: seeds keep their number
    roots = state.keep(with_parts(roots, cat.scalars, cat.proj.withColumn("ord", F.col("pos")), cat.relations, cat.names)
                       .join(names, ["stmt_id", "scope_id"], "left").withColumns({
                           "trace": F.array(F.coalesce("scope_name", F.lit(""))), "seed": F.monotonically_increasing_id()}))
    begin = _expression(F.col("scope_id"), F.col("expression"), F.col("is_const"), F.col("parts"))
    begin = state.keep(roots.select("stmt_id", F.col("seed").alias("root_ord"), "trace", F.explode(begin).alias("o"))
                       .select("stmt_id", "root_ord", F.concat("trace", "o.add").alias("trace"), "o.*"))
    start = begin.where(F.col("to_mode").isNotNull()).select(
        "stmt_id", "root_ord", F.col("to_scope").alias("scope_id"), F.col("to_mode").alias("mode"),
        F.col("to_ref").alias("ref"), "trace", F.lit(1).cast("bigint").alias("n"))
    edges = discover(start, cat, state, max_depth)
    found = expand(start, choose(edges, state, max_depth), state, max_depth)
    direct = begin.where(F.col("to_mode").isNull()).select(
        "stmt_id", "root_ord", "trace", *_RESULT, F.lit(1).cast("bigint").alias("n"))
    res = direct.unionByName(found).withColumnRenamed("root_ord", "seed").join(
        roots.select("stmt_id", "seed", "root_ord", F.col("expression").alias("full_expression")), ["stmt_id", "seed"])
    if cat.dm is not None:
        d = cat.dm.select(F.col("table_name").alias("_dt"), F.col("column_name").alias("_dc"), F.lit("Y").alias("_y"))
        res = res.join(d, F.col("dm_needed") & (res["table_name"] == d["_dt"]) & (res["column_name"] == d["_dc"]),
                       "left")
    else:
        res = res.withColumn("_y", F.lit(None).cast("string"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    res = res.select(
        "stmt_id", "root_ord", "source_type", blank("table_name").alias("table_name"),
        blank("column_name").alias("column_name"), blank("constant_value").alias("constant_value"),
        blank("reason").alias("reason"), F.coalesce("_y", F.lit("N")).alias("dm_match"),
        F.concat(F.array_join("trace", "->"), F.coalesce("suffix", F.lit(""))).alias("trace_path"),
        blank("source_alias").alias("source_alias"), blank("original_ref").alias("original_ref"),
        "full_expression", "n")
    once = res.where("n = 1").drop("n")
    return once.unionByName(res.where("n > 1").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("_i", "n"))


def scalar_subquery_refs(scalars: DataFrame, projections: DataFrame, relations: DataFrame,
                         ctes: DataFrame | None = None) -> DataFrame:
    """The references that a scalar subquery in an expression stands for.

    ``scalars(stmt_id, scope_id, expr_id, sub_scope_id, subquery)``: the
    subquery's text, the scope it is written in and its own scope, whose
    relations and projections are in the catalog like those of any scope.
    Its select list is read inside (scope ``sub_scope_id``); dotted
    references anywhere in its text whose alias is no relation or CTE
    (``ctes(stmt_id, scope_id, alias)``) of its own are read outside, once
    for each time they are written.  Returns (stmt_id, expr_id, scope_id,
    ref), ready as seeds of ``resolve_refs``.
    """
    inside = scalars.select("stmt_id", "expr_id", F.col("sub_scope_id").alias("scope_id")).join(
        projections.select("stmt_id", "scope_id", "expression"), ["stmt_id", "scope_id"]) \
        .select("stmt_id", "expr_id", "scope_id", F.explode(column_refs("expression")).alias("ref"))
    own = relations.select("stmt_id", F.col("scope_id").alias("sub_scope_id"), F.upper("alias").alias("_alias"))
    if ctes is not None:
        own = own.union(ctes.select("stmt_id", "scope_id", F.upper("alias")))
    outside = scalars.select("stmt_id", "expr_id", "scope_id", "sub_scope_id",
                             F.explode(column_refs("subquery")).alias("ref")) \
        .where(F.col("ref").contains(".")).withColumn("_alias", F.split("ref", r"\.", 2)[0]) \
        .join(own, ["stmt_id", "sub_scope_id", "_alias"], "left_anti") \
        .select("stmt_id", "expr_id", "scope_id", "ref")
    return inside.unionByName(outside)


def unresolved_report(resolved: DataFrame, seeds: DataFrame, cat: Catalog, samples: int = 10) -> DataFrame:
    """Per unresolved result: reason, the seed's scope, up to ``samples``
    relation aliases and projection names of that scope (first by order),
    and projection names containing the column's first four letters (up to 5).

    Lists are sliced from per-scope arrays built by a window group limit, so
    no scope's full list is collected.
    """
    un = resolved.where(F.col("source_type") == "UNRESOLVED").join(
        seeds.select("stmt_id", F.col("root_ord").cast("long").alias("root_ord"), "scope_id"),
        ["stmt_id", "root_ord"], "left")
    wr = Window.partitionBy("stmt_id", "scope_id").orderBy("ord")
    rels = (cat.relations.withColumn("_r", F.row_number().over(wr)).where(F.col("_r") <= samples)
            .groupBy("stmt_id", "scope_id").agg(F.array_join(F.array_sort(F.collect_list(
                F.struct("_r", "alias"))).getField("alias"), ", ").alias("relations")))
    wp = Window.partitionBy("stmt_id", "scope_id").orderBy("pos")
    projs = (cat.proj.withColumn("_r", F.row_number().over(wp)).where(F.col("_r") <= samples)
             .groupBy("stmt_id", "scope_id").agg(F.array_join(F.array_sort(F.collect_list(
                 F.struct("_r", "output_name"))).getField("output_name"), ", ").alias("projections")))
    stem = F.substring(F.regexp_replace("column_name", r"^.*\.", ""), 1, 4)
    similar = (un.select("stmt_id", "root_ord", "scope_id", "column_name", stem.alias("_stem")).distinct()
               .join(cat.proj.select("stmt_id", "scope_id", "output_name", "pos"), ["stmt_id", "scope_id"])
               .where((F.col("_stem") != "") & F.col("output_name").contains(F.col("_stem"))))
    ws = Window.partitionBy("stmt_id", "root_ord", "column_name").orderBy("pos")
    similar = (similar.withColumn("_r", F.row_number().over(ws)).where(F.col("_r") <= 5)
               .groupBy("stmt_id", "root_ord", "column_name").agg(F.array_join(F.array_sort(F.collect_list(
                   F.struct("_r", "output_name"))).getField("output_name"), ", ").alias("similar")))
    return (un.join(rels, ["stmt_id", "scope_id"], "left").join(projs, ["stmt_id", "scope_id"], "left")
            .join(similar, ["stmt_id", "root_ord", "column_name"], "left")
            .select("stmt_id", "root_ord", "scope_id", "column_name", "reason",
                    F.coalesce("relations", F.lit("")).alias("relations"),
                    F.coalesce("projections", F.lit("")).alias("projections"),
                    F.coalesce("similar", F.lit("")).alias("similar")))
