"""Reach index: which nodes a node leads to, as a join of labels.

``reach`` (``closure.py``) walks from its seeds, one round per edge of the
longest path, for every request.  The index is built once per graph and
direction and then answers any selection of seeds with four joins, however
long the paths are; it is two tables that ``save`` writes and ``load`` reads.

Method
------
1. *Components of mutual reach.*  Edges whose ends lack an edge in or out are
   peeled.  On what is left every node takes the largest id that leads to it
   (forward marking); the nodes that lead back to the node of that id over
   nodes of the same mark (backward marking) are its component.  Components are
   taken out and the rest is marked again until no edge is left.
2. *Chains.*  The graph of components has no cycle.  Its nodes are laid on
   disjoint paths (chains): each proposes itself to its deepest free successor,
   which takes the one of the smallest id.  Pointer jumping numbers the places.
3. *Labels.*  From the sinks upwards, a component's label names for every chain
   it leads to the first place reached there: all places behind it are reached
   too.  A round hands its labels to the predecessors of its level, written
   in a folder partitioned by the level that reads them, so each contribution is
   written once and read once.

A label has one row per chain reached instead of one per node reached.  The
rounds are bounded by the longest path of components (peeling, levels, labels)
and by the widest component (marking); every round is joins and aggregations on
long ids, cut with ``checkpoint()``.

Repeated edges and rows count once; an edge from a node to itself changes
nothing; a null in a key column is a value like any other; without edges every
seed leads to itself only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from columbine.session import RoundState, ensure_checkpoint_dir

#: Rounds of proposals.  More of them make fewer chains and so shorter labels;
#: the answers are the same with any number.
CHAIN_ROUNDS = 3


def _same(left: DataFrame, right: DataFrame, cols: list[str], other: list[str] | None = None) -> Column:
    """Null-safe equality of key columns."""
    cond = F.lit(True)
    for a, b in zip(cols, other or cols):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


@dataclass
class ReachIndex:
    """``members``: node columns, comp, chain, pos.  ``labels``: comp, chain, first."""

    node_cols: list[str]
    members: DataFrame
    labels: DataFrame

    def reached(self, seeds: DataFrame, seed_cols: list[str]) -> DataFrame:
        """Distinct (seed_cols, node_cols): every node that a start node of the
        seed leads to, the start nodes themselves included.

        ``seeds`` has ``seed_cols`` and ``node_cols``, several start nodes per
        seed if need be.  Work grows with the labels and nodes of these seeds.
        """
        s = seeds.select(*seed_cols, *self.node_cols).distinct()
        place = self.members.select(*[F.col(c).alias(f"_{c}") for c in self.node_cols], "comp")
        at = s.join(place, _same(s, place, self.node_cols, [f"_{c}" for c in self.node_cols]), "left")
        first = at.where("comp is not null").select(*seed_cols, "comp").distinct().join(self.labels, "comp") \
            .groupBy(*seed_cols, "chain").agg(F.min("first").alias("first"))
        m = self.members.select(*self.node_cols, "chain", "pos")
        known = first.join(m, "chain").where("pos >= first").select(*seed_cols, *self.node_cols)
        return known.unionByName(at.where("comp is null").select(*seed_cols, *self.node_cols))

    def leads_to(self, pairs: DataFrame, end_cols: list[str]) -> DataFrame:
        """``pairs`` (node_cols, and the end's ``end_cols`` in the same order) with
        ``leads_to``: whether the node is the end or leads to it.  No path is walked."""
        a = self.members.select(*[F.col(c).alias(f"_a_{c}") for c in self.node_cols], F.col("comp").alias("_comp"))
        b = self.members.select(*[F.col(c).alias(f"_b_{c}") for c in self.node_cols], F.col("chain").alias("_chain"),
                                F.col("pos").alias("_pos"))
        own = F.lit(True)
        for x, y in zip(self.node_cols, end_cols):
            own = own & F.col(x).eqNullSafe(F.col(y))
        p = pairs.join(a, _same(pairs, a, self.node_cols, [f"_a_{c}" for c in self.node_cols]), "left")
        p = p.join(b, _same(p, b, end_cols, [f"_b_{c}" for c in self.node_cols]), "left")
        lab = self.labels.select(F.col("comp").alias("_comp"), F.col("chain").alias("_chain"), "first")
        return p.join(lab, ["_comp", "_chain"], "left").select(
            *pairs.columns, (own | F.coalesce(F.col("_pos") >= F.col("first"), F.lit(False))).alias("leads_to"))

    def save(self, folder: str) -> None:
        """Write both tables, labels in order of component within a file."""
        self.members.write.mode("overwrite").parquet(f"{folder}/members")
        self.labels.sortWithinPartitions("comp", "chain").write.mode("overwrite").parquet(f"{folder}/labels")


def load(spark: SparkSession, folder: str) -> ReachIndex:
    """A saved index."""
    members = spark.read.parquet(f"{folder}/members")
    return ReachIndex([c for c in members.columns if c not in ("comp", "chain", "pos")], members,
                      spark.read.parquet(f"{folder}/labels"))


def _inner(state: RoundState, e: DataFrame) -> DataFrame:
    """Edges (a, b) left when edges at nodes without an edge in or out are peeled."""
    n = e.count()
    while n:
        core = e.select(F.col("a").alias("id")).distinct().join(e.select(F.col("b").alias("id")).distinct(), "id")
        core = state.keep(core)
        e = state.keep(e.join(core.withColumnRenamed("id", "a"), "a", "left_semi")
                       .join(core.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
        before, n = n, e.count()
        if n == before:
            break
    return e


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, comp) of every node that lies on a cycle or was marked with one;
    ``edges`` has long columns ``a`` and ``b``.  Other nodes are components of
    their own and not listed."""
    state = RoundState(spark)
    return _components(spark, state, state.keep(edges.where("a <> b").select("a", "b").distinct()))


def _components(spark: SparkSession, state: RoundState, edges: DataFrame) -> DataFrame:
    """``components`` of distinct edges between different nodes."""
    e = _inner(state, edges)
    parts = []
    while not e.isEmpty():
        mark = state.keep(e.select(F.col("a").alias("id")).distinct()
                          .select("id", F.col("id").alias("mark"), F.lit(True).alias("new")))
        while not mark.where("new").isEmpty():
            step = mark.where("new").join(e, F.col("id") == F.col("a")).groupBy("b").agg(F.max("mark").alias("cand"))
            mark = state.keep(mark.join(step, mark["id"] == step["b"], "left").select(
                "id", F.greatest("mark", "cand").alias("mark"),
                F.coalesce(F.col("cand") > F.col("mark"), F.lit(False)).alias("new")))
        m = mark.select("id", "mark")
        same = state.keep(e.join(m.toDF("a", "_ma"), "a").join(m.toDF("b", "_mb"), "b").where("_ma = _mb").select("a", "b"))
        back = state.keep(m.withColumns({"found": F.col("id") == F.col("mark"), "new": F.col("id") == F.col("mark")}))
        while not back.where("new").isEmpty():
            step = back.where("new").select(F.col("id").alias("b")).join(same, "b").select(F.col("a").alias("id")).distinct()
            step = step.withColumn("hit", F.lit(True))
            back = state.keep(back.join(step, "id", "left").select(
                "id", "mark", (F.col("found") | F.col("hit").isNotNull()).alias("found"),
                (~F.col("found") & F.col("hit").isNotNull()).alias("new")))
        found = back.where("found").select("id", F.col("mark").alias("comp"))
        parts.append(found)
        e = _inner(state, state.keep(same.join(found.select(F.col("id").alias("a")), "a", "left_anti")
                                     .join(found.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b")))
    out = spark.createDataFrame([], "id long, comp long")
    for p in parts:
        out = out.unionByName(p)
    return out


def _levels(state: RoundState, comps: DataFrame, e: DataFrame) -> tuple[DataFrame, int]:
    """(comp, level): edges on the longest path to a sink; and the highest level.

    A round moves only components that an edge leads from to one of the last
    level, with the number of such edges met so far.
    """
    open_ = state.keep(e.groupBy(F.col("a").alias("comp")).agg(F.count(F.lit(1)).alias("open")))
    front = state.keep(comps.join(open_, "comp", "left_anti"))
    out, met, level = front.withColumn("level", F.lit(0)), None, 0
    while True:
        shut = front.select(F.col("comp").alias("b")).join(e, "b").groupBy(F.col("a").alias("comp")) \
            .agg(F.count(F.lit(1)).alias("n"))
        if met is not None:
            shut = met.unionByName(shut).groupBy("comp").agg(F.sum("n").alias("n"))
        moved = state.keep(shut.join(open_, "comp"))
        front, met = moved.where("n = open").select("comp"), moved.where("n < open").select("comp", "n")
        if front.isEmpty():
            return state.keep(out), level
        level += 1
        out = out.unionByName(front.withColumn("level", F.lit(level)))


def _chains(state: RoundState, levels: DataFrame, e: DataFrame) -> DataFrame:
    """(comp, chain, pos): disjoint paths over all components.  ``e`` has the
    level of ``b`` as ``lb``."""
    links, free = None, e.select("a", "b", "lb")
    for _ in range(CHAIN_ROUNDS):
        wish = free.groupBy("a").agg(F.max_by("b", F.struct("lb", "b")).alias("b"))
        got = state.keep(wish.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        if got.isEmpty():
            break
        links = got if links is None else links.unionByName(got)
        free = state.keep(free.join(got.select("a"), "a", "left_anti").join(got.select("b"), "b", "left_anti"))
    if links is None:
        return levels.select("comp", F.col("comp").alias("chain"), F.lit(0).cast("long").alias("pos"))
    p = levels.select("comp").join(links.select(F.col("b").alias("comp"), "a"), "comp", "left").select(
        "comp", F.coalesce("a", "comp").alias("ptr"), F.when(F.col("a").isNull(), 0).otherwise(1).cast("long").alias("pos"),
        F.col("a").isNull().alias("done"))
    p = state.keep(p)
    while not p.where("not done").isEmpty():
        far = p.select(F.col("comp").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("pos").alias("_pos"),
                       F.col("done").alias("_done"))
        moved = p.where("not done").join(far, "ptr").select(
            "comp", F.col("_ptr").alias("ptr"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_done").alias("done"))
        p = state.keep(p.where("done").unionByName(moved))
    return p.select("comp", F.col("ptr").alias("chain"), "pos")


def _number(state: RoundState, edges: DataFrame, node_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node_cols, id) of every node, and the edges as distinct (a, b) of ids, ``a <> b``.

    An id is the hash of the node's columns, so edges are numbered where they are
    read.  Should two nodes have one hash, all get numbers instead, by joins.
    """
    src, dst = [f"src_{k}" for k in node_cols], [f"dst_{k}" for k in node_cols]
    # the hash passes nulls over, so whether there is one is hashed too
    hashed = lambda cols: F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])
    nodes = edges.select(*src).toDF(*node_cols).union(edges.select(*dst).toDF(*node_cols)).distinct()
    named = state.keep(nodes.withColumn("id", hashed(node_cols)))
    if named.groupBy("id").count().where("count > 1").isEmpty():
        return named, state.keep(edges.select(hashed(src).alias("a"), hashed(dst).alias("b")).where("a <> b").distinct())
    # ids are fixed by the written table, not by the plan that numbers it
    nodes = state.keep(named.select(*node_cols).withColumn("id", F.monotonically_increasing_id()))
    a = nodes.select(*[F.col(k).alias(f"_a_{k}") for k in node_cols], F.col("id").alias("a"))
    b = nodes.select(*[F.col(k).alias(f"_b_{k}") for k in node_cols], F.col("id").alias("b"))
    pairs = edges.select(*src, *dst).distinct()
    ids = pairs.join(a, _same(pairs, a, src, [f"_a_{k}" for k in node_cols]))
    return nodes, state.keep(ids.join(b, _same(ids, b, dst, [f"_b_{k}" for k in node_cols])).select("a", "b").where("a <> b"))


def _labels(spark: SparkSession, state: RoundState, place: DataFrame, e: DataFrame, top: int) -> DataFrame:
    """(comp, chain, first): the first place on each chain that a component leads to.

    ``place(comp, chain, pos, level)``, ``e(a, la, b, lb)``; an edge leads to a
    lower level, and every level up to ``top`` but the first has one.
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reach-{uuid.uuid4().hex}"
    labels = None
    for level in range(top + 1):
        own = place.where(F.col("level") == level).select("comp", "chain", F.col("pos").alias("first"))
        if level:
            handed = spark.read.schema("comp long, chain long, first long").parquet(f"{folder}/la={level}")
            own = own.unionByName(handed).groupBy("comp", "chain").agg(F.min("first").alias("first"))
        own = state.keep(own)
        labels = own if labels is None else labels.unionByName(own)
        up = e.where(F.col("lb") == level).select(F.col("b").alias("comp"), "a", "la").join(own, "comp")
        if level < top:
            up.groupBy(F.col("a").alias("comp"), "la", "chain").agg(F.min("first").alias("first")) \
                .write.partitionBy("la").mode("append").parquet(folder)
    return labels


def _build(spark: SparkSession, edges: DataFrame, node_cols: list[str], both: bool) -> tuple[ReachIndex, ReachIndex | None]:
    state = RoundState(spark)
    nodes, ids = _number(state, edges, node_cols)
    # few nodes lie on a cycle: the others keep their ids, and their edges stay as they are
    found = state.keep(_components(spark, state, ids))
    at = ids.join(found.toDF("a", "ca"), "a", "left").join(found.toDF("b", "cb"), "b", "left")
    outside = F.col("ca").isNull() & F.col("cb").isNull()
    inside = at.where(~outside).select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    e = state.keep(at.where(outside).select("a", "b").unionByName(inside.where("a <> b").distinct()))
    comps = nodes.select(F.col("id").alias("comp")).join(found.select(F.col("id").alias("comp")), "comp", "left_anti") \
        .unionByName(found.select("comp").distinct())
    levels, top = _levels(state, comps, e)
    e = state.keep(e.join(levels.toDF("a", "la"), "a").join(levels.toDF("b", "lb"), "b").select("a", "la", "b", "lb"))
    place = state.keep(_chains(state, levels, e).join(levels, "comp"))
    members = state.keep(nodes.join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
                         .join(place.select("comp", "chain", "pos"), "comp").select(*node_cols, "comp", "chain", "pos"))
    forward = ReachIndex(node_cols, members, _labels(spark, state, place, e, top))
    if not both:
        return forward, None
    # against the edges a chain runs the other way, and the levels are met from their top
    other = place.withColumns({"pos": -F.col("pos"), "level": F.lit(top) - F.col("level")})
    turned = e.select(F.col("b").alias("a"), (F.lit(top) - F.col("lb")).alias("la"),
                      F.col("a").alias("b"), (F.lit(top) - F.col("la")).alias("lb"))
    return forward, ReachIndex(node_cols, members.withColumn("pos", -F.col("pos")), _labels(spark, state, other, turned, top))


def build(spark: SparkSession, edges: DataFrame, node_cols: list[str]) -> ReachIndex:
    """Index of the graph of ``edges`` (``src_<k>`` and ``dst_<k>`` per node
    column) in the direction of its edges."""
    return _build(spark, edges, node_cols, False)[0]


def build_both(spark: SparkSession, edges: DataFrame, node_cols: list[str]) -> tuple[ReachIndex, ReachIndex]:
    """The indexes along and against ``edges``: ids, components, levels and
    chains are found once, only the labels differ."""
    forward, backward = _build(spark, edges, node_cols, True)
    return forward, backward
