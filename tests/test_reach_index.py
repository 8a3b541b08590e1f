"""Reach index against plain walks."""

import random

import pytest

from columbine.operators import reach_index as R
from columbine.operators.closure import reach


def closure_of(edges, start):
    seen, todo = set(start), list(start)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def graph(seed, nodes, count):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}") for _ in range(count)]


# two cycles joined by a path, a node on itself, a diamond, repeated edges
KNOTS = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("f", "g"), ("g", "g"),
         ("g", "h"), ("g", "i"), ("h", "j"), ("i", "j"), ("x", "a"), ("x", "a"), ("y", "j")]


@pytest.mark.parametrize("edges", [KNOTS, graph(2, 14, 24)], ids=["knots", "random"])
def test_index_equals_walk(spark, edges):
    df = spark.createDataFrame(edges, "src_n string, dst_n string")
    names = sorted({x for e in edges for x in e} | {"nowhere"})
    seeds = spark.createDataFrame([(n, n) for n in names], "seed string, n string")
    index = R.build(spark, df, ["n"])
    got = [tuple(r) for r in index.reached(seeds, ["seed"]).collect()]
    want = {(n, m) for n in names for m in closure_of(edges, [n])}
    assert len(got) == len(set(got)) and set(got) == want
    ends = spark.createDataFrame([(a, b) for a in names for b in names], "n string, end string")
    assert {(r.n, r.end) for r in index.leads_to(ends, ["end"]).where("leads_to").collect()} == want


def test_seed_of_several_nodes_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame(KNOTS, "src_n string, dst_n string")
    R.build(spark, df, ["n"]).save(str(tmp_path / "index"))
    index = R.load(spark, str(tmp_path / "index"))
    seeds = spark.createDataFrame([("s", "h"), ("s", "i"), ("s", "h"), ("t", "y")], "seed string, n string")
    got = sorted(tuple(r) for r in index.reached(seeds, ["seed"]).collect())
    assert got == [("s", "h"), ("s", "i"), ("s", "j"), ("t", "j"), ("t", "y")]


def test_nulls_and_no_edges(spark):
    df = spark.createDataFrame([("a", None, "b", "1"), ("b", "1", None, None)],
                               "src_t string, src_f string, dst_t string, dst_f string")
    seeds = spark.createDataFrame([("a", None)], "t string, f string").selectExpr("'s' seed", "t", "f")
    got = {(r.t, r.f) for r in R.build(spark, df, ["t", "f"]).reached(seeds, ["seed"]).collect()}
    assert got == {("a", None), ("b", "1"), (None, None)}
    none = R.build(spark, df.limit(0), ["t", "f"])
    assert [(r.t, r.f) for r in none.reached(seeds, ["seed"]).collect()] == [("a", None)]
    assert none.reached(seeds.limit(0), ["seed"]).count() == 0


def test_label_rows_of_a_path(spark):
    """A path is one chain: a label row per node, not one per node reached."""
    edges = spark.range(40).selectExpr("id as src_n", "id + 1 as dst_n")
    index = R.build(spark, edges, ["n"])
    assert index.labels.count() == 41 and index.members.select("chain").distinct().count() == 1
    seeds = spark.createDataFrame([(0, 7)], "seed long, n long")
    assert index.reached(seeds, ["seed"]).count() == 34


def test_index_equals_reach_on_the_cyclic_table(spark, sf):
    from columbine.operators import graph as G
    from columbine.plans.delta_queries import mappings

    m = mappings(spark, sf, "map_cyclic")
    edges = G._field_graph(m, True)
    seeds = G.leaf_fields(m).selectExpr("seed_table", "seed_field", "seed_table as t", "seed_field as f")
    cols = ["seed_table", "seed_field", "t", "f"]
    walk = reach(spark, edges, seeds, ["t", "f"], ["seed_table", "seed_field"]).select(*cols)
    got = R.build(spark, edges, ["t", "f"]).reached(seeds, ["seed_table", "seed_field"]).select(*cols)
    assert got.count() == walk.count() and got.exceptAll(walk).isEmpty()
