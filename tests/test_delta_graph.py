"""Delta and graph operators: properties and small exact cases."""

import json

from pyspark.sql import functions as F

from columbine.operators import delta as D
from columbine.operators import graph as G
from columbine.operators.closure import ordered_index
from columbine.plans.delta_queries import mappings


def test_delta_self_is_unchanged(spark, sf):
    v = mappings(spark, sf, "map_v1")
    d = D.mapping_delta(v, v)
    assert {r[0] for r in d.select("change_type").distinct().collect()} == {"unchanged"}


def test_delta_mirrors(spark, sf):
    a, b = mappings(spark, sf, "map_v1"), mappings(spark, sf, "map_v2")
    ab = D.delta_summary(D.mapping_delta(a, b)).first()
    ba = D.delta_summary(D.mapping_delta(b, a)).first()
    assert (ab.added_count, ab.removed_count) == (ba.removed_count, ba.added_count)
    assert (ab.modified_count, ab.unchanged_count) == (ba.modified_count, ba.unchanged_count)


def test_last_mapping_wins(spark):
    df = spark.createDataFrame(
        [("A", "F", "B", "G", "r1", "MAP", "o", 1), ("A", "F", "B", "G", "r2", "MAP", "o", 5),
         ("A", "F", "B", "G", "r3", "MAP", "o", 3)],
        "source_table string, source_field string, dest_table string, dest_field string, rules string, "
        "mapping_type string, object_name string, row_ord long")
    r = D.last_mapping(df).first()
    assert (r.rules, r.copies) == ("r2", 3)


def _edges(spark, pairs):
    rows = [(s, "F", d, "F", "", "MAP", "o", i) for i, (s, d) in enumerate(pairs)]
    return spark.createDataFrame(rows, "source_table string, source_field string, dest_table string, "
                                       "dest_field string, rules string, mapping_type string, object_name string, "
                                       "row_ord long")


def test_cycle_trace_ends_and_contains_seed(spark):
    m = _edges(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")])
    seeds = spark.createDataFrame([("D", "F")], "seed_table string, seed_field string")
    up = G.trace_fields(spark, m, seeds, upstream=True)
    got = {(r.source_table, r.dest_table) for r in up.collect()}
    assert got == {("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")}
    down = G.trace_fields(spark, m, spark.createDataFrame([("A", "F")], "seed_table string, seed_field string"),
                          upstream=False)
    assert ("C", "D") in {(r.source_table, r.dest_table) for r in down.collect()}


def test_depth_dag_and_cycle(spark):
    m = _edges(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("X", "Y")])
    d = {r.table_name: r.depth for r in G.table_depth(spark, m).collect()}
    assert d == {"A": 0, "B": 1, "C": 2, "X": 0, "Y": 1}
    for s, t in [("A", "B"), ("B", "C"), ("A", "C")]:
        assert d[t] > d[s]
    cyc = _edges(spark, [("R", "A"), ("A", "B"), ("B", "A")])
    dc = {r.table_name: r.depth for r in G.table_depth(spark, cyc).collect()}
    assert dc == {"R": 0, "A": 1, "B": 2}
    leaves = [("R", f"L{i}") for i in range(40)] + [("B", "Z"), ("S", "S"), ("P", "Q"), ("Q", "P")]
    more = _edges(spark, [("R", "A"), ("A", "B"), ("B", "A"), *leaves])
    dm = {r.table_name: r.depth for r in G.table_depth(spark, more).collect()}
    assert {k: dm[k] for k in dc} == dc  # unrelated tables change nothing
    assert dm["Z"] == 3 and dm["S"] == dm["P"] == dm["Q"] == 0 and dm["L7"] == 1


def test_ordered_index_matches_window(spark, sf):
    from pyspark.sql import Window

    m = mappings(spark, sf, "map_v1")
    got = G.field_edges(m).select("source_table", "dest_table", "source_field", "dest_field", "edge_index", "edge_size")
    w = Window.partitionBy("source_table", "dest_table").orderBy(
        "source_field", "dest_field", "rules", "mapping_type", "object_name")
    want = m.select("source_table", "dest_table", "source_field", "dest_field",
                    (F.row_number().over(w) - 1).cast("long").alias("edge_index"),
                    F.count(F.lit(1)).over(Window.partitionBy("source_table", "dest_table")).cast("long")
                    .alias("edge_size"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_group_index(spark):
    rows = [("HOT", f"k{i:05d}") for i in range(3000)] + [("COLD", "a"), ("COLD", "b")]
    df = spark.createDataFrame(rows, "g string, k string")
    out = ordered_index(df, ["g"], ["k"], partitions=8)
    hot = sorted(r.idx for r in out.where("g = 'HOT'").collect())
    assert hot == list(range(3000))
    assert {r.group_size for r in out.where("g = 'COLD'").collect()} == {2}


def test_neighbourhood_two_hops(spark):
    m = _edges(spark, [("A", "B"), ("B", "C"), ("X", "B"), ("C", "D")])
    seeds = spark.createDataFrame([("B",)], "seed_table string")
    got = {(r.source_table, r.dest_table) for r in G.neighbourhood(m, seeds).collect()}
    assert got == {("A", "B"), ("X", "B"), ("B", "C"), ("C", "D")}


def test_graph_json_whole(spark, sf):
    """Config, tables, columns, both versions' edges and mappings and every delta row are in the output."""
    from columbine.plans.registry import QUERIES
    from columbine.sources import fixtures as fx

    out = {}
    for r in QUERIES["graph_json"].build(spark, sf).collect():
        out.setdefault(r.kind, []).append(json.loads(r.json))
    v = {"V1": mappings(spark, sf, "map_v1"), "V2": mappings(spark, sf, "map_v2")}
    pair = ("source_table", "dest_table")
    key = ("source_table", "source_field", "dest_table", "dest_field", "rules", "mapping_type", "object_name")
    for kind, cols in (("edge", pair), ("mapping", key)):
        want = [(n, *r) for n, m in v.items() for r in (
            m.select(*cols).distinct() if kind == "edge" else m.select(*cols)).collect()]
        assert sorted((x["version"], *[x[c] for c in cols]) for x in out[kind]) == sorted(want)
    assert {x["version"] for x in out["edge"]} == {"V1", "V2"}
    delta = [{k: x for k, x in r.asDict().items() if x is not None} for r in D.mapping_delta(v["V1"], v["V2"]).collect()]
    assert sorted(map(json.dumps, out["delta_mapping"])) == sorted(map(json.dumps, delta))
    tables = {r[0] for r in G.all_tables(*v.values()).collect()}
    assert sorted(x["table_name"] for x in out["node"]) == sorted(tables)
    catalog = fx.spark_fixture(spark, sf, "column_catalog").select("table_name", "column_name").collect()
    assert sorted((x["table_name"], x["column_name"]) for x in out["column"]) == sorted(
        tuple(r) for r in catalog if r.table_name in tables)
    assert out["config"] == [{"v1_name": "Version 1", "v2_name": "Version 2", "has_v2": True, "has_delta": True,
                              "table_count": len(tables)}]
    assert out["delta"] == [D.delta_summary(D.mapping_delta(v["V1"], v["V2"])).first().asDict()]


def test_graph_json_one_version(spark, sf):
    from columbine.operators.report import graph_json

    m = mappings(spark, sf, "map_v1")
    rows = graph_json(m).collect()
    assert {r.kind for r in rows} == {"config", "node", "edge", "mapping"}
    config = [json.loads(r.json) for r in rows if r.kind == "config"][0]
    assert config["v2_name"] is None and not config["has_v2"] and not config["has_delta"]
