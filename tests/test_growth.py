"""Work that has to grow no faster than the tables: shared traces, indexes and evenly dealt rounds."""

import pytest

from columbine.operators import dml, graph, reach_index
from columbine.session import RoundState

MAP = "source_table string, source_field string, dest_table string, dest_field string, rules string, mapping_type string, object_name string"


def _maps(spark, edges):
    return spark.createDataFrame([(*a, *b, "", "MAP", "o") for a, b in edges], MAP)


def _hops(edges, seed):
    at, front, hop = {seed: 0}, {seed}, 0
    while front:
        hop += 1
        front = {b for a, b in edges if a in front} - set(at)
        at |= dict.fromkeys(front, hop)
    return at


@pytest.mark.parametrize("rounds", [None, 0, 1, 2])
def test_seeds_with_one_successor_share_its_walk(spark, monkeypatch, rounds):
    # T.A and T.B lead to U.C only; T.D leads two ways; U.C, V.E and U.C go round; W.Z leads nowhere
    edges = [(("T", "A"), ("U", "C")), (("T", "B"), ("U", "C")), (("T", "D"), ("U", "C")), (("T", "D"), ("V", "E")),
             (("U", "C"), ("V", "E")), (("V", "E"), ("U", "C")), (("V", "E"), ("X", "Y"))]
    seeds = [("T", "A"), ("T", "B"), ("T", "D"), ("U", "C"), ("W", "Z"), ("T", "A")]
    walks, real = [], graph.reach

    def counted(spark, e, s, *args, **kw):
        walks.append(s.count())
        return real(spark, e, s, *args, **kw)

    monkeypatch.setattr(graph, "reach", counted)
    got = graph.trace_fields(spark, _maps(spark, edges), spark.createDataFrame(seeds, "seed_table string, seed_field string"),
                             upstream=False, max_rounds=rounds)
    want = sorted((*s, *a, *b, h) for s in set(seeds) for n, h in _hops(edges, s).items()
                  if rounds is None or h <= rounds for a, b in edges if a == n)
    assert sorted((r[0], r[1], r[2], r[3], r[4], r[5], r["hop"]) for r in got.collect()) == want
    if rounds is None:
        assert sorted(walks) == [2, 2]  # T.D and W.Z; U.C (for T.A and T.B) and V.E (for U.C)


def _index_rows(index, spark, nodes):
    seeds = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(nodes)], "seed int, t string, f string")
    return {(r.seed, r.t, r.f) for r in index.reached(seeds, ["seed"]).collect()}


@pytest.mark.parametrize("clash", [False, True])
def test_both_directions_from_one_pass(spark, monkeypatch, clash):
    edges = [(("A", "1"), ("B", "1")), (("B", "1"), ("C", "1")), (("C", "1"), ("B", "1")), (("C", "1"), ("D", "1")),
             (("A", "2"), ("D", "1")), (("D", "1"), ("E", "1")), (("A", "1"), ("E", "1")), (("F", "1"), ("F", "1")),
             ((None, "x"), ("x", None)), (("x", None), ("E", "1"))]
    if clash:  # all nodes have one hash
        monkeypatch.setattr(reach_index.F, "xxhash64", lambda *c: reach_index.F.lit(7).cast("long"))
    df = spark.createDataFrame([(*a, *b) for a, b in edges], "src_t string, src_f string, dst_t string, dst_f string")
    along, against = reach_index.build_both(spark, df, ["t", "f"])
    nodes = sorted({n for e in edges for n in e}, key=str)
    back = [(b, a) for a, b in edges]
    assert _index_rows(along, spark, nodes) == {(i, *n) for i, s in enumerate(nodes) for n in _hops(edges, s)}
    assert _index_rows(against, spark, nodes) == {(i, *n) for i, s in enumerate(nodes) for n in _hops(back, s)}


def test_small_rounds_are_dealt_over_cores(spark):
    kept = RoundState(spark).keep(spark.range(100_000).repartition("id"))
    assert kept.rdd.getNumPartitions() > 1


def test_join_key_items_are_taken_apart_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(dml, "join_key_items", lambda *a: spark.range(3).selectExpr(
        "id as stmt_id", "id as root_ord", "0 as scope_id", "'A.B' as ref"))
    monkeypatch.setattr(dml, "resolve_refs", lambda *a, **k: None)
    monkeypatch.setattr(dml, "join_key_rows", lambda items, res: kept.append(items))
    dml.explode_join_keys(spark, None, None, None)
    assert "Range" not in kept[0]._jdf.queryExecution().optimizedPlan().toString()
