"""Substring index against plain ``in``."""

import random

from columbine.operators import substring_index as S


def test_equals_contains(spark, tmp_path):
    rnd = random.Random(5)
    word = lambda a, b: "".join(rnd.choice("abAB_.é") for _ in range(rnd.randint(a, b)))
    texts = [word(0, 14) for _ in range(300)] + ["x" * 5000 + "yz", "", None]
    terms = [word(1, 6) for _ in range(120)] + ["", "  ", None, "zzz", "xxyz", " AB ", "x" * 40, "ab", "ab"]
    index = S.build(spark.createDataFrame([(t,) for t in texts], "name string"), "name")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    want = {(k, x.lower()) for k in {(y or "").strip().lower() for y in terms} - {""} for x in texts if x and k in x.lower()}
    got = [tuple(r) for r in index.lookup(t).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    index.save(str(tmp_path))
    assert {tuple(r) for r in S.load(spark, str(tmp_path)).lookup(t).collect()} == want


def test_empty(spark):
    none = spark.createDataFrame([], "term string")
    index = S.build(none, "term")
    assert index.lookup(spark.createDataFrame([("a",)], "term string")).count() == 0
    assert S.build(spark.createDataFrame([("ab",)], "term string"), "term").lookup(none).count() == 0


def test_candidates_grow_with_texts(spark, monkeypatch):
    """Numbers in numbers: what is compared is bounded by the texts, not by terms times texts; small and large head tables."""
    names = [f"t.k{k}" for k in range(1000, 4000)]
    terms = [f"k{k}" for k in range(1, 4000, 3)]
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    index = S.build(spark.createDataFrame([(x,) for x in names], "name string"), "name")
    want = {(k, x) for x in names for k in set(terms) if k in x}
    for heads in (S.HEADS, 0):
        monkeypatch.setattr(S, "HEADS", heads)
        found = index.lookup(t)
        assert {tuple(r) for r in found.collect()} == want
        assert "Contains(text" not in (plan := found._jdf.queryExecution().toString()) and "contains(text" not in plan.lower()


def test_every_name_is_a_term(spark, tmp_path):
    """search_terms: names met only as a source field, or only in V2, are terms too, and names of V1 that V2 has lost."""
    from columbine.plans import QUERIES
    from columbine.plans.delta_queries import mappings
    from columbine.plans.graph_queries import SEARCH_TERMS

    tables = {
        "orders": ([(1, 7, "F", "1-URGENT"), (23, 7, "O", "2-HIGH"), (456, 8, "P", "2-HIGH"), (23, 7, "O", "2-HIGH"),
                    (None, 8, "F", None), (45, None, "F", "5-LOW")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "customer": ([(7, 0, "AUTO"), (8, 1, "AUTO"), (None, 1, None)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "supplier": ([(61, 0), (62, None)], "s_suppkey long, s_nationkey int"),
        "nation": ([(0, 2), (1, 3)], "n_nationkey int, n_regionkey int"),
        "part": ([(91, "Brand#1"), (912, "Brand#1"), (39, None), (233, None)], "p_partkey long, p_brand string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    v1, v2 = (mappings(spark, str(tmp_path), v).collect() for v in ("map_v1", "map_v2"))
    entries = {("table", t, None, None) for r in v1 + v2 for t in (r.source_table, r.dest_table)} \
        | {("field", *e, None) for r in v2 for e in ((r.source_table, r.source_field), (r.dest_table, r.dest_field))} \
        | {("object", None, None, r.object_name) for r in v2 if r.object_name not in ("", "nan")}
    text = lambda e: (e[3] or e[1] + ("" if e[2] is None else f".{e[2]}")).lower()
    key = lambda e: (e[0] == "object", e[3] if e[1] is None else e[1], e[0] == "field", e[2] or "")
    terms = {n.strip().lower() for r in v1 + v2 for n in (r.object_name, r.source_field, r.dest_field)} | set(SEARCH_TERMS)
    want = {(t, i, *e) for t in terms - {""} for i, e in enumerate(sorted((e for e in entries if t in text(e)), key=key)[:15], 1)}
    got = [(r.term, r["rank"], r.kind, r.table_name, r.field_name, r.object_name)
           for r in QUERIES["search_terms"].build(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    found = {r[0] for r in got}
    assert {"k456", "k45", "k61", "k912", "t2t_c39", "k23"} <= found  # k912 and t2t_c39 only in V2, K23 only in V1 (part of K233)


def test_rows_are_sorted(spark):
    """Sequence as a number, nulls last, side and role."""
    from columbine.operators import report as P

    e = spark.createDataFrame([("f", "JOIN", "T", "A", "10", "R"), ("f", "JOIN", "T", "A", "9", "R"),
                               ("f", "JOIN", "T", "A", "9", "L"), ("f", "MAPPING", "T", "A", "", ""),
                               ("e", "MAPPING", "Z", "Z", "", ""), ("f", "JOIN", "S", "B", "11", "L")],
                              "sql_file string, row_type string, dest_table string, dest_field string, join_seq string, "
                              "join_side string")
    got = [(r.sql_file, r.row_type, r.dest_table, r.join_seq, r.join_side) for r in P.sort_edges(e).collect()]
    assert got == [("e", "MAPPING", "Z", "", ""), ("f", "JOIN", "S", "11", "L"), ("f", "JOIN", "T", "9", "L"),
                   ("f", "JOIN", "T", "9", "R"), ("f", "JOIN", "T", "10", "R"), ("f", "MAPPING", "T", "", "")]
    c = spark.createDataFrame([("f", "T", "A", None, "S", "X"), ("f", "T", "A", "CONSTANT", None, None),
                               ("f", None, "A", "PHYSICAL", "S", "X"), ("f", "T", "A", "CONSTANT", "S", "X")],
                              "sql_file string, dest_table string, dest_field string, source_type string, "
                              "source_table string, source_field string")
    got = [(r.dest_table, r.source_type, r.source_table) for r in P.sort_combined(c).collect()]
    assert got == [("T", "CONSTANT", "S"), ("T", "CONSTANT", None), ("T", None, "S"), (None, "PHYSICAL", "S")]
    x = spark.createDataFrame([("f", 10, "LEFT", "KEY"), ("f", 2, "RIGHT", "KEY"), ("f", 2, "LEFT", "KEY"),
                               ("f", 2, "LEFT", "FILTER")],
                              "sql_file string, join_seq int, join_side string, field_role string")
    got = [(r.join_seq, r.join_side, r.field_role) for r in P.sort_exploded(x).collect()]
    assert got == [(2, "LEFT", "FILTER"), (2, "LEFT", "KEY"), (2, "RIGHT", "KEY"), (10, "LEFT", "KEY")]
