"""Cases that once gave wrong rows or ended a job."""

from pyspark.sql import functions as F

from columbine.operators import dml as M
from columbine.operators.closure import ordered_index, reach
from columbine.sources.io import read_column_catalog, read_mappings


def test_ordered_index_keeps_payload(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("o"),
                                     F.concat(F.lit("p"), F.col("id")).alias("payload"))
    got = ordered_index(df, ["g"], ["o"], partitions=16).groupBy("g").agg(
        F.count_distinct("idx").alias("n"), F.max("idx").alias("m"), F.max("group_size").alias("size")).collect()
    assert all(r.n == r.size == r.m + 1 for r in got) and sum(r.n for r in got) == 200_000


def test_catalog_flags(spark):
    rows = [("t", c, f, "") for c, f in enumerate(["", " ", "PK", "Y", "false", "0", None, "No", "1"])]
    df = spark.createDataFrame(rows, "`Table Name` string, `Column Name` int, `Is PK` string, `Is FK` string")
    got = [r.is_pk for r in read_column_catalog(spark, df).orderBy("column_name").collect()]
    assert got == [False, False, True, True, False, False, False, False, True]


def test_long_set_clause_numbers(spark):
    rows = [(1, f"C{w}_{p}", w, p, "X", "UPDATE") for w in (0, 1) for p in range(2500)]
    df = spark.createDataFrame(rows, "stmt_id int, target_column string, when_ord int, pos int, expression string, "
                                     "clause_type string")
    got = M.number_assignments(M.first_assignment(df))
    assert got.select("ord").distinct().count() == 5000
    assert got.where("target_column = 'C1_0'").first().ord == 2501


def conjuncts(spark, conditions):
    rows = [(1, 0, 1, "LEFT", "", "B", i, c) for i, c in enumerate(conditions)]
    return spark.createDataFrame(rows, "stmt_id int, scope_id int, join_pos int, side string, kind string, "
                                       "right_alias string, conj_pos int, condition string")


def test_join_keys_of_oracle_names(spark):
    scopes = spark.createDataFrame([(1, 0, "ROOT")], "stmt_id int, scope_id int, scope_name string")
    c = conjuncts(spark, ["A.COL#1 = B.COL$1", 'A."x y" = B."z"', "(A.K = B.K)", "S.A.K2 = B.K2", "A.D >= B.D",
                          "A.P = B.P OR A.Q = B.Q", "A.R = 5"])
    rows = M.join_conditions(c, scopes).orderBy("conj_pos", "left_field").collect()
    assert [(r.left_table, r.left_field, r.right_table, r.right_field) for r in rows] == [
        ("A", "COL#1", "B", "COL$1"), ("A", "X Y", "B", "Z"), ("A", "K", "B", "K"), ("A", "K2", "B", "K2"),
        ("A", "P", "B", "P"), ("A", "Q", "B", "Q")]
    assert {r.join_filters for r in rows} == {"A.D >= B.D; A.P = B.P OR A.Q = B.Q; A.R = 5"}
    assert M.theta_joins(c).count() == 0


def test_merge_keys_are_equalities(spark):
    rows = [(1, i, "TGT", "T", "S", c) for i, c in enumerate(
        ["T.K = S.K", "T.L>=S.L", "T.X!=S.X", "T.Y <> S.Y", "T.N = NVL(S.N, 0)", "(T.Q=S.Q OR J = J2)"])]
    df = spark.createDataFrame(rows, "stmt_id int, conj_pos int, target_table string, target_alias string, "
                                     "using_alias string, condition string")
    got = [(r.left_table, r.left_field, r.right_table, r.right_field)
           for r in M.merge_on_keys(df).orderBy("join_seq").collect()]
    assert got == [("T", "K", "S", "K"), ("T", "N", "NVL(S", "N, 0)"), ("T", "Q", "S", "Q"), ("T", "J", "S", "J2")]


def test_direct_fallback_without_rows(spark):
    spec = spark.createDataFrame([(1, 1, True, "src", "c"), (1, 2, True, "src", "d"), (1, 3, False, "src", "e")],
                                 "stmt_id int, root_ord int, direct boolean, source_table string, source_column string")
    cols = ["source_type", "table_name", "column_name", "constant_value", "reason", "dm_match", "trace_path",
            "source_alias", "original_ref", "full_expression"]
    res = spark.createDataFrame([(1, 2, "UNRESOLVED", *[""] * 9)],
                                "stmt_id int, root_ord int, " + ", ".join(f"{c} string" for c in cols))
    dm = spark.createDataFrame([("SRC", "C")], "table_name string, column_name string")
    got = sorted((r.root_ord, r.column_name, r.dm_match) for r in M.direct_fallback(spec, res, dm).collect())
    assert got == [(1, "C", "Y"), (2, "D", "N")]


def test_reach_through_a_hub(spark):
    """A hub with a third of the edges: right answer, and a plan whose shuffles Spark may split."""
    spokes = spark.range(3000).select(F.lit("hub").alias("src_n"), F.concat(F.lit("s"), "id").alias("dst_n"))
    rest = spark.range(6000).select(F.concat(F.lit("s"), F.col("id") % 3000).alias("src_n"),
                                    F.concat(F.lit("t"), "id").alias("dst_n"))
    seeds = spark.createDataFrame([("hub", "hub"), ("s1", "s1")], "seed string, n string")
    got = {r.seed: r["count"] for r in reach(spark, spokes.union(rest), seeds, ["n"], ["seed"])
           .groupBy("seed").count().collect()}
    assert got == {"hub": 9001, "s1": 3}


def test_csv_rules_with_line_breaks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('source_table,source_field,dest_table,dest_field,rules\n'
                                    'a,b,c,d,"CASE\nWHEN ""x"" THEN 1"\n')
    rows = read_mappings(spark, str(tmp_path / "m.csv")).collect()
    assert len(rows) == 1 and rows[0].rules == 'CASE\nWHEN "x" THEN 1'


def visible(spark, scopes, relations):
    from columbine.operators import catalog as C

    s = C.with_defaults(spark.createDataFrame(
        scopes, "stmt_id int, scope_id int, parent_id int, scope_name string, kind string, branch_ord int"))
    r = spark.createDataFrame(relations, "stmt_id int, scope_id int, ord int, alias string, rel_kind string, "
                                         "table_name string, child_scope_id int")
    rows = C.visible_relations(s, r, C.scope_closure(spark, s)).collect()
    return {(x.scope_id, x.alias): x.table_name or x.child_scope_id for x in rows}


def test_unread_scopes_hide_nothing(spark):
    """An alias inside a CTE that nothing reads does not hide the parent's."""
    got = visible(spark, [(1, 0, None, "ROOT", "ROOT", None), (1, 1, 0, "ROOT/S", "SUBQUERY", None),
                          (1, 2, 1, "ROOT/S/CTE:W", "CTE", None)],
                  [(1, 0, 0, "A", "PHYSICAL", "RIGHT_T", None), (1, 0, 1, "S", "SCOPE", None, 1),
                   (1, 1, 0, "B", "PHYSICAL", "T_B", None), (1, 2, 0, "A", "PHYSICAL", "WRONG_T", None)])
    assert got[1, "A"] == "RIGHT_T" and got[1, "W"] == 2 and got[0, "B"] == "T_B"


def test_union_branch_aliases(spark):
    """Aliases of a union's branches are seen from the union, first branch first, before the parent's."""
    got = visible(spark, [(1, 0, None, "ROOT", "ROOT", None), (1, 1, 0, "ROOT/U", "UNION", None),
                          (1, 2, 1, "ROOT/U/B1", "UNION_BRANCH", 0), (1, 3, 1, "ROOT/U/B2", "UNION_BRANCH", 1)],
                  [(1, 0, 0, "U", "SCOPE", None, 1), (1, 0, 1, "P", "PHYSICAL", "OUTER_P", None),
                   (1, 2, 0, "P", "PHYSICAL", "T1", None), (1, 3, 0, "P", "PHYSICAL", "T2", None),
                   (1, 3, 1, "Q", "PHYSICAL", "T3", None)])
    assert got[1, "P"] == "T1" and got[1, "Q"] == "T3" and got[3, "P"] == "T2" and got[0, "P"] == "OUTER_P"


def test_asked_aliases_only(spark):
    """Only what is asked is matched, with the answers of the whole table."""
    from columbine.operators import catalog as C

    s = C.with_defaults(spark.createDataFrame(
        [(1, k, k - 1 if k else None, f"L{k}", "SUBQUERY" if k else "ROOT", None) for k in range(5)],
        "stmt_id int, scope_id int, parent_id int, scope_name string, kind string, branch_ord int"))
    r = spark.createDataFrame([(1, k, o, f"a{o}" if o else "X", "PHYSICAL", f"T{k}_{o}", None)
                               for k in range(5) for o in range(4)] +
                              [(1, k, 9, "SUB", "SCOPE", None, k + 1) for k in range(4)],
                              "stmt_id int, scope_id int, ord int, alias string, rel_kind string, table_name string, "
                              "child_scope_id int")
    closure, at = C.scope_closure(spark, s), C.relations_at(s, r)
    asked = spark.createDataFrame([(1, 4, "X"), (1, 4, "SUB"), (1, 0, "A3"), (1, 0, "A3"), (1, 2, "NONE"), (2, 0, "X")],
                                  "stmt_id int, scope_id int, alias string")
    got = {(x.scope_id, x.alias): (x.table_name, x.child_scope_id, x.level)
           for x in C.visible_asked(asked, at, closure).collect()}
    assert got == {(4, "X"): ("T4_0", None, 0), (4, "SUB"): (None, 4, 1), (0, "A3"): ("T0_3", None, 0)}
    every = C.visible_relations(s, r, closure)
    assert set(got) <= {(x.scope_id, x.alias) for x in every.collect()}
    assert C.visible_asked(asked, at, closure).exceptAll(every).isEmpty()
