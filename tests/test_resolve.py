"""Resolution rules, one small catalog per rule (expected values follow the
reference's rules as documented in columbine.operators.resolve)."""

from columbine.operators import resolve as R
from columbine.sources.fixtures import spark_fixture

SCOPES = "stmt_id long, scope_id long, parent_id long, scope_name string, kind string, branch_ord int"
RELS = "stmt_id long, scope_id long, ord int, alias string, rel_kind string, table_name string, child_scope_id long"
PROJS = "stmt_id long, scope_id long, ord int, output_name string, expression string"


def resolve(spark, scopes, rels, projs, seeds, dm=()):
    s = spark.createDataFrame(scopes, SCOPES)
    r = spark.createDataFrame(rels, RELS)
    p = spark.createDataFrame(projs, PROJS)
    d = spark.createDataFrame(list(dm) or [("NONE", "NONE")], "table_name string, column_name string")
    sd = spark.createDataFrame(seeds, "stmt_id long, root_ord long, scope_id long, expression string")
    out = R.resolve_refs(spark, sd, s, r, p, d)
    return sorted((x.root_ord, x.source_type, x.table_name, x.column_name, x.constant_value, x.reason, x.dm_match)
                  for x in out.collect())


def test_union_by_name_and_position(spark):
    scopes = [(1, 0, None, "ROOT", "ROOT", None), (1, 1, 0, "ROOT/U", "UNION", None),
              (1, 2, 1, "ROOT/U/B1", "UNION_BRANCH", 0), (1, 3, 1, "ROOT/U/B2", "UNION_BRANCH", 1)]
    rels = [(1, 0, 0, "U", "SCOPE", None, 1), (1, 2, 0, "P", "PHYSICAL", "T1", None),
            (1, 3, 0, "Q", "PHYSICAL", "T2", None)]
    projs = [(1, 2, 0, "N1", "P.A"), (1, 3, 0, "M1", "Q.B")]
    got = resolve(spark, scopes, rels, projs, [(1, 0, 0, "U.N1")])
    assert [(g[1], g[2], g[3]) for g in got] == [("PHYSICAL", "T1", "A"), ("PHYSICAL", "T2", "B")]


def test_identity_on_single_physical_table(spark):
    scopes = [(1, 0, None, "ROOT", "ROOT", None), (1, 1, 0, "ROOT/S", "SUBQUERY", None)]
    rels = [(1, 0, 0, "S", "SCOPE", None, 1), (1, 1, 0, "T9", "PHYSICAL", "T9", None)]
    projs = [(1, 1, 0, "C", "C")]
    got = resolve(spark, scopes, rels, projs, [(1, 0, 0, "S.C")], dm=[("T9", "C")])
    assert got == [(0, "PHYSICAL", "T9", "C", "", "", "Y")]


def test_cycle_detected(spark):
    scopes = [(1, 0, None, "ROOT", "ROOT", None)]
    projs = [(1, 0, 0, "X", "Y + 1"), (1, 0, 1, "Y", "X * 2")]
    got = resolve(spark, scopes, [(1, 0, 0, "Z", "PHYSICAL", "TZ", None)], projs, [(1, 0, 0, "X")])
    assert [(g[1], g[5]) for g in got] == [("UNRESOLVED", "CYCLE_DETECTED")]


def test_dm_fallback_then_parent(spark):
    scopes = [(1, 0, None, "ROOT", "ROOT", None), (1, 1, 0, "ROOT/S", "SUBQUERY", None)]
    rels = [(1, 0, 0, "S", "SCOPE", None, 1), (1, 0, 1, "T1", "PHYSICAL", "T1", None),
            (1, 1, 0, "P", "PHYSICAL", "T2", None)]
    got = resolve(spark, scopes, rels, [], [(1, 0, 1, "Z"), (1, 1, 1, "Q")], dm=[("T1", "Z"), ("T2", "Q")])
    assert got == [(0, "PHYSICAL", "T1", "Z", "", "", "Y"), (1, "PHYSICAL", "T2", "Q", "", "", "Y")]


def test_constant_sequence_and_alias_not_found(spark):
    scopes = [(1, 0, None, "ROOT", "ROOT", None), (1, 1, 0, "ROOT/A", "SUBQUERY", None)]
    rels = [(1, 0, 0, "A", "SCOPE", None, 1)]
    projs = [(1, 1, 0, "K", "5")]
    seeds = [(1, 0, 0, "A.K"), (1, 1, 0, "SEQ1.NEXTVAL"), (1, 2, 0, "Q.W"), (1, 3, 0, "SYSDATE")]
    got = resolve(spark, scopes, rels, projs, seeds)
    assert [(g[0], g[1], g[4] or g[5] or g[2]) for g in got] == [
        (0, "CONSTANT", "5"), (1, "SEQUENCE", "SEQ1"), (2, "UNRESOLVED", "ALIAS_NOT_FOUND"), (3, "CONSTANT", "SYSDATE")]


def test_fixture_catalog_cases(spark, sf):
    scopes, rels, projs = (spark_fixture(spark, sf, n) for n in ("scopes", "relations", "projections"))
    dm = spark_fixture(spark, sf, "dm_pairs")
    seeds = spark_fixture(spark, sf, "resolve_seeds")
    out = R.resolve_refs(spark, seeds, scopes, rels, projs, dm)
    by = {}
    for r in out.where("root_ord = 1").collect():
        by.setdefault(r.stmt_id % 4, set()).add((r.source_type, r.reason, r.column_name))
    assert by[0] == {("CONSTANT", "", "")}
    assert by[1] == {("PHYSICAL", "", "MISSING")}       # v2 fall-back: first physical relation
    assert by[2] == {("UNRESOLVED", "ALIAS_NOT_FOUND", "Z.Q")}
    assert {x[0] for x in by[3]} == {"PHYSICAL"}
