"""Resolution rules behind the plain look-ups, and nodes resolved once."""

from columbine.operators import catalog as C
from columbine.operators import resolve as R
from columbine.session import RoundState

from test_resolve import PROJS, RELS, SCOPES, resolve


def test_chain_is_resolved_once(spark):
    """32 paths through 6 scopes, two nodes each at most (the query ``resolve_chain`` has 12)."""
    n = 6
    scopes = [(1, k, k - 1 if k else None, f"L{k}", "SUBQUERY" if k else "ROOT", None) for k in range(n)]
    rels = [(1, k, 0, "P", "SCOPE" if k < n - 1 else "PHYSICAL", None if k < n - 1 else "T", k + 1 if k < n - 1 else None)
            for k in range(n)]
    projs = [(1, k, 0, "X", "P.X + P.X" if k < n - 1 else "P.Y") for k in range(n)]
    s, r, p = (spark.createDataFrame(*x) for x in ((scopes, SCOPES), (rels, RELS), (projs, PROJS)))
    cat = R.Catalog(spark, s, r, p, None)
    first = spark.createDataFrame([(1, 0, "R", "P.X")], "stmt_id long, scope_id long, mode string, ref string")
    edges = R.discover(first, cat, RoundState(spark))
    assert edges.select(*R.KEY).distinct().count() <= 2 * n
    seeds = spark.createDataFrame([(1, 0, 0, "P.X + P.X")], "stmt_id long, root_ord long, scope_id long, expression string")
    got = R.resolve_refs(spark, seeds, None, None, None, None, catalog=cat)
    assert got.count() == 2 ** (n - 1) and got.distinct().count() == 1
    assert got.first().trace_path == "->".join(f"L{k}" for k in range(n)) + ":T.Y"


RULE_SCOPES = [(1, 0, None, "ROOT", "ROOT", None), (1, 1, 0, "A", "SUBQUERY", None), (1, 2, 1, "B", "SUBQUERY", None),
               (1, 3, 1, "U", "UNION", None), (1, 4, 3, "U1", "UNION_BRANCH", 0), (1, 5, 3, "U2", "UNION_BRANCH", 1),
               (1, 6, 2, "C", "SUBQUERY", None)]
RULE_RELS = [(1, 0, 0, "A", "SCOPE", None, 1), (1, 1, 0, "B", "SCOPE", None, 2), (1, 1, 1, "U", "SCOPE", None, 3),
             (1, 2, 0, "C", "SCOPE", None, 6), (1, 4, 0, "P", "PHYSICAL", "T4", None), (1, 5, 0, "P", "PHYSICAL", "T5", None),
             (1, 6, 0, "P", "PHYSICAL", "T6", None)]


def test_nested_search_is_depth_first(spark):
    projs = [(1, 4, 0, "X", "P.FOUR"), (1, 5, 0, "Y", "P.FIVE"), (1, 6, 0, "X", "P.SIX"), (1, 1, 0, "OWN", "1")]
    got = resolve(spark, RULE_SCOPES, RULE_RELS, projs, [(1, 0, 0, "A.X"), (1, 1, 0, "A.Y"), (1, 2, 0, "A.Z")])
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [
        (0, "PHYSICAL", "T6", "SIX"), (1, "PHYSICAL", "T5", "FIVE"), (2, "UNRESOLVED", "", "A.Z")]


def test_identity_takes_the_first_child_with_a_result(spark):
    scopes = [(1, 0, None, "ROOT", "ROOT", None), (1, 1, 0, "S", "SUBQUERY", None)] + [
        (1, k, 1, f"K{k}", "SUBQUERY", None) for k in (2, 3, 4)]
    rels = [(1, 0, 0, "S", "SCOPE", None, 1)] + [(1, 1, k, f"K{k}", "SCOPE", None, k) for k in (2, 3, 4)] + [
        (1, 3, 0, "P", "PHYSICAL", "T3", None), (1, 4, 0, "P", "PHYSICAL", "T4", None)]
    projs = [(1, 1, 0, "C", "C"), (1, 1, 1, "D", "D"), (1, 2, 0, "C", "NOWHERE.C"), (1, 3, 0, "C", "P.C + Q.R"),
             (1, 4, 0, "C", "P.C"), (1, 2, 1, "D", "'K'")]
    got = resolve(spark, scopes, rels, projs, [(1, 0, 0, "S.C"), (1, 1, 0, "S.D")], dm=[("T3", "C")])
    assert got == [(0, "PHYSICAL", "T3", "C", "", "", "Y"), (1, "CONSTANT", "", "", "'K'", "", "N")]


def test_identity_descent_has_an_end(spark, monkeypatch):
    """Descents of more than ``DESCENT`` levels give nothing."""
    monkeypatch.setattr(R, "DESCENT", 1)
    for deep, want in ((1, "PHYSICAL"), (2, "UNRESOLVED")):
        scopes = [(1, k, k - 1 if k else None, f"L{k}", "SUBQUERY" if k else "ROOT", None) for k in range(deep + 2)]
        rels = [(1, k, 0, f"R{k + 1}", "SCOPE", None, k + 1) for k in range(deep + 1)] + [
            (1, deep + 1, 0, "P", "PHYSICAL", "T", None)]
        projs = [(1, k, 0, "C", f"R{k + 1}.C") for k in range(1, deep + 1)] + [(1, 0, 0, "C", "C"), (1, deep + 1, 0, "C", "P.C")]
        got = resolve(spark, scopes, rels, projs, [(1, 0, 0, "C")])
        assert [g[1] for g in got] == [want], deep


def test_star_placeholders(spark):
    """Through one and two stars, a scope behind a placeholder that fails, and a physical table as the last resort."""
    scopes = [(1, 0, None, "ROOT", "ROOT", None)] + [(1, k, p, f"S{k}", "SUBQUERY", None) for k, p in ((1, 0), (2, 1), (3, 0), (4, 3))]
    rels = [(1, 0, 0, "V", "SCOPE", None, 1), (1, 0, 1, "W", "SCOPE", None, 2), (1, 0, 2, "Y", "SCOPE", None, 3),
            (1, 1, 0, "W", "SCOPE", None, 2), (1, 2, 0, "E", "PHYSICAL", "EXT", None), (1, 3, 0, "Z", "SCOPE", None, 4),
            (1, 3, 1, "L", "PHYSICAL", "LAST", None)]
    s, r = spark.createDataFrame(scopes, SCOPES), spark.createDataFrame(rels, RELS)
    star = spark.createDataFrame([(1, 1, 0, "*", "*", "ALL", None), (1, 2, 0, "*", "*", "ALL", None), (1, 3, 0, "*_Z", "Z.*", None, None)],
                                 PROJS + ", star_kind string, star_alias string")
    projs = C.expand_stars(spark, s, r, star, None)
    seeds = spark.createDataFrame([(1, 0, 0, "W.C"), (1, 1, 0, "V.C"), (1, 2, 0, "Y.C")],
                                  "stmt_id long, root_ord long, scope_id long, expression string")
    got = R.resolve_refs(spark, seeds, s, r, projs, None).orderBy("root_ord").collect()
    assert [(x.source_type, x.table_name, x.column_name, x.source_alias) for x in got] == [
        ("PHYSICAL", "EXT", "C", "W"), ("PHYSICAL", "EXT", "C", "V"), ("PHYSICAL", "LAST", "C", "Y")]


def test_alias_of_the_scope_itself(spark):
    """A physical table of that alias below the scope comes before its own projection."""
    scopes = [(1, 0, None, "ROOT", "ROOT", None), (1, 1, 0, "S", "SUBQUERY", None), (1, 2, 1, "K", "SUBQUERY", None)]
    rels = [(1, 0, 0, "S", "SCOPE", None, 1), (1, 1, 0, "K", "SCOPE", None, 2), (1, 2, 0, "S", "PHYSICAL", "TS", None)]
    projs = [(1, 1, 0, "C", "K.X"), (1, 2, 0, "X", "S.Y")]
    assert [g[1:4] for g in resolve(spark, scopes, rels, projs, [(1, 0, 1, "S.C")])] == [("PHYSICAL", "TS", "C")]
    rels[2] = (1, 2, 0, "P", "PHYSICAL", "TP", None)
    projs[1] = (1, 2, 0, "X", "P.Y")
    assert [g[1:4] for g in resolve(spark, scopes, rels, projs, [(1, 0, 1, "S.C")])] == [("PHYSICAL", "TP", "Y")]


def test_union_without_the_column_goes_on(spark):
    """An unqualified column that no branch resolves is looked for like any other."""
    scopes = [(1, 0, None, "ROOT", "ROOT", None), (1, 1, 0, "U", "UNION", None), (1, 2, 1, "B1", "UNION_BRANCH", 0)]
    rels = [(1, 0, 0, "T", "PHYSICAL", "T", None), (1, 0, 1, "U", "SCOPE", None, 1), (1, 2, 0, "P", "PHYSICAL", "P", None)]
    got = resolve(spark, scopes, rels, [(1, 2, 0, "A", "P.A")], [(1, 0, 1, "OUTER_COL"), (1, 1, 1, "IN_P")],
                  dm=[("T", "OUTER_COL"), ("P", "IN_P")])
    assert [g[:4] for g in got] == [(0, "PHYSICAL", "T", "OUTER_COL"), (1, "PHYSICAL", "P", "IN_P")]


def test_stars_keep_items_not_columns(spark, monkeypatch):
    """Statements with stars over a table: the rounds keep items, equal lists are filled in once, scopes over blocks."""
    from columbine.session import RoundState

    kept, keep = [], RoundState.keep
    monkeypatch.setattr(RoundState, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    monkeypatch.setattr(C, "LIST_BLOCK", 4)
    n, wide = 30, 120
    scopes = [(i, k, 0 if k else None, f"S{k}", "SUBQUERY" if k else "ROOT", None) for i in range(n) for k in (0, 1)]
    rels = [x for i in range(n) for x in ((i, 0, 0, "S", "SCOPE", None, 1), (i, 0, 1, "D", "PHYSICAL", "SMALL", None),
                                          (i, 1, 0, "P", "PHYSICAL", "WIDE" if i else "SMALL", None))]
    projs = [x for i in range(n) for x in ((i, 1, 0, "*", "*", "ALL", None), (i, 0, 0, "*", "*", "ALL", None),
                                           (i, 0, 1, "C2", "'x'", None, None), (i, 0, 2, "S.*", "S.*", "QUALIFIED", "S"))]
    dm = spark.createDataFrame([("WIDE", f"C{k}", k) for k in range(wide)] + [("SMALL", "C1", 2), ("SMALL", "OWN", 1)],
                               "table_name string, column_name string, ordinal int")
    got = C.expand_stars(spark, spark.createDataFrame(scopes, SCOPES), spark.createDataFrame(rels, RELS), spark.createDataFrame(
        projs, PROJS + ", star_kind string, star_alias string"), dm).collect()
    own = {(r.stmt_id, r.scope_id, r.output_name): (r.ord, r.expression, r.origin_alias) for r in got}
    assert len(own) == len(got) == (n - 1) * (2 * wide + 1) + 2 + 3
    assert own[7, 1, "C5"] == (5, "P.C5", None) and own[7, 0, "C5"] == (5, "P.C5", "S")
    assert own[7, 0, "C1"] == (1, "P.C1", "S") and own[7, 0, "OWN"] == (wide, "D.OWN", None)
    assert own[7, 0, "C2"] == (2, "P.C2", "S") and own[0, 0, "OWN"] == (0, "P.OWN", "S") and own[0, 0, "C2"] == (2, "'x'", None)
    assert max(df.count() for df in kept) <= 4 * wide


def test_data_model_of_named_tables(spark):
    """Only the data model's tables that a relation names go through the rounds."""
    s = spark.createDataFrame([(1, 0, None, "ROOT", "ROOT", None)], SCOPES)
    r = spark.createDataFrame([(1, 0, 0, "P", "PHYSICAL", "t", None)], RELS)
    dm = spark.createDataFrame([("T", "a"), ("t", "A"), (None, "A")] + [(f"OTHER{k}", "A") for k in range(50)],
                               "table_name string, column_name string")
    cat = R.Catalog(spark, s, r, spark.createDataFrame([(1, 0, 0, "A", "P.A")], PROJS), dm)
    assert [tuple(x) for x in cat.dm.collect()] == [("T", "A")]
