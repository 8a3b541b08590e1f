"""Driver contract: entry runs, every oracle has a query, names are unique."""

import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns


def test_oracles_cover_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_streaming_front_end(spark, tmp_path):
    from columbine.streaming.corpus_stream import stream_sql_corpus

    src = tmp_path / "sql"
    src.mkdir()
    (src / "obj_a.sql").write_text("INSERT INTO T SELECT A.X FROM S A")
    (src / "obj_b.sql").write_text("COMMIT;")
    q = stream_sql_corpus(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    rows = {r.object_name: r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"OBJ_A": "INSERT", "OBJ_B": "OTHER"}


def test_write_outputs_round_trip(spark, sf, tmp_path):
    from columbine.operators.report import write_outputs
    from columbine.plans.delta_queries import mappings

    m = mappings(spark, sf, "map_v1")
    write_outputs({"edges": m}, str(tmp_path), per_object=True)
    back = spark.read.parquet(str(tmp_path / "edges"))
    assert back.count() == m.count()
    assert set(back.columns) == set(m.columns)
    from columbine.operators.report import JOIN_COLUMNS
    from columbine.plans import QUERIES

    joins = QUERIES["join_table"].build(spark, sf)
    write_outputs({"joins": joins}, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "joins"))
    assert back.columns == JOIN_COLUMNS and back.count() == joins.count() > 0


def test_read_sql_corpus(spark, tmp_path):
    from columbine.sources.corpus import read_sql_corpus

    (tmp_path / "sub").mkdir()
    (tmp_path / "a_obj.sql").write_text("SELECT 1 FROM DUAL")
    (tmp_path / "sub" / "b_obj.sql").write_text("INSERT INTO T SELECT 1 FROM DUAL")
    (tmp_path / "notes.txt").write_text("x")
    got = sorted(r.object_name for r in read_sql_corpus(spark, str(tmp_path)).collect())
    assert got == ["A_OBJ", "B_OBJ"]


def test_pending_force_and_manifest(spark, sf):
    from columbine.sources import corpus as CO
    from columbine.sources.fixtures import spark_fixture

    stmts, man = spark_fixture(spark, sf, "stmts"), spark_fixture(spark, sf, "manifest")
    assert CO.pending(stmts, man, force=True).count() == stmts.count()
    done = CO.latest_manifest(man).where("status = 'success'").count()
    assert CO.pending(stmts, man).count() == stmts.count() - done
