"""Header helpers and scan pruning."""

import pytest

from columbine.sources import io


def test_header_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "` Table Name ` int, `col` int")
    assert io.resolve_column_name(df, "table name") == " Table Name "
    assert io.resolve_column_name(df, "missing") is None
    io.require_columns(df, ["Table Name", "col"])
    with pytest.raises(ValueError, match="missing required columns: X"):
        io.require_columns(df, ["col", "X"])


def test_spec_reader_requires_columns(spark):
    df = spark.createDataFrame([("T2T", "x")], "Type string, Name string")
    with pytest.raises(ValueError, match="Target Table, Target Column"):
        io.read_mapping_spec(spark, df)
    ok = spark.createDataFrame([(" t2t ", " n1 ", '"dim"', "c", "a  +  b")],
                               "type string, NAME string, `Target Table` string, `target column` string, "
                               "Expression string")
    r = io.read_mapping_spec(spark, ok).first()
    assert (r.type, r.name, r.target_table, r.target_column, r.source_table, r.expression) == (
        "T2T", "N1", "DIM", "C", "", "A + B")


def test_mapping_scan_is_pruned(spark, sf):
    import __spark_entry__ as entry

    df = entry.queries()["graph_edges"](spark, sf)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    # graph_edges needs keys and mapping type only: the orders scan reads three
    # columns (rules come from o_orderpriority and are pruned away)
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan
    assert "o_orderpriority" not in plan and "o_totalprice" not in plan
