"""Bulk files read in ranges against the split of whole texts."""

import random

from columbine.sources import corpus as CO


def test_ranges_equal_whole_text(spark, tmp_path):
    rnd = random.Random(11)
    lines = ["", " ", "\t\r", "/* obj_%d */", "SELECT é FROM T", "  X,", "-- end", "/* */ INSERT", " "]
    (tmp_path / "in").mkdir()
    texts = {}
    for k in range(3):
        text = "\n".join(rnd.choice(lines).replace("%d", str(i)) for i in range(1500 * (k == 0) + 40)) + "\n" * k
        (tmp_path / "in" / f"f{k}.sql").write_bytes(text.encode())
        texts[f"f{k}.sql"] = text
    (tmp_path / "in" / "empty.sql").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # statements span ranges
    try:
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 10
        got = {(r.sql_path.rsplit("/", 1)[1], r.position, r.sql_text, r.object_name)
               for r in CO.read_bulk_files(spark, str(tmp_path / "in")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = CO.split_bulk_sql(spark.createDataFrame(list(texts.items()), "name string, text string"), "text", ["name"])
    want = {tuple(r) for r in whole.select("name", "position", "sql_text", "object_name").collect()}
    assert got == want and len(want) > 300


def test_no_lines(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, " "), (2, 0, "")], "k int, at int, line string")
    assert CO.split_bulk_lines(df, ["k"], ["at"]).count() == 0
    assert CO.split_bulk_lines(df.limit(0), ["k"], ["at"]).count() == 0
