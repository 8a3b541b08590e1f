"""Runs over a folder of SQL files that is added to and repaired."""

import os
import time

from columbine.streaming import corpus_stream as CS

GOOD = "INSERT INTO T SELECT A.X FROM S A"


def write(path, text, ahead=0):
    path.write_text(text)
    os.utime(path, (time.time() + ahead,) * 2)


def test_failed_repeated_and_forced_objects(spark, tmp_path):
    src, sink, ckpt, log = (str(tmp_path / n) for n in ("sql", "out", "ckpt", "log"))
    (tmp_path / "sql" / "sub").mkdir(parents=True)
    run = lambda **kw: CS.run_corpus(spark, src, sink, ckpt, log, **kw)
    rows = lambda: sorted((r.attempt, r.object_name, r.status) for r in CS.status_log(spark, log).collect())

    write(tmp_path / "sql" / "a.sql", GOOD)
    write(tmp_path / "sql" / "b.sql", "COMMIT;")
    run()
    first = [("stream-0", "A", "success"), ("stream-0", "B", "failed")]
    assert rows() == first
    run()  # nothing new, the failed file unchanged
    assert rows() == first

    write(tmp_path / "sql" / "sub" / "a.sql", GOOD)  # an object that is done
    write(tmp_path / "sql" / "b.sql", GOOD, ahead=60)  # repaired in place: the stream does not see it
    run()
    third = sorted(first + [("stream-1", "A", "skipped"), ("retry-0", "B", "success")])
    assert rows() == third
    run()
    assert rows() == third
    assert spark.read.parquet(sink).count() == 3  # A, B failed, B repaired

    run(force=True)
    forced = [(o, s) for a, o, s in rows() if a == "retry-1"]
    assert forced == [("A", "success"), ("A", "success"), ("B", "success")]


def test_an_attempt_run_twice_counts_once(spark, tmp_path):
    sink, log = str(tmp_path / "out"), str(tmp_path / "log")
    spark.createDataFrame([], CS.LOG_SCHEMA).drop("attempt").write.parquet(f"{log}/attempt=none")
    files = spark.createDataFrame([("/x/a.sql", GOOD), ("/x/b.sql", None)], "sql_path string, sql_text string") \
        .selectExpr("*", "timestamp'2024-01-01 00:00:00' as changed")
    for _ in range(2):
        CS.process_batch(files, "stream-0", sink, log)
    got = {(r.object_name, r.status, r.run_ord) for r in CS.status_log(spark, log).collect()}
    assert CS.status_log(spark, log).count() == 2 and spark.read.parquet(sink).count() == 2
    assert got == {("A", "success", 1), ("B", "failed", 1)}


def test_empty_folder(spark, tmp_path):
    (tmp_path / "sql").mkdir()
    assert CS.run_corpus(spark, *(str(tmp_path / n) for n in ("sql", "out", "ckpt", "log"))).count() == 0
