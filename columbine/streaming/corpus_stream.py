"""Incremental front end for SQL corpora (S7 + B7/B15 on new files only).

New ``*.sql`` files dropped into a folder are picked up by a Structured
Streaming file source; each micro-batch is cleaned, validated and
classified with the same column rules as the batch path and appended to a
parquet sink.  ``trigger(availableNow=True)`` processes everything new and
stops, which makes it a resumable batch job: the stream checkpoint (in the
shared checkpoint folder) is the manifest of files already done, replacing
the reference's per-object JSON manifest for directory runs.

``run_corpus`` adds the outcome of every object: a status log beside the stream
decides what is skipped, and failed files that were changed since are taken
again, which the stream's own checkpoint (files, not outcomes) cannot do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from columbine.functions.text import normalize_sql, statement_kind, validate_sql
from columbine.sources.corpus import outcomes

LOG_SCHEMA = "object_name string, sql_path string, status string, run_ord bigint, changed timestamp, attempt string"


def classify_stream(df: DataFrame) -> DataFrame:
    """Column rules applied to a streaming (or static) ``(value, path)`` frame."""
    stem = F.regexp_extract("sql_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    v = validate_sql(F.col("sql_text"))
    return df.select(
        F.xxhash64("sql_path").alias("stmt_id"), F.upper(stem).alias("object_name"), "sql_path", "sql_text",
        v["valid"].alias("valid"), v["message"].alias("message"), F.size(v["warnings"]).alias("warning_count"),
        statement_kind("sql_text").alias("kind"), normalize_sql("sql_text").alias("normalized_sql"))


def stream_sql_corpus(spark: SparkSession, root: str, sink: str, checkpoint: str,
                      glob: str = "*.sql", available_now: bool = True) -> StreamingQuery:
    """Start the stream: every new SQL file under ``root`` -> one classified row in ``sink``.

    ``checkpoint`` must be on shared, reliable storage (the stream's own
    progress log); files already committed there are never read again.
    """
    src = (spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", "true").load(root)
           .select(F.col("value").alias("sql_text"), F.col("_metadata.file_path").alias("sql_path")))
    w = (classify_stream(src).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def status_log(spark: SparkSession, log: str) -> DataFrame:
    """Every recorded outcome: (object_name, sql_path, status, run_ord, changed, attempt)."""
    return spark.read.schema(LOG_SCHEMA).option("basePath", log).parquet(log)


def _with_object(files: DataFrame) -> DataFrame:
    stem = F.regexp_extract("sql_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(F.upper(stem).alias("object_name"), "sql_path", "sql_text", "changed")


def process_batch(files: DataFrame, attempt: str, sink: str, log: str, force: bool = False) -> None:
    """Classify ``files`` (sql_path, sql_text, changed) and record their outcomes.

    Objects whose latest outcome (skips aside) is ``success`` are skipped unless
    forced.  Results go to ``sink/attempt=..``, outcomes to ``log/attempt=..``, each
    written over whole: an attempt that is run again after a crash leaves
    the rows of one run.  Outcomes come last, so a crash between the two repeats the
    attempt.  Files of one object within an attempt are each taken.
    """
    spark = files.sparkSession
    earlier = status_log(spark, log).where(F.col("attempt") != attempt)
    run = (earlier.agg(F.max("run_ord")).first()[0] or 0) + 1
    manifest = earlier.where("status <> 'skipped'").select("object_name", "status", "run_ord")
    done = outcomes(_with_object(files), manifest, force)
    classify_stream(done.where("status <> 'skipped'")).write.mode("overwrite").parquet(f"{sink}/attempt={attempt}")
    done.select("object_name", "sql_path", "status", F.lit(run).cast("bigint").alias("run_ord"), "changed") \
        .write.mode("overwrite").parquet(f"{log}/attempt={attempt}")


def to_retry(spark: SparkSession, root: str, log: str, glob: str = "*.sql", force: bool = False) -> DataFrame:
    """Files to take again: those that failed in their latest outcome and were
    changed after it was recorded (an unchanged text fails again); all files
    when forced.

    Files older than every open failure are left out by the time filter, which
    the scan applies to the listing before any content is read.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
             .load(root).select(F.col("path").alias("sql_path"), "modificationTime", "content"))
    if not force:
        last = status_log(spark, log).groupBy("sql_path").agg(
            F.max_by("status", "run_ord").alias("status"), F.max("changed").alias("changed"))
        failed = last.where("status = 'failed'").select(F.col("sql_path").alias("_path"), F.col("changed").alias("_seen"))
        oldest = failed.agg(F.min("_seen")).first()[0]
        if oldest is None:
            files = files.limit(0)
        else:
            files = files.where(F.col("modificationTime") > F.lit(oldest)).join(
                failed, (F.col("sql_path") == F.col("_path")) & (F.col("modificationTime") > F.col("_seen")), "left_semi")
    return files.select("sql_path", F.decode("content", "UTF-8").alias("sql_text"), F.col("modificationTime").alias("changed"))


def run_corpus(spark: SparkSession, root: str, sink: str, checkpoint: str, log: str, glob: str = "*.sql",
               force: bool = False) -> DataFrame:
    """One resumable run (S10): new files through the stream, then the retries.

    All folders must be on shared storage.  Returns the status log.
    """
    # the log exists from the start, also without a file
    spark.createDataFrame([], LOG_SCHEMA).drop("attempt").write.mode("overwrite").parquet(f"{log}/attempt=none")
    if not force:
        src = (spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob)
               .option("recursiveFileLookup", "true").load(root)
               .select(F.col("_metadata.file_path").alias("sql_path"), F.col("value").alias("sql_text"),
                       F.col("_metadata.file_modification_time").alias("changed")))
        src.writeStream.foreachBatch(lambda df, k: process_batch(df, f"stream-{k}", sink, log)) \
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    again = to_retry(spark, root, log, glob, force)
    if not again.isEmpty():
        n = status_log(spark, log).where("attempt like 'retry-%'").select("attempt").distinct().count()
        process_batch(again, f"retry-{n}", sink, log, force)
    return status_log(spark, log)
