"""SQL corpora: files, bulk texts, resume manifests and coverage.

A corpus is a DataFrame of statements ``(stmt_id, object_name, sql_text, ...)``;
every operator handles all statements of it in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columbine.functions import text as T
from columbine.operators.closure import ordered_index
from columbine.session import RoundState


def read_sql_corpus(spark: SparkSession, root: str, glob: str = "*.sql") -> DataFrame:
    """Every ``*.sql`` file under ``root`` (recursive), one row per file.

    ``object_name`` is the upper-cased file stem; ``stmt_id`` a stable hash
    of the path.  Files are read whole (``wholetext``), spread over tasks by
    Spark's file splitting.
    """
    df = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", glob).text(root)
          .select(F.col("value").alias("sql_text"), F.col("_metadata.file_path").alias("sql_path")))
    stem = F.regexp_extract("sql_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return df.select(
        F.xxhash64("sql_path").alias("stmt_id"),
        F.regexp_extract("sql_path", r"([^/]+)$", 1).alias("sql_file"),
        F.upper(stem).alias("object_name"),
        "sql_text", "sql_path",
    )


def split_bulk_sql(df: DataFrame, text_col: str = "text", key_cols: list[str] | None = None) -> DataFrame:
    """S8 + W6: one bulk text -> one row per statement.

    The stripped text is split on blank lines; empty chunks are dropped;
    ``position`` is the 1-based place among the non-empty chunks.  The
    object name is the text of the first ``/* .. */`` (stripped, upper), or
    ``UNKNOWN_<position>``.  Each text is split inside its own row (map-only).
    """
    keys = key_cols or []
    chunks = F.split(T.py_strip(F.coalesce(F.col(text_col), F.lit(""))), T.BULK_SEPARATOR, -1)
    chunks = F.filter(chunks, lambda c: T.py_strip(c) != "")
    out = df.select(*keys, F.posexplode(chunks).alias("_pos", "_chunk"))
    return _statements(out, keys)


def _statements(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Position, text and object name of numbered chunks (``_pos`` from 0, ``_chunk``)."""
    sql = T.py_strip(F.col("_chunk"))
    named = F.upper(T.py_strip(F.regexp_extract(sql, T.BULK_NAME, 1)))
    position = (F.col("_pos") + 1).cast("long")
    return chunks.select(
        *keys, position.alias("position"), sql.alias("sql_text"),
        F.when(sql.rlike(T.BULK_NAME), named).otherwise(F.concat(F.lit("UNKNOWN_"), position.cast("string")))
        .alias("object_name"),
    )


def split_bulk_lines(lines: DataFrame, key_cols: list[str], order_cols: list[str], line_col: str = "line") -> DataFrame:
    """S8 + W6 for texts too long for one task: the rows of ``split_bulk_sql``
    from their lines.

    Lines are numbered over the whole text (``ordered_index``: a text spreads
    over many tasks).  A statement is a run of lines that are not blank, so its
    line numbers less their rank among such lines are one value, which grows
    from run to run; a run that lies in two ranges of a file has the same value in
    both.  Numbering moves keys and order only; the texts are shuffled to their
    numbers and to their statements.  A null line is blank, lines with a null key
    are left out.  A task holds one statement's lines.  ``order_cols`` name a line
    of a key and must be the same whenever ``lines`` is read.
    """
    place = [*key_cols, *order_cols]
    rows = lines.select(*place, F.coalesce(line_col, F.lit("")).alias("_line"))
    rows = rows.withColumn("_full", T.py_strip(F.col("_line")) != "")
    at = ordered_index(rows.select(*place, "_full"), key_cols, order_cols, index_col="_at", size_col=None)
    full = at.where("_full").select(*place, "_at")
    run = ordered_index(full, key_cols, ["_at"], index_col="_rank", size_col=None).select(
        *place, (F.col("_at") - F.col("_rank")).alias("_run"))
    runs = ordered_index(run.select(*key_cols, "_run").distinct(), key_cols, ["_run"], index_col="_pos", size_col=None)
    numbered = run.join(runs, [*key_cols, "_run"]).select(*place, "_pos")
    parts = F.array_sort(F.collect_list(F.struct(*order_cols, "_line")))
    chunks = rows.where("_full").select(*place, "_line").join(numbered, place).groupBy(*key_cols, "_pos").agg(
        F.array_join(F.transform(parts, lambda x: x["_line"]), "\n").alias("_chunk"))
    return _statements(chunks, key_cols)


def read_bulk_files(spark: SparkSession, path: str) -> DataFrame:
    """Bulk SQL files read in ranges by many tasks: (sql_path, position,
    sql_text, object_name).  Statements that span ranges are put together.

    The lines are written once before they are numbered: how a file is cut into
    ranges may change from one reading to the next.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("sql_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    return split_bulk_lines(RoundState(spark).keep(lines), ["sql_path"], ["_block", "_row"])


def latest_manifest(manifest: DataFrame, order_col: str = "run_ord") -> DataFrame:
    """Latest status per object (append-only manifest, newest run wins)."""
    return manifest.groupBy("object_name").agg(F.max_by("status", order_col).alias("status"))


def update_manifest(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Append a batch's statuses; readers take ``latest_manifest``."""
    return manifest.unionByName(results.select("object_name", "status", "run_ord"))


def pending(stmts: DataFrame, manifest: DataFrame | None, force: bool = False) -> DataFrame:
    """Statements to process: all when forced, else those whose latest
    manifest status is not ``success`` (absent, failed or skipped)."""
    if force or manifest is None:
        return stmts
    done = latest_manifest(manifest).where(F.col("status") == "success").select("object_name")
    return stmts.join(done, "object_name", "left_anti")


def classify(stmts: DataFrame, text_col: str = "sql_text") -> DataFrame:
    """Validity and kind of every statement (B7 + B15)."""
    v = T.validate_sql(F.col(text_col))
    return stmts.withColumns({
        "valid": v["valid"],
        "message": v["message"],
        "warning_count": F.size(v["warnings"]).cast("long"),
        "kind": T.statement_kind(F.col(text_col)),
    })


def coverage(stmts: DataFrame, spec: DataFrame | None = None, text_col: str = "sql_text") -> DataFrame:
    """Per statement: kind, validity, whether it would be processed and
    why not; with a v1 spec, also how many spec rows name the object."""
    c = classify(stmts, text_col)
    reason = (F.when(~F.col("valid"), F.col("message"))
              .when(F.col("kind") == "OTHER", F.lit("not a MERGE or INSERT statement"))
              .otherwise(F.lit("")))
    c = c.withColumns({"processable": F.col("valid") & (F.col("kind") != "OTHER"), "reason": reason})
    if spec is not None:
        counts = spec.groupBy(F.col("object_name")).agg(F.count(F.lit(1)).cast("long").alias("spec_rows"))
        c = c.join(counts, "object_name", "left").withColumn("spec_rows", F.coalesce("spec_rows", F.lit(0)))
    return c


def outcomes(stmts: DataFrame, manifest: DataFrame | None = None, force: bool = False,
             text_col: str = "sql_text") -> DataFrame:
    """Status of every statement of a batch and the counts per status.

    skipped: already ``success`` in the manifest (and not forced);
    success: valid MERGE / INSERT; failed: anything else.
    """
    c = classify(stmts, text_col)
    if manifest is not None and not force:
        done = latest_manifest(manifest).where(F.col("status") == "success").select(
            "object_name", F.lit(True).alias("_done"))
        c = c.join(done, "object_name", "left")
    else:
        c = c.withColumn("_done", F.lit(None).cast("boolean"))
    status = (F.when(F.col("_done").isNotNull(), "skipped")
              .when(F.col("valid") & (F.col("kind") != "OTHER"), "success").otherwise("failed"))
    return c.withColumn("status", status).drop("_done")


def outcome_counts(statuses: DataFrame) -> DataFrame:
    """Processed / success / skipped / failed counts in one row."""
    return statuses.agg(
        F.count(F.lit(1)).cast("long").alias("processed"),
        F.count_if(F.col("status") == "success").cast("long").alias("success"),
        F.count_if(F.col("status") == "skipped").cast("long").alias("skipped"),
        F.count_if(F.col("status") == "failed").cast("long").alias("failed"),
    )
