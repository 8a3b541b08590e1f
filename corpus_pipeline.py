"""Corpus pipeline over ``documents``: five operators of ``columbine.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; ``run`` writes every stage's result as Parquet below
the shared checkpoint folder and rereads it as the next stage's input, so a
lost executor costs at most a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columbine.llm import bpe, decontaminate, nbsvm, simhash, suffix_dedup
from columbine.llm.common import bound_batches, materialize, ship_package, table
from columbine.llm.queries import vocabulary


def ready(spark: SparkSession) -> None:
    """What every stage needs of the session."""
    ship_package(spark)
    bound_batches(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score at or above its
    threshold); the classifier learns from ``labels``."""
    ready(spark)
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    scored = nbsvm.score(docs, model, score_col="__columbine_score")
    return scored.where(F.col("__columbine_score") >= nbsvm.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: of the smallest id, and of its
    texts the one with the smallest hash.

    Rows that repeat this id and text are one document, of which one row
    stays.  Rows without an id stay, as groups name their members by id.
    """
    ready(spark)
    key = {"__columbine_id": F.col("doc_id"), "__columbine_hash": F.xxhash64(F.coalesce("text", F.lit("")))}
    row = F.when(F.col("doc_id").isNotNull(), F.struct(*[c.alias(k) for k, c in key.items()]))
    groups = simhash.near_duplicates(docs.select(row.alias("row"), "text"), id_col="row")
    keep = materialize(groups.where("row = component_id").select("row.*").groupBy(*key).count(), "kept-rows")
    rows = docs.withColumns(key)
    once = rows.join(keep.where("count = 1").select(*key), [*key], "left_semi")
    again = rows.join(keep.where("count > 1").select(*key), [*key], "left_semi").dropDuplicates([*key])
    kept = once.select(*docs.columns).union(again.select(*docs.columns))
    return kept.union(docs.where("doc_id is null"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of ``suffix_dedup.PASSAGE`` bytes that
    occur more than once: passages of 50 words are often under 400 bytes.
    ``n_chars`` follows the text."""
    ready(spark)
    return suffix_dedup.deduplicate(docs, length=suffix_dedup.PASSAGE).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    ready(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: (doc_id, n_tokens, ids, decoded_sha256)."""
    ready(spark)
    rows = bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"))
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", tokens),
]

# No SQL for a fitted classifier, SimHash components and BPE; tests/llm checks
# run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
