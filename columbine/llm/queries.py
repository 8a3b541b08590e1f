"""The registered queries of this package: each applies one operator, with
production parameters, to its whole table and returns its full result."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columbine.llm import (bpe, decontaminate, hard_negatives, host_rules, license_scan, nbsvm, oracles, periodic_runs,
                           simhash, source_mix, suffix_dedup, token_attribution, token_store, warc_fixity)
from columbine.llm.common import bound_batches, materialize, scratch_path, ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op3_host_rules": oracles.HOST_RULES,
    "op7_license_scan": oracles.LICENSE_SCAN,
    "op10_decontaminate": oracles.DECONTAMINATE,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}

def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; ``COLUMBINE_TOKENIZERS`` may name another folder."""
    folder = os.environ.get("COLUMBINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written to a token store and read back."""
    path = scratch_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_store.read_documents(spark, path, with_ids=False)


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate groups of ``documents``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with host verdicts over ``documents`` (host: source)."""
    return host_rules.apply_rules(table(spark, sf_dir, "documents"))


@query
def op4_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of ``documents``, learnt from ``labels``."""
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` without the strings of 400 bytes that repeat."""
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


# Pages per archive file of the stand-in replicas.
PAGES_PER_FILE = 2000


# Files of pages without an id: they lie below every file that an id can name.
NO_ID_FILE = -(1 << 62)


def page_replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two stand-in replicas of an archive of ``pages``, hashed: (file_id, at,
    size, digest, label).  The second has lost some records and has others
    altered.  Pages without an id lie in files of their own, by their content.

    Records are measured and hashed where they are read; only sizes and hashes
    are shuffled to lay files out.
    """
    record = warc_fixity.warc_record(F.col("url"), F.coalesce("html", F.lit("")).cast("binary"))
    spoiled = F.concat(F.expr("substr(record, 1, octet_length(record) - 1)"), F.lit("?").cast("binary"))
    altered = F.coalesce(F.col("label") % 97 == 5, F.lit(False))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("label"), record.alias("record")).select(
        "label", F.octet_length("record").cast("bigint").alias("size"), F.md5("record").alias("_md5"),
        F.sha2("record", 256).alias("digest"),
        F.when(altered, F.sha2(spoiled, 256)).otherwise(F.sha2("record", 256)).alias("_second"))
    file = F.coalesce(F.floor(F.col("label") / PAGES_PER_FILE), F.lit(NO_ID_FILE) + F.conv(F.substring("_md5", 1, 5), 16, 10).cast("bigint"))
    whole = materialize(warc_fixity.lay_out(rows.withColumn("file_id", file), "file_id", "label", "_md5"), "archive")
    cols = ["file_id", "at", "size", "digest", "label"]
    second = whole.where(~F.coalesce(F.col("label") % 211 == 7, F.lit(False))).withColumn("digest", F.col("_second"))
    return whole.select(*cols), second.select(*cols)


@query
def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged and missing records between two replicas of the ``pages`` archive."""
    first, second = page_replicas(spark, sf_dir)
    found = warc_fixity.audit(first, second)
    return found.select("file_id", F.col("label").alias("page_id"), F.col("at").alias("record_offset"), "status")


ORACLES["op6_warc_fixity"] = f"""
with w as (
  select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
           || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
           || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: '
           || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
           || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record
  from pages),
r as (select coalesce(floor(page_id / {PAGES_PER_FILE})::bigint,
               {NO_ID_FILE} + ('0x' || substr(md5(record), 1, 5))::bigint) file_id,
             page_id, md5(record) m, octet_length(encode(record)) size from w),
a as (select *, coalesce(sum(size) over (partition by file_id order by page_id nulls first, m
        rows between unbounded preceding and 1 preceding), 0)::bigint pos from r),
b as (select file_id, page_id, pos, page_id % 97 is not distinct from 5 altered from a
      where page_id % 211 is distinct from 7)
select a.file_id, a.page_id, a.pos as record_offset,
       case when b.pos is null then 'only_first' else 'differs' end as status
from a left join b on a.file_id = b.file_id and a.pos = b.pos
where b.pos is null or b.altered
"""


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in ``documents``."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


@query
def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the lines of ``documents``."""
    return token_attribution.attribute(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` encoded and decoded with byte-level BPE."""
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return bpe.digest(rows)


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One text in ten, by the checksum of its id, goes on with a period from some word on."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in ``documents``."""
    return periodic_runs.digest(periodic_runs.find_runs(table(spark, sf_dir, "documents"), prepare=planted_period))


@query
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of ``documents`` is taken when sources are mixed to target weights."""
    return source_mix.taken(source_mix.mix(table(spark, sf_dir, "documents")))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors of ``embeddings``; every seventh id has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))
