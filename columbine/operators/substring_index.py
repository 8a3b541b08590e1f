"""Substring index: which of many texts hold a term, without reading them all.

Every distinct text is listed under its runs of one, two and three characters
(lower case).  Terms are grouped by their head, the first three characters
(shorter terms: the term): a head's list is read once for all its terms, and
the pieces of a text that begin where the head stands, as long as any term of
that head is, are matched to the terms by an equi-join.  So rows grow with the
places of heads times the lengths of their terms, never with terms times texts.
A piece array is bounded by one text and the lengths of a head's terms.

``save`` writes the lists in order of their run, so a scan that is given runs
skips the row groups of others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from columbine.session import RoundState

GRAM = 3

# Heads up to this number go to every task instead of a shuffle of the lists.
HEADS = 100_000


def _runs(c: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters of ``c``."""
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))))


@dataclass
class SubstringIndex:
    """``postings``: run, text."""

    postings: DataFrame

    def lookup(self, terms: DataFrame) -> DataFrame:
        """(term, text) for every distinct text that holds the term.

        Terms are compared trimmed and in lower case; null and blank ones find
        nothing; repeated ones count once.
        """
        t = terms.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
        heads = t.select(F.substring("term", 1, GRAM).alias("run"), F.length("term").alias("m")) \
            .groupBy("run").agg(F.array_sort(F.collect_set("m")).alias("lengths"))
        heads = RoundState(t.sparkSession).keep(heads)
        if heads.count() <= HEADS:
            heads = F.broadcast(heads)
        text, run = F.col("text"), F.col("run")
        places = F.filter(F.sequence(F.lit(1), F.length(text) - F.length(run) + 1),
                          lambda i: F.substring(text, i, F.length(run)) == run)
        pieces = F.flatten(F.transform(places, lambda i: F.transform(
            F.filter("lengths", lambda m: i + m - 1 <= F.length(text)), lambda m: F.substring(text, i, m))))
        return self.postings.join(heads, "run").select("text", F.explode(F.array_distinct(pieces)).alias("term")) \
            .join(t, "term").select("term", "text")

    def save(self, folder: str) -> None:
        self.postings.repartitionByRange("run", "text").sortWithinPartitions("run", "text") \
            .write.mode("overwrite").parquet(f"{folder}/postings")


def build(texts: DataFrame, text_col: str) -> SubstringIndex:
    """Index of the distinct values of ``text_col`` in lower case; nulls and
    empty texts hold no term and are left out."""
    t = texts.select(F.lower(text_col).alias("text")).where("text <> ''").distinct()
    runs = F.concat(*[_runs(F.col("text"), n) for n in range(1, GRAM + 1)])
    return SubstringIndex(t.select(F.explode(runs).alias("run"), "text"))


def load(spark: SparkSession, folder: str) -> SubstringIndex:
    return SubstringIndex(spark.read.parquet(f"{folder}/postings"))
