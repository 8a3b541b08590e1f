"""Closest names (B13): an exact similarity join on the characters of names.

The score of a target and a candidate is the number of the target's characters
that occur in the candidate, divided by the longer length; case is ignored.
Among the candidates of its block (a table, say) the target gets the one of
the highest score above ``above``, the first in order on a tie, and else the
first candidate of the block.

Method
------
The score needs the target's character counts, the candidate's set of
characters and both lengths.  So targets with equal counts are one class, as
are candidates with an equal set and length, of which the first in order
answers for all.  Names of one block share most letters, so nearly every pair of
classes has to be looked at: a block's classes are dealt into tiles of about
``TILE`` by a hash, and each pair of tiles is a task's cell, where a matrix of
counts times a matrix of sets gives the common characters of all its pairs, and
only a target's best candidate leaves it.  No pair becomes a row.

A cell holds two tiles, whatever the size of the block, and the matrices are cut
to ``CHUNK`` targets and candidates.  The pairs of a block spread over as many
tasks as it has cells; their number grows with the product of its classes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

TILE = 4096
CHUNK = 512


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, "", -1), lambda ch: ch != "")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the number of the text each stands in."""
    return (np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"),
            np.repeat(np.arange(len(texts)), [len(x) for x in texts]))


def _best(keys: list[str], sets: list[str], lengths: np.ndarray, above: float) -> tuple[np.ndarray, np.ndarray]:
    """Per key the best score above ``above`` (else ``above``) and the first candidate that has it."""
    score, who = np.full(len(keys), above), np.full(len(keys), -1)
    for i in range(0, len(keys), CHUNK):
        part = keys[i:i + CHUNK]
        own, row = _codes(part)
        long = np.array([len(x) for x in part])
        alphabet, col = np.unique(own, return_inverse=True)
        exact = np.float32 if long.max() < 1 << 24 else np.float64
        counts = np.zeros((len(part), len(alphabet)), exact)
        np.add.at(counts, (row, col), 1)
        for j in range(0, len(sets), CHUNK):
            theirs, at = _codes(sets[j:j + CHUNK])
            known = np.isin(theirs, alphabet)
            has = np.zeros((len(alphabet), len(sets[j:j + CHUNK])), exact)
            has[np.searchsorted(alphabet, theirs[known]), at[known]] = 1
            scores = (counts @ has).astype(np.float64) / np.maximum.outer(long, lengths[j:j + CHUNK])
            first = scores.argmax(1)
            top = scores[np.arange(len(part)), first]
            better = top > score[i:i + CHUNK]
            score[i:i + CHUNK][better] = top[better]
            who[i:i + CHUNK][better] = first[better] + j
    return score, who


def closest_match(targets: DataFrame, candidates: DataFrame, block_cols: list[str], target_col: str = "target",
                  name_col: str = "candidate", order_col: str = "ordinal", above: float = 0.5) -> DataFrame:
    """``targets`` with ``closest`` and ``score``.

    ``score`` is null where no candidate passes ``above`` and ``closest`` is
    the block's first one; both are null in a block without candidates (a null
    block has none).  Null names are no candidates; a null or empty target
    passes with none.  Candidates of equal order count by name.  Every target
    row comes back once, with its other columns.
    """
    t = targets.withColumn("_key", F.array_join(F.array_sort(_chars(F.upper(F.coalesce(target_col, F.lit(""))))), ""))
    c = candidates.where(F.col(name_col).isNotNull()).select(
        *block_cols, F.col(order_col).alias("_o"), F.col(name_col).alias("_name"), F.upper(name_col).alias("_u"))

    lead = c.groupBy(*block_cols).agg(F.min(F.struct("_o", "_name")).alias("_first"))
    classes = c.select(*block_cols, F.array_join(F.array_sort(F.array_distinct(_chars(F.col("_u")))), "").alias("_set"),
                       F.length("_u").alias("_len"), F.struct("_o", "_name").alias("_who")) \
        .groupBy(*block_cols, "_set", "_len").agg(F.min("_who").alias("_who"))
    keys = t.where("_key <> ''").select(*block_cols, "_key").distinct()

    tiles = lambda df, n: df.groupBy(*block_cols).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias(n))
    sizes = tiles(keys, "_tiles").join(tiles(classes, "_ctiles"), block_cols)
    dealt = classes.join(sizes, block_cols).withColumn("_ctile", F.pmod(F.xxhash64("_set", "_len"), F.col("_ctiles")).cast("int"))
    dealt = dealt.withColumn("_pos", F.row_number().over(Window.partitionBy(*block_cols, "_ctile").orderBy("_who")))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # named anew: targets and candidates may come from one table
    left = keys.join(sizes, block_cols).select(
        *[F.col(b).alias(b) for b in block_cols], F.pmod(F.xxhash64("_key"), F.col("_tiles")).cast("int").alias("_tile"), all_of("_ctiles").alias("_ctile"), "_key")
    right = dealt.select(*block_cols, all_of("_tiles").alias("_tile"), "_ctile", "_pos", "_set", "_len")
    out = StructType([*(left.schema[b] for b in block_cols), StructField("_key", StringType()), StructField("_ctile", IntegerType()),
                      StructField("_pos", IntegerType()), StructField("_score", DoubleType())])

    def cell(t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("_pos")
        if t.empty or c.empty:
            return pd.DataFrame({f.name: [] for f in out})
        score, who = _best(t["_key"].tolist(), c["_set"].tolist(), c["_len"].to_numpy(), above)
        found = who >= 0
        return t[found].assign(_pos=c["_pos"].to_numpy()[who[found]], _score=score[found])[[f.name for f in out]]

    at = [*block_cols, "_tile", "_ctile"]
    best = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(cell, out) \
        .join(dealt.select(*block_cols, "_ctile", "_pos", "_who"), [*block_cols, "_ctile", "_pos"]) \
        .groupBy(*block_cols, "_key").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_who").alias("who"))).alias("_best"))
    return t.join(best, [*block_cols, "_key"], "left").join(lead, block_cols, "left").select(
        *targets.columns, F.coalesce("_best.who._name", "_first._name").alias("closest"),
        (-F.col("_best.s")).alias("score"))
