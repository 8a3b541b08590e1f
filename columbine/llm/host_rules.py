"""Quality rules with host-level verdicts (built-in column functions only).

Per text the base measures are taken; a document fails a rule as ``RULES``
says.  Failures are added up per host, each host's failure rate is shrunk
towards the corpus rate with a beta prior whose parameters come from the
hosts' own mean and variance (method of moments), and a host whose shrunk
rate reaches ``max_host_rate`` in any rule takes all its documents with it.
Verdicts come back by an ordinary equi-join, which Spark may broadcast or
split by size at run time; the aggregation combines map-side, so a host with
a third of all rows is one row per task before the shuffle.

Defined cases: null and empty texts have no words (all measures 0) and fail
``few_words``; a null host is a host of its own; repeated rows each count; an
empty table gives no rows; the input's other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from columbine.llm.common import materialize

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_SYMBOL_PCT = 10
MAX_DUP_LINE_PCT = 30
MAX_HOST_RATE = 0.5
# Prior strength, in documents, when hosts differ no more than chance would have it.
MAX_PRIOR_DOCS = 1e6
SYMBOLS = "[#*$%&|<>]"
SPACES = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"

#: rule name -> failure condition over the measures
RULES: dict[str, Column | str] = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PCT} * word_chars",
    "dup_lines": f"100 * n_dup_lines > {MAX_DUP_LINE_PCT} * n_lines",
}


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``keep`` columns and the base measures.

    Everything stays in one map-only stage; the largest value in it is one
    document's array of 3-word windows.
    """
    base = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.select(
        *keep, "_t",
        F.array_remove(F.split("_t", SPACES), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_l"),
    )
    base = base.select(
        *keep, "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    done = [c for c in base.columns if c != "_w"]
    # hashes of the 3-word windows: texts whose hashes all differ hold no repeated window
    last = F.size("_w") - 2
    base = base.select(*done, "_w", F.when(last >= 1, F.transform(
        F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
    )).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    # the others are sorted by hash, then by the words themselves, so equal windows are neighbours
    window = "struct<h:bigint,a:string,b:string,c:string,i:int>"
    base = base.select(*done, F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(
            h.alias("h"), F.get("_w", i).alias("a"), F.get("_w", i + 1).alias("b"),
            F.get("_w", i + 2).alias("c"), i.alias("i")))),
    ).otherwise(F.array().cast(f"array<{window}>")).alias("_s"))

    def same(x, k):
        y = F.get("_s", k)
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    # positions of the windows with an equal neighbour
    base = base.select(*done, F.sort_array(F.transform(
        F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])).alias("_p"))
    # each position covers three words, less what the next position covers again
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, x: a + x)
    return base.select(*done, covered.cast("long").alias("n_repeat_words"))


def host_verdicts(flags: DataFrame, host_col: str, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Hosts and whether they are rejected: (host, n_docs, <rule>_rate.., host_ok).

    ``flags`` has the host and one boolean per rule.  The prior of a rule has
    mean m (failures over documents) and strength m(1-m)/v - 1, where v is the
    document-weighted variance of the hosts' rates; the shrunk rate is
    (failures + m * strength) / (documents + strength).
    """
    per_host = flags.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    prior = per_host.agg(F.struct(
        *[(F.sum(r) / F.sum("n_docs")).alias(f"{r}_m") for r in RULES],
        *[(F.sum(F.col(r) * F.col(r) / F.col("n_docs")) / F.sum("n_docs")).alias(f"{r}_q") for r in RULES],
    ).alias("prior"))
    joined = per_host.withColumn("_p", prior.scalar()).select("*", "_p.*")  # one row, as a scalar subquery
    rates = []
    for r in RULES:
        m, v = F.col(f"{r}_m"), F.greatest(F.col(f"{r}_q") - F.col(f"{r}_m") * F.col(f"{r}_m"), F.lit(0.0))
        strength = F.least(F.lit(MAX_PRIOR_DOCS), F.greatest(
            F.lit(0.0), F.when(v > 0, m * (1 - m) / v - 1).otherwise(F.lit(MAX_PRIOR_DOCS))))
        rates.append(((F.col(r) + m * strength) / (F.col("n_docs") + strength)).alias(f"{r}_rate"))
    out = joined.select("host", "n_docs", *rates)
    worst = F.greatest(*[F.col(f"{r}_rate") for r in RULES])
    return out.withColumn("host_ok", worst < max_host_rate)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for every row of ``docs``."""
    m = measures(docs, text_col, (id_col, host_col))
    flags = m.select("*", *[F.expr(c).alias(r) for r, c in RULES.items()])
    flags = materialize(flags, "host-rules")  # measured once, read by both sides
    verdict = host_verdicts(flags, host_col, max_host_rate).select("host", "host_ok")
    out = flags.join(verdict, flags[host_col].eqNullSafe(verdict["host"]), "left")
    failed = F.col("few_words") | F.col("repeats")
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("host_ok")).alias("kept"))
