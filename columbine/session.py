"""Session configuration and plan-cutting helpers.

Iterative operators (graph traces, depth relaxation, name resolution) build
their result over several rounds.  Each round persists its frontier so the
next round and the termination check share one computation, and every few
rounds the state is written with ``checkpoint()`` to the reliable folder the
cluster names in ``spark.checkpoint.dir``: lost executors then recompute from
the last checkpoint instead of from round zero, and the plan stays short.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Session defaults used by tests and the bench.  On a cluster the
# deployment's own values win; nothing here overrides an existing setting.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "columbine") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it on the context.

    The folder comes from ``spark.checkpoint.dir`` in the session.  Only when
    that is unset *and* the master is local (tests, single-machine runs) is a
    fresh temporary folder made; a cluster without the setting is an error,
    because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative operators need a shared, "
                "reliable folder to cut plans (set it to a path on the cluster file system)"
            )
        configured = tempfile.mkdtemp(prefix="columbine-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


class RoundState:
    """Keeps the DataFrames of an iterative job materialized and short.

    ``keep(df)`` cuts the plan of ``df`` with a reliable ``checkpoint()`` to
    the shared checkpoint folder.  ``persist()`` alone would keep the whole
    logical plan of every earlier round, so analysis time would grow with
    each round (a round's plan refers to the previous frontier *and* the
    visited set); checkpointing every round keeps the plan a constant size
    and lets a lost executor recompute from the last round only.  The frame
    is persisted around the checkpoint so it is computed once, not twice.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        ensure_checkpoint_dir(spark)

    _AQE_CACHED = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    _AQE_SMALLEST = "spark.sql.adaptive.coalescePartitions.minPartitionSize"

    def keep(self, df: DataFrame) -> DataFrame:
        # Let AQE coalesce the round's output partitions while it is cached
        # and written; otherwise every round keeps spark.sql.shuffle.partitions
        # partitions and a union of rounds grows by that many tasks per round.
        # Rows of a round are few bytes and much work (patterns, rules): with
        # Spark's 1 MB as the least partition some rounds run on four cores.
        before = {k: self.spark.conf.get(k, None) for k in (self._AQE_CACHED, self._AQE_SMALLEST)}
        self.spark.conf.set(self._AQE_CACHED, "true")
        if before[self._AQE_SMALLEST] in (None, "1MB", "1048576b"):
            self.spark.conf.set(self._AQE_SMALLEST, "64k")
        try:
            cached = df.persist(StorageLevel.MEMORY_AND_DISK)
            out = cached.checkpoint(eager=True)
            cached.unpersist(blocking=False)
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)
        return out
