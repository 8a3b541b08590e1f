"""Helpers shared by the training-data operators.

``materialize`` writes an intermediate result as Parquet below the reliable
checkpoint folder (``spark.checkpoint.dir``) and reads it back: it is computed
once, lost executors recompute nothing before it, and its plan is short.

Column names that begin with ``__columbine`` are reserved for the operators;
any other name may stand in their input.
"""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: dict = {}


from columbine.session import ensure_checkpoint_dir

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back (plan cut)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a ``materialize``d frame that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as the empty text.

    Passing binary to Python spares a decode and cannot fail on bytes that
    are no valid UTF-8.
    """
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def keep_in_worker(key, make):
    """``make()``, kept by this Python worker for its next tasks; only what
    was asked for last is kept."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Free what tasks of another operator left in this Python worker: workers
    outlive the stages of a pipeline, and the executor's limit counts them."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python end by bytes: texts differ too much in length to count rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers unless they find it anyway
    (through PYTHONPATH or the working directory)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in paths or os.path.abspath(os.getcwd()) == root or getattr(sc, "_columbine_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="columbine-package-")  # read by the driver only, which serves it
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "columbine"), "zip", root, "columbine"))
    sc._columbine_shipped = True


def read_driver_file(path: str) -> str:
    """Text of a vocabulary file that lies where the driver runs."""
    with open(path, encoding="utf-8") as f:
        return f.read()
