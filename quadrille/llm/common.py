"""Helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR_KEY = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset in local mode (tests),
    a temporary folder of this process takes its place; elsewhere that is an error.
    """
    named = spark.conf.get(SHARED_DIR_KEY, None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quadrille-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; return what reads it back, and its path.

    This cuts the lineage like a reliable checkpoint: a lost executor costs nothing
    that was written. Unlike ``checkpoint()`` it computes ``df`` once only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``materialise`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are through: it does once the driver's collector has found them unused."""
    spark.sparkContext._jvm.System.gc()


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df``, of any name, as one struct ``_row``: no helper column can clash with them."""
    return df.select(F.struct(*(F.col(quoted(c)).alias(c) for c in df.columns)).alias("_row"))


def unpacked(df: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``df`` again from ``_row``, those of ``changed`` replaced."""
    row = F.col("_row")
    return [changed.get(c.lower(), row.getField(c)).alias(c) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def content_id(text: Column) -> Column:
    """16 bytes that stand for a text; equal texts and no others share them."""
    return F.unhex(F.md5(text))


def broadcast_if_small(df: DataFrame, rows: int, bytes_per_row: int, limit: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only where the counted rows keep below ``limit`` bytes."""
    return F.broadcast(df) if rows * bytes_per_row <= limit else df
