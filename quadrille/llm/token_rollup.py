"""Token counts kept as rollups that signed changes update.

A rollup is a folder of committed batches. A batch holds changes of single documents:
``insert`` and ``delete`` add or take away a document with its tokens, ``revise`` replaces
``old_tokens`` by ``n_tokens``. ``commit`` sums a batch to one signed row per source,
language and tokenizer version before it writes, so state grows with the keys, not with
the documents. Totals are additive, so the order of batches does not matter.

A batch counts once its folder holds Spark's success mark: a batch that broke off is
written over, and a batch number that is committed already is left alone, so a retried
commit changes nothing. ``compact`` folds all batches up to a number into a snapshot,
written beside them and taken over in the same way.

Defined results: null keys form groups of their own; null counts are 0; unknown kinds of
change raise an error; keys whose documents and tokens are all taken away vanish from the
totals; an empty batch commits and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
STATE = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """One row per key: what the changes add to its documents and tokens."""
    kind = F.col("change")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    old = number("old_tokens") if "old_tokens" in changes.columns else F.lit(0)
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0)
    tokens = F.when(kind == "insert", number("n_tokens")).when(kind == "delete", -number("n_tokens")).when(kind == "revise", number("n_tokens") - old)
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(kind, F.lit("null")))).cast("long")
    rows = changes.select(*KEYS, F.coalesce(docs.cast("long"), wrong).alias("n_docs"), tokens.cast("long").alias("n_tokens"))
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenRollup:
    """The rollup in folder ``root`` of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _committed(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that hold a success mark."""
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in numbers if self._fs.exists(self._path(f"{kind}={n}/_SUCCESS")))

    def _folded(self) -> int:
        return max(self._committed("snapshot"), default=-1)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Add a batch (numbers from 0). False: it was there already, and nothing was done."""
        if batch <= self._folded() or self._fs.exists(self._path(f"batch={batch}/_SUCCESS")):
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches."""
        folded = self._folded()
        paths = [f"{self.root}/batch={n}" for n in self._committed("batch") if n > folded]
        paths += [f"{self.root}/snapshot={folded}"] if folded >= 0 else []
        state = self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)
        summed = state.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Fold the batches into a snapshot; only an unbroken run of numbers, so that none can come late."""
        folded, done = self._folded(), set(self._committed("batch"))
        upto = folded
        while upto + 1 in done:
            upto += 1
        if upto == folded:
            return
        parts = [f"{self.root}/batch={n}" for n in range(folded + 1, upto + 1)]
        parts += [f"{self.root}/snapshot={folded}"] if folded >= 0 else []
        state = self.spark.read.schema(STATE).parquet(*parts)
        summed = state.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(f"{self.root}/snapshot={upto}")
        for n in range(folded + 1, upto + 1):
            self._fs.delete(self._path(f"batch={n}"), True)
        if folded >= 0:
            self._fs.delete(self._path(f"snapshot={folded}"), True)
