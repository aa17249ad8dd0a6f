"""Shared helpers: staged tables in the shared folder, Arrow batches, connected components."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole texts that travel to Python and back in one Arrow batch: JVM and worker hold a batch several times over, so 10,000 of them cost hundreds of MB a task.
TEXT_ROWS = 512
WORDS = r"[^\x20\x09-\x0D]+"
#: Steps that deal out as much as the input go through their keys in so many parts, where there are rows for it.
PARTS = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all tasks run here (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="redliner-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def begin_task() -> None:
    """Called where a task of other work begins in a Python worker: the words that packing has learnt there are given back."""
    if tokenizers := sys.modules.get("tokenizers"):
        tokenizers.__dict__.pop("_redliner_encoders", None)


def parts_of(rows: int, rows_a_part: int) -> int:
    return max(1, min(PARTS, -(-rows // rows_a_part)))


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows (None: as they are) for what runs inside; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    held = int(before)
    if rows is None or 0 < held <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Staged:
    """Tables written to the shared folder, to cut lineage and to compute a step once.

    A written table survives the loss of any executor.  ``put`` writes and rereads a table,
    ``drop`` deletes one that no later step reads.  Tables the returned result still reads stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def put(self, df: DataFrame, *, partition_by: str | None = None, batch_rows: int | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with batches_of(self.spark, batch_rows):
            writer.parquet(path)
        return self._reread(df, path)

    def put_in_parts(self, made: Callable[[int], DataFrame], parts: int, *, batch_rows: int | None = None, after: list[DataFrame] | None = None) -> DataFrame:
        """One table of ``made(0)`` to ``made(parts - 1)``, written one after the other: only one part's shuffle files are on disk at a time.

        Tables that ``made`` adds to ``after`` are deleted when its part is written.
        """
        self.n += 1
        path = f"{self.base}/{self.n:03d}"
        for part in range(parts):
            df = made(part)
            with batches_of(self.spark, batch_rows):
                df.write.option("compression", "zstd").mode("append").parquet(path)
            while after:
                self.drop(after.pop())
            self.release()
        return self._reread(df, path)

    def _reread(self, df: DataFrame, path: str) -> DataFrame:
        # The schema is passed on: reading needs no extra job and an empty table keeps its columns.
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._staged_path = path
        return out

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps whose results are written: it does when plans are collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        """Deletes all tables put here."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._staged_path)
            path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, staged: Staged) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs), as ``(node, component)`` with the smallest node of each.

    Alternates the large-star and small-star steps (Kiveris et al. 2014) until nothing changes.  Every
    step is a grouped minimum (combined map-side) and a join on the node, so a node with very many
    neighbours is pre-aggregated, and its join side may be split by AQE.  Each round is written to the
    shared folder; the rounds grow with the logarithm of the component size.
    """
    current = staged.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        # large star: every larger neighbour of a node is linked to the node's least neighbour
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after = staged.put(small)
        if after.isEmpty():
            sign = (0, None, None)
        else:
            sign = tuple(
                after.agg(
                    F.count("*"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                    F.bit_xor(F.xxhash64("v", "u")),
                ).first()
            )
        staged.drop(current)
        current = after
        if sign == before or sign[0] == 0:
            break
        before = sign
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
