"""Reports that grow as results arrive: an upsert by pair in Structured Streaming.

Results may come in any order and repeatedly.  The table lies in buckets of pairs; a micro-batch rewrites only the buckets it
touches, each as a new version (last arrival of a pair wins), and deletes their versions before the last one.  A reader takes
each bucket's newest version.  A batch that runs again writes the same version.  A report begins with a PENDING row for every
pair, so all changes and their ids are known before the first result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from redliner.operators.report import latest

BUCKETS = 64


def upsert(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    return latest(batch if current is None else current.unionByName(batch))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("pair_id"), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """The versions of each bucket, from the folders' names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    if files.exists(path):
        for batch in files.listStatus(path):
            name = batch.getPath().getName()
            if not name.startswith("v=") or not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(batch.getPath(), "_SUCCESS")):
                continue
            for part in files.listStatus(batch.getPath()):
                if part.getPath().getName().startswith("bucket="):
                    found.setdefault(int(part.getPath().getName()[7:]), []).append(int(name[2:]))
    return {k: sorted(v) for k, v in found.items()}


def _folder(table: str, version: int, bucket: int) -> str:
    return f"{table}/v={version:09d}/bucket={bucket}"


def merge(batch: DataFrame, batch_id: int, table: str, buckets: int = BUCKETS) -> None:
    """Merges one batch ``(pair_id, arrival_no, ...)`` into the table as version ``batch_id``."""
    spark = batch.sparkSession
    rows = batch.withColumn("bucket", _bucket(buckets))
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    versions = {k: [v for v in vs if v < batch_id] for k, vs in _versions(spark, table).items()}
    paths = [_folder(table, versions[k][-1], k) for k in touched if versions.get(k)]
    current = spark.read.schema(batch.schema).parquet(*paths) if paths else None
    merged = upsert(current, batch).withColumn("bucket", _bucket(buckets))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={batch_id:09d}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for k in touched:
        for old in versions.get(k, [])[:-1]:  # the last one stays for readers that have begun
            path = jvm.org.apache.hadoop.fs.Path(_folder(table, old, k))
            path.getFileSystem(conf).delete(path, True)


def start(results: DataFrame, table: str, checkpoint: str, trigger: dict | None = None, on_batch: Callable[[DataFrame], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps ``table`` up to date with the stream ``results(pair_id, arrival_no, ...)``; ``on_batch`` gets the whole table after each batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        merge(batch, batch_id + 1, table, buckets)  # version 0 is the preview's
        if on_batch is not None:
            on_batch(newest(batch.sparkSession, table))

    writer = results.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def preview(pairs: DataFrame, table: str, skipped: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Begins a table with a row for each of ``pairs(pair_id, ...)``, of status PENDING, or SKIPPED for those in ``skipped(pair_id)``."""
    rows = pairs.withColumn("arrival_no", F.lit(-1).cast("long"))
    if skipped is None:
        rows = rows.withColumn("status", F.lit("PENDING"))
    else:
        mark = skipped.select("pair_id", F.lit("SKIPPED").alias("status")).distinct()
        rows = rows.join(mark, "pair_id", "left").withColumn("status", F.coalesce("status", F.lit("PENDING")))
    merge(rows, 0, table, buckets)


def newest(spark: SparkSession, table: str) -> DataFrame:
    """The table as of the last finished batch."""
    paths = [_folder(table, versions[-1], bucket) for bucket, versions in _versions(spark, table).items()]
    return spark.read.parquet(*paths)


def progress(rows: DataFrame) -> DataFrame:
    """One row: results done and expected."""
    return rows.agg(F.count_if(~F.col("status").isin("PENDING", "SKIPPED")).alias("done"), F.count_if(F.col("status") != "SKIPPED").alias("total"))
