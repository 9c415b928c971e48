"""Structured Streaming jobs: incremental upserts, per-user ability, expiring keys, daily volume."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """The events table as a stream of landed files, at most ``files`` a batch."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files).parquet(folder)


def volume(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events a day and type; a day is given out once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def expiring_keys(events: DataFrame, idle: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after ``idle`` without an event; late ones beyond the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", idle).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("expires"), "n")


def ability(answers: DataFrame, rate: float = 0.3, idle_days: int = 30, late: str = "1 day") -> DataFrame:
    """Ability of each user after every batch of answers (``user_id, ts, event_id, value``), kept as state.

    Answers of a batch are sorted by time before they are applied. A user without an answer for
    ``idle_days`` of event time is given out once more and forgotten, and begins anew after that.
    """
    from math import exp

    idle = idle_days * 86_400_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        theta, n, last = state.get if state.exists else (0.0, 0, 0)
        if state.hasTimedOut:
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            if state.exists and int(rows["ts"].min().timestamp() * 1000) > last + idle:  # back before the watermark told
                theta, n = 0.0, 0
            for value in rows["value"]:
                theta += rate * (float(value > 10) - 1 / (1 + exp(-theta)))
                n += 1
            last = max(last, int(rows["ts"].max().timestamp() * 1000))
            state.update((theta, n, last))
            state.setTimeoutTimestamp(max(last + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "theta": [round(theta, 6)], "n": [n]})

    keyed = answers.select("user_id", "ts", "event_id", "value").withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, theta double, n long", "theta double, n long, last long", "update", GroupStateTimeout.EventTimeTimeout)


BUCKETS = 64
_MANIFEST = "version long, bucket int"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``version, bucket``: which buckets each committed batch has written; without rows where there is no table yet."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except Exception as e:  # nothing is committed yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _MANIFEST)


def read_table(spark: SparkSession, path: str, schema, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a table written by ``ingest``, each bucket in its last version (below ``before``); all buckets, or some of them.

    The plan reads one folder a version that is still in use, at most one a bucket.
    """
    known = manifest(spark, path).filter(F.lit(True) if before is None else F.col("version") < before)
    if buckets is not None:
        known = known.filter(F.col("bucket").isin(*buckets))
    last = known.groupBy("bucket").agg(F.max("version").alias("version")).groupBy("version").agg(F.collect_list("bucket").alias("buckets"))
    rows = spark.createDataFrame([], schema)
    for part in last.collect():  # at most one row a bucket
        rows = rows.unionByName(spark.read.schema(StructType([*rows.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{path}/v{part.version}").filter(F.col("bucket").isin(*part.buckets)).drop("bucket"))
    return rows


def upsert_batch(batch: DataFrame, number: int, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write the buckets that the batch touches as version ``number``, then commit them in one file of the manifest.

    Rows are dealt to ``buckets`` by a hash of the key, so a batch reads and writes its own buckets
    only. A batch that is committed already, or has no rows, changes nothing; one that was cut off
    before its commit is written again. The number of buckets is fixed with the table.
    """
    from tesserae.operators.upsert import upsert

    spark = batch.sparkSession
    if not manifest(spark, path).filter(F.col("version") == number).isEmpty():
        return
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # at most one row a bucket
    if not touched:
        return
    old = read_table(spark, path, batch.schema, number, touched)
    new = upsert(old, batch, [key], {}, [F.desc("ts")]).withColumn("bucket", bucket)
    new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{number}")
    spark.createDataFrame([(number, b) for b in touched], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def ingest(items: DataFrame, path: str, key: str, late: str = "1 day", buckets: int = BUCKETS):
    """A writer that upserts each batch of new items into a bucketed Parquet table, one row a key; replaying a batch changes nothing.

    Versions are numbered as batches are, whatever numbers are missing; readers take ``read_table``.
    """
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]).writeStream.outputMode("append").foreachBatch(lambda batch, number: upsert_batch(batch, number, path, key, buckets))


def run_once(stream: DataFrame, spark: SparkSession, checkpoint: str, name: str, mode: str) -> DataFrame:
    """All that is available now, through the stream, into a table of its own."""
    out = f"{checkpoint}/{name}-out"
    if mode == "append":
        q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start(out)
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
