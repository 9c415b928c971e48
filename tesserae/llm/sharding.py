"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number ``i`` in ``0 .. n-1``; a keyed permutation of that range
(a Feistel network over ``a * b >= n`` with modular addition, walked along its cycle until it
falls below ``n``) sends it to ``p``. Then ``shard = p mod shards`` and ``slot = p div shards``,
so the counts of any two shards differ by one at most, slots have no gaps, and both can be
computed from a row number alone, without the data.

Only built-in functions run. Row numbers come from one partial aggregation (equal rows meet as
one counted row before any shuffle, so a third of all rows being equal makes no hot task), a
table of bucket sizes with a fixed number of rows, and a window inside each hash bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.common import fresh, n_blocks

ROUNDS = 6
#: Walk steps tried before the exact, rarely needed, full walk.
SHORT_WALK = 16


def feistel_sides(n: int) -> tuple[int, int]:
    """``a`` and ``b`` with ``a * b >= n`` and fewer than ``a`` values too many."""
    a = max(1, math.isqrt(n))
    return a, max(1, -(-n // a))


def _once(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over ``0 .. a*b-1``."""
    left, right = F.pmod(x, F.lit(a)), F.call_function("div", x, F.lit(a))
    for k in range(ROUNDS):
        key = F.lit(seed * ROUNDS + k).cast("long")
        if k % 2:
            right = F.pmod(right + F.pmod(F.xxhash64(key, left), F.lit(b)), F.lit(b))
        else:
            left = F.pmod(left + F.pmod(F.xxhash64(key, right), F.lit(a)), F.lit(a))
    return right * F.lit(a) + left


def permuted(i: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``i`` (a long in ``0 .. n-1``) under the permutation of that range."""
    a, b = feistel_sides(n)
    spare = a * b - n

    def walk(x: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda y, _: F.when(y >= n, _once(y, a, b, seed)).otherwise(y))

    first = _once(i.cast("long"), a, b, seed)
    if not spare:
        return first
    # a cycle leaves the ``spare`` values at or above n after as many steps at most
    short = F.when(first < n, first).otherwise(walk(first, min(spare, SHORT_WALK)))
    return short if spare <= SHORT_WALK else F.get(F.transform(F.array(short), lambda x: F.when(x < n, x).otherwise(walk(x, spare))), F.lit(0))


def row_numbers(df: DataFrame, name: str, per_bucket: int = 200_000) -> tuple[DataFrame, int]:
    """Every row of ``df`` with its global row number in column ``name``, and the number of rows.

    Numbers follow (hash bucket, hash, all columns), so they depend on the rows alone and not on
    files, partitions or executors. Columns must be comparable (no maps).
    """
    rows, bucket, hashed, start = (fresh(df, x) for x in ("rows", "bucket", "hashed", "start"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    n = df.count()
    buckets = n_blocks(n, per_bucket, 16)
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(rows)).withColumn(hashed, F.xxhash64(*columns)).withColumn(bucket, F.pmod(F.col(hashed), F.lit(buckets)))
    # one row a bucket, so the window without a key and the broadcast are bounded by ``buckets``
    sizes = counted.groupBy(bucket).agg(F.sum(rows).alias(rows))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(bucket, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(bucket).orderBy(hashed, *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn(name, F.coalesce(F.sum(rows).over(inside), F.lit(0))).join(F.broadcast(offsets), bucket)
    first = F.col(name) + F.col(start)
    # numbers of very many equal rows in parts, so that no array is long
    parts = placed.select(*columns, (first + F.col(rows) - 1).alias(rows), F.explode(F.sequence(first, first + F.col(rows) - 1, F.lit(1 << 16).cast("long"))).alias(name))
    return parts.select(*columns, F.explode(F.sequence(F.col(name), F.least(F.col(name) + ((1 << 16) - 1), F.col(rows)))).alias(name)), n


def shard_rows(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (int, ``0 .. shards-1``) and ``slot`` (long, gapless from 0 in each shard).

    Nulls count as values; repeated rows get places of their own; an empty table stays empty; where
    ``df`` has columns of these names, the new ones get underscores in front. Only the columns of
    ``df`` are shuffled: select a key first, and join back, where rows are wide.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    number, shard, slot = fresh(df, "row_number"), fresh(df, "shard"), fresh(df, "slot")
    numbered, n = row_numbers(df, number)
    place = permuted(F.col(number), n, seed) if n else F.col(number)
    kept = [F.col(f"`{c}`") for c in df.columns]
    return numbered.withColumn(number, place).select(*kept, F.pmod(F.col(number), F.lit(shards)).cast("int").alias(shard), F.call_function("div", F.col(number), F.lit(shards)).alias(slot))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``. A null text has size 1 and the CRC of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(keys, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
