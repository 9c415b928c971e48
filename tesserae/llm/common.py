"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a folder of our own, if all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet (with the writer's ``options``) into the shared folder and read it back.

    A later loss of executors costs nothing that was computed before this point.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand free memory of a Python worker back to the system: Arrow's pool, then what the C library keeps of freed arrays.

    A worker goes on to other tasks and stages, and would hold what its largest task once took.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A task over batches that gives memory back at its end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, inside one projection."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use, in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


#: Cut values that may reach the driver and stand in a plan; beyond it ranges grow, and their tasks sort with spilling.
MOST_CUTS = 4096


def key_cuts(df: DataFrame, column: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending cut values that split a long column into ranges of about equal counts.

    Only the cuts (at most ``MOST_CUTS``) reach the driver. No cuts for an empty or all-null column.
    """
    n = min(n, MOST_CUTS)
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(F.col(column), [i / n for i in range(1, n)], 20 * n).alias("q")).first()
    return sorted(set(got["q"] or []))


def range_bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``: a binary search in built-in functions; null counts as below all."""
    if not cuts:
        return F.lit(0)
    steps = (len(cuts)).bit_length()
    padded = F.array(*(F.lit(int(c)).cast("long") for c in cuts))
    size = len(cuts)
    return F.aggregate(
        F.array(*(F.lit(1 << s) for s in reversed(range(steps)))),
        F.lit(0),
        lambda low, step: F.when((low + step <= size) & (F.get(padded, low + step - 1) <= value), low + step).otherwise(low),
    )


def n_blocks(total: int | None, each: int, least: int = 1) -> int:
    """How many blocks of ``each`` hold ``total``."""
    return max(least, -(-int(total or 0) // each))


def running_starts(df: DataFrame, number: str, value: str, name: str, each: int = 4096) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows with a smaller ``number`` (whole, from 0, distinct).

    Sums of groups of ``each`` numbers come first, so the window without a key sees one row a group.
    """
    group, before = fresh(df, "_group"), fresh(df, "_before")
    grouped = df.withColumn(group, F.floor(F.col(number) / each))
    sums = grouped.groupBy(group).agg(F.sum(value).alias(before))
    past = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, F.coalesce(F.sum(before).over(past), F.lit(0)).alias(before))
    inside = Window.partitionBy(group).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    joined = grouped.join(sums, group).withColumn(name, F.col(before) + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return joined.drop(group, before)
