"""Tables that change together: hash buckets of several tables, made visible by one file of a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Tasks, and thus files, of one bucket in one version, at most.
SHARES = 16
_MANIFEST = "version long, batch string, name string, bucket int"


class Store:
    """Tables under ``path``; ``tables`` maps a name to its schema (a DDL string without nested commas in names) and key columns.

    Rows are dealt to ``buckets`` by a hash of their key, so a batch reads and writes only the
    buckets that it touches, whatever the size of the tables. A batch stages its changes of all
    tables, and is committed by one file of the manifest: readers see all of it or nothing. A batch
    that is committed already changes nothing; one that was cut off before is written again. One
    writer at a time; the number of buckets is fixed with the store.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, list[str]]], buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schemas = {name: StructType.fromDDL(ddl) for name, (ddl, _) in tables.items()}
        self.keys = {name: keys for name, (_, keys) in tables.items()}

    def manifest(self) -> DataFrame:
        """``version, batch, name, bucket`` of all commits; each has one more row without a name."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except Exception as e:  # nothing is committed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def holds(self, batch: str) -> bool:
        """Whether the batch is committed."""
        return not self.manifest().filter(F.col("batch") == batch).isEmpty()

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The committed rows of a table, each bucket in its last version; all buckets, or some of them."""
        known = self.manifest().filter(F.col("name") == name)
        if buckets is not None:
            known = known.filter(F.col("bucket").isin(*buckets))
        last = known.groupBy("bucket").agg(F.max("version").alias("version")).groupBy("version").agg(F.collect_list("bucket").alias("buckets"))
        schema = self.schemas[name]
        rows = self.spark.createDataFrame([], schema)
        for part in last.collect():  # at most one row a bucket
            files = self.spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/v{part.version}/{name}")
            rows = rows.unionByName(files.filter(F.col("bucket").isin(*part.buckets)).drop("bucket"))
        return rows

    def aside(self, df: DataFrame) -> DataFrame:
        """``df`` written beside the tables, where no reader of theirs looks, and read back."""
        path = f"{self.path}/aside/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stage(self, version: int, changes: dict[str, DataFrame]) -> list[tuple[str, int]]:
        """Write the touched buckets of each table as they will be, seen by nobody yet; ``changes`` hold whole rows that replace those of their key."""
        touched = []
        for name, rows in changes.items():
            staged = f"{self.path}/v{version}/changes-{name}"
            rows.select(*self.schemas[name].names).withColumn("bucket", self.bucket(name)).write.mode("overwrite").parquet(staged)
        for name in changes:
            fresh = self.spark.read.schema(StructType([*self.schemas[name].fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/v{version}/changes-{name}")
            mine = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # at most one row a bucket
            if mine:
                old = self.read(name, mine).join(fresh.select(*self.keys[name]), self.keys[name], "left_anti").withColumn("bucket", self.bucket(name))
                # a bucket is shared by several tasks where it is large; Spark joins small ones
                share = F.pmod(F.xxhash64(*self.keys[name], F.lit(1)), F.lit(SHARES))
                old.unionByName(fresh).repartition("bucket", share).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}/{name}")
                touched += [(name, b) for b in mine]
        return touched

    def commit(self, batch: str, changes: dict[str, DataFrame]) -> bool:
        """Stage the changes of one batch and make them visible together; false if it was committed before."""
        if self.holds(batch):
            return False
        version = 1 + (self.manifest().agg(F.max("version")).first()[0] or 0)
        touched = self.stage(version, changes)
        self.spark.createDataFrame([(version, batch, None, None), *((version, batch, *x) for x in touched)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return True
