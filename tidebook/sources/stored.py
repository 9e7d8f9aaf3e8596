"""Tables kept as Parquet in folders by a hash of their key, so that a change rewrites only the folders it touches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidebook.sources.market import materialize

BUCKET = "_bucket"


class StoredTable:
    """A table with one row for each key. Its layout (key, number of folders, columns) is stored with it.

    A change is worked out from the rows of the touched folders and written aside first; then these folders are replaced, each as a whole. So no file is read while it is
    replaced, and a change that fails on the way can be run again: it leads to the same rows. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.buckets, columns = spark.read.schema("key string, buckets int, columns string").json(f"{self.path}/_layout").first()
        self.schema = StructType.fromJson(json.loads(columns))

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> StoredTable:
        """A new table of rows with distinct keys. A folder should hold some hundred megabytes: their number is for the size that the table will have."""
        path = path.rstrip("/")
        rows.sparkSession.createDataFrame([(key, buckets, rows.schema.json())], "key string, buckets int, columns string").coalesce(1).write.json(f"{path}/_layout")
        table = cls(rows.sparkSession, path)
        table._write(rows)
        return table

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        placed = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket()).repartition(self.buckets, BUCKET)
        placed.write.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop(BUCKET)

    def find(self, key: object) -> DataFrame:
        """The row of a key, from its folder alone."""
        at = self.spark.range(1).select(F.lit(key).cast(self.schema[self.key].dataType).alias(self.key)).select(self.bucket()).first()[0]
        return self._all().where((F.col(BUCKET) == at) & (F.col(self.key) == F.lit(key))).drop(BUCKET)

    def _touched(self, changes: DataFrame) -> DataFrame:
        """The rows of the folders that the changes touch; their numbers are at most as many as there are folders."""
        at = [r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect()]
        return self._all().where(F.col(BUCKET).isin(at)).drop(BUCKET)

    def upsert(self, changes: DataFrame, order: str) -> None:
        """For each key the change of the highest order replaces the row, or is a new one. changes: the table's columns and `order`. Changes without a key are refused."""
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), order).alias("_last")).select("_last.*")
        last = materialize(last.withColumn(self.key, F.coalesce(self.key, F.raise_error(F.lit("a change without a key")))), "changes")
        self._write(materialize(self._touched(last).join(last, self.key, "left_anti").unionByName(last), "touched"))

    def merge_newest(self, rows: DataFrame, order: list[str]) -> None:
        """For each key the row of the highest `order` (columns of the table), of the table's and the given ones. Merging the same rows again, or older ones, changes nothing."""
        new = rows.select(*self.schema.names).where(F.col(self.key).isNotNull())
        newest = F.max_by(F.struct(*self.schema.names), F.struct(*order)).alias("_last")
        new = materialize(new.groupBy(self.key).agg(newest).select("_last.*"), "changes")
        self._write(materialize(self._touched(new).unionByName(new).groupBy(self.key).agg(newest).select("_last.*"), "touched"))
