"""CSV and JSON files by a schema: what fits it, and what doesn't, apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt"


def read_checked(spark: SparkSession, path: str, schema: StructType, kind: str = "csv", required: tuple[str, ...] = (), **options: str) -> tuple[DataFrame, DataFrame]:
    """The records of a folder of files that fit the schema; and the others as (record, reason): malformed ones with their text, and those without a required value as JSON.

    kind: csv or json. The files are read without a guess at types, in as many tasks as their size asks for.
    """
    if kind not in ("csv", "json"):
        raise ValueError(f"no such kind of file: {kind!r}")
    whole = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    reader = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).options(**options)
    rows = getattr(reader, kind)(path)
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    malformed = F.col(CORRUPT).isNotNull()
    accepted = rows.where(~malformed & complete).drop(CORRUPT)
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*schema.names)))
    rejected = rows.where(malformed | ~complete).select(record.alias("record"), F.when(malformed, "malformed").otherwise("incomplete").alias("reason"))
    return accepted, rejected
