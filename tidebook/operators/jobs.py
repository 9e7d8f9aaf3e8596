"""The log of analysis jobs: records are appended, with ids that go on from the log, and states are read from what was appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators.mutations import numbered
from tidebook.sources.market import materialize

RECORD = "job_id long, asset_symbol string, analysis_type string, action string, result string, step int"


def create_log(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], RECORD).write.parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path)


def append_runs(runs: DataFrame, path: str) -> DataFrame:
    """Appends the jobs of some analyses (asset_symbol, analysis_type, status, result) to the log, a start and an end each, and gives back the runs with their id.

    Ids go on from the greatest in the log, in the order of symbol and type. One writer at a time.
    """
    spark = runs.sparkSession
    most = read_log(spark, path).agg(F.coalesce(F.max("job_id"), F.lit(0).cast("long"))).first()[0]
    rows = runs.select("asset_symbol", "analysis_type", "status", "result")
    told = numbered(rows, ["asset_symbol", "analysis_type"], "_number").select((F.col("_number") + most).alias("id"), *rows.columns)
    told = materialize(told, "runs")
    ended = F.when(F.col("status") == "completed", "complete").otherwise("fail")
    steps = F.array(F.struct(F.lit("start").alias("action"), F.lit(None).cast("string").alias("result"), F.lit(1).alias("step")), F.struct(ended.alias("action"), F.col("result"), F.lit(2).alias("step")))
    told.select(F.col("id").alias("job_id"), "asset_symbol", "analysis_type", F.inline(steps)).write.mode("append").parquet(path)
    return told
