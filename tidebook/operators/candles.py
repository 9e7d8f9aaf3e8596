"""Candles from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.params import CANDLES, INTERVAL_MINUTES, one_of, within


def candle_measures() -> list[Column]:
    """Open and close by time, then event_id; every measure combines before the shuffle."""
    at = F.struct("ts", "event_id")
    return [F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")]


def candles(ticks: DataFrame, interval: str = "1h") -> DataFrame:
    """symbol, open_time, open, high, low, close, volume: one row for each symbol and interval that has a tick."""
    minutes = INTERVAL_MINUTES[one_of(interval, INTERVAL_MINUTES, "interval")]
    bucket = F.window("ts", f"{minutes} minutes")["start"]
    return ticks.groupBy("symbol", bucket.alias("open_time")).agg(*candle_measures())


def gapless(candles: DataFrame, interval: str = "1h") -> DataFrame:
    """candles of one interval with a row for each interval from a symbol's first candle to its last: where there was no tick, all prices are the close before, and the volume is 0.

    Each candle is repeated up to the next one. Within a day's slice of a symbol a window finds that; the last candle of a slice takes the first of the next slice, one row for
    each symbol and day. So no task needs a symbol's candles together.
    """
    step = f"INTERVAL {INTERVAL_MINUTES[one_of(interval, INTERVAL_MINUTES, 'interval')]} MINUTES"
    sliced = candles.withColumn("_day", F.date_trunc("day", "open_time").cast("timestamp_ntz"))
    firsts = sliced.groupBy(F.col("symbol").alias("_s"), F.col("_day").alias("_d")).agg(F.min("open_time").alias("_first"))
    nexts = firsts.select("_s", "_d", F.lead("_first").over(Window.partitionBy("_s").orderBy("_d")).alias("_next"))
    rows = sliced.withColumn("_until", F.lead("open_time").over(Window.partitionBy("symbol", "_day").orderBy("open_time")))
    rows = rows.join(nexts, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_day") == F.col("_d"))).withColumn("_until", F.coalesce("_until", "_next"))
    each = rows.withColumn("_at", F.explode(F.expr(f"sequence(open_time, coalesce(_until - {step}, open_time), {step})")))
    own = F.col("_at") == F.col("open_time")
    prices = [F.when(own, F.col(c)).otherwise(F.col("close")).alias(c) for c in ("open", "high", "low", "close")]
    return each.select("symbol", F.col("_at").alias("open_time"), *prices, F.when(own, F.col("volume")).otherwise(F.lit(0)).cast("long").alias("volume"))


def last_candles(candles: DataFrame, limit: int | None = None) -> DataFrame:
    """The last candles of each symbol. Candles are few for each symbol: their number is bounded by time, not by ticks."""
    limit = within(limit, CANDLES, "limit")
    by_time = Window.partitionBy("symbol").orderBy(F.col("open_time").desc())
    return candles.withColumn("_n", F.row_number().over(by_time)).where(F.col("_n") <= limit).drop("_n")


def asset_candles(ticks: DataFrame, symbol: str, interval: str = "1h", limit: int | None = None) -> DataFrame:
    """The last candles of one symbol, oldest first. The symbol's equality is applied before the aggregation."""
    limit = within(limit, CANDLES, "limit")
    mine = candles(ticks.where(F.col("symbol") == symbol.upper()), interval)
    return mine.orderBy(F.col("open_time").desc()).limit(limit).orderBy("open_time").drop("symbol")
