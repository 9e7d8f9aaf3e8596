"""Latest prices, changes over a time span, extremes, market totals and alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(ticks: DataFrame) -> DataFrame:
    """symbol, ts, price, volume of each symbol's last tick; an aggregation that combines before the shuffle, not a sort."""
    last = F.max_by(F.struct("ts", "price", "volume"), F.struct("ts", "event_id")).alias("last")
    return ticks.groupBy("symbol").agg(last).select("symbol", "last.ts", "last.price", "last.volume")


def as_of(probes: DataFrame, ticks: DataFrame, probe_ts: str, out: str, slice_: str = "hour") -> DataFrame:
    """probes (symbol, probe_ts and others) with the price of the last tick at or before probe_ts, which is null if that tick has none.

    No symbol (null) is a symbol of its own. A tick without a time is known only to probes without one, which know no other.

    Probes and ticks meet in slices of a symbol and an hour (or another unit of time), so a symbol that holds most of the rows, or a busy day of it, is spread over its slices; what
    a slice needs from earlier ones is one closing row for each symbol and slice, of which the last before it is found among these rows alone.
    """
    of = lambda c: F.date_trunc(slice_, F.col(c)).cast("timestamp_ntz")
    columns = probes.columns
    priced = F.struct(F.col("price").cast("double").alias("price"))  # not null, so a tick without a price still counts as the last one
    nothing = F.lit(None).cast("struct<price:double>")
    marks = probes.select(*columns, of(probe_ts).alias("_slice"), F.col(probe_ts).alias("_at"), F.lit(1).alias("_probe"), nothing.alias("_price"), F.lit(None).cast("long").alias("_id"))
    rows = ticks.select("symbol", of("ts").alias("_slice"), F.col("ts").alias("_at"), F.lit(0).alias("_probe"), priced.alias("_price"), F.col("event_id").alias("_id"))
    within = Window.partitionBy("symbol", "_slice").orderBy("_at", "_probe", "_id").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows, allowMissingColumns=True).withColumn("_found", F.last("_price", ignorenulls=True).over(within)).where("_probe = 1")
    closes = ticks.where("ts is not null").groupBy(F.col("symbol").alias("_s"), of("ts").alias("_t")).agg(F.max_by(priced, F.struct("ts", "event_id")).alias("_close"))
    asked = probes.select(F.col("symbol").alias("_s"), of(probe_ts).alias("_t")).distinct().withColumn("_close", nothing)
    # a slice asks before it closes, as it wants what earlier slices closed with
    before = Window.partitionBy("_s").orderBy("_t", F.col("_ask").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ends = asked.withColumn("_ask", F.lit(1)).unionByName(closes.withColumn("_ask", F.lit(0)))
    carried = ends.withColumn("_close", F.last("_close", ignorenulls=True).over(before)).where("_ask = 1").drop("_ask")
    joined = both.join(carried, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_t")), "left")
    return joined.select(*columns, F.coalesce("_found", "_close")["price"].alias(out))


def change_pct(price: Column, earlier: Column, unmoved: float | None = None) -> Column:
    """100 * (price - earlier) / earlier in this order, rounded to six places; from 0 to another price it is infinite, and from 0 to 0 it is `unmoved` (null; SQL's division has NaN).

    The rounding is that of binary numbers (halves of the scaled double go away from zero, and what is below 0 and rounds to it is -0.0); F.round(x, 6) rounds the shortest decimal that prints x, which differs at halves.
    """
    moved = 100 * (price - earlier)
    pct = F.coalesce(F.try_divide(moved, earlier), moved * F.pow(earlier, F.lit(-1.0)))  # the power of a zero is infinite
    pct = F.when((earlier == 0) & (moved == 0), F.lit(unmoved).cast("double")).otherwise(pct)
    scaled = pct * 1e6
    return F.when(F.abs(scaled) < float("inf"), F.signum(scaled) * F.round(F.abs(scaled), 0) / 1e6).otherwise(pct)


def change(ticks: DataFrame, hours: int, unmoved: float | None = None) -> DataFrame:
    """event_id, symbol, ts, price, earlier (the price so many hours before, null before the first) and change_pct."""
    probes = ticks.select("event_id", "symbol", "ts", "price", (F.col("ts") - F.expr(f"interval {hours} hours")).alias("_then"))
    return as_of(probes, ticks, "_then", "earlier").drop("_then").withColumn("change_pct", change_pct(F.col("price"), F.col("earlier"), unmoved))


def extremes(ticks: DataFrame) -> DataFrame:
    """Highest and lowest price of each symbol, with the first time of each."""
    first = lambda sign: F.struct((sign * F.col("price")).alias("p"), F.col("ts"), F.col("event_id"))
    return ticks.groupBy("symbol").agg(F.max("price").alias("ath"), F.min_by("ts", first(-1)).alias("ath_date"), F.min("price").alias("atl"), F.min_by("ts", first(1)).alias("atl_date"))


def snapshots(candles: DataFrame) -> DataFrame:
    """symbol, timestamp, price, volume, running ath and atl, and the change in percent over 24 hours, 7 and 30 days: one row for each candle.

    Windows by symbol over candles, which are few for each symbol.
    """
    so_far = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    rows = candles.withColumns({"ath": F.max("high").over(so_far), "atl": F.min("low").over(so_far)})
    spans = {"24h": 24, "7d": 168, "30d": 720}
    for name, hours in spans.items():
        before = F.expr(f"last(close) OVER (PARTITION BY symbol ORDER BY open_time RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {hours} HOURS PRECEDING)")
        rows = rows.withColumn(f"price_change_pct_{name}", change_pct(F.col("close"), before, math.nan))
    return rows.select("symbol", F.col("open_time").alias("timestamp"), F.col("close").alias("price"), "volume", "ath", "atl", *(f"price_change_pct_{n}" for n in spans))


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table in folders by day, so that later reads of some days skip the others."""
    snapshots.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def overview(quotes: DataFrame, leader: str) -> DataFrame:
    """Total cap and volume and the share of one symbol, of rows (symbol, market_cap, volume). A fear and greed index has no formula and is not made up."""
    cap = F.sum("market_cap")
    share = 100 * F.try_divide(F.sum(F.when(F.col("symbol") == leader, F.col("market_cap")).otherwise(F.lit(0.0))), cap)
    return quotes.agg(F.round(cap, 2).alias("total_market_cap_usd"), F.sum("volume").alias("total_volume_24h_usd"), F.round(share, 4).alias("dominance_pct"))


def market_quotes(ticks: DataFrame) -> DataFrame:
    """symbol, market_cap and volume of each symbol: the last price times all its volume stands in for the cap."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy("symbol").agg((F.max_by("price", at) * F.sum("volume")).alias("market_cap"), F.sum("volume").alias("volume"))


def alerts(changes: DataFrame, least_pct: float, target: float) -> DataFrame:
    """Ticks that moved by least_pct or more, or are at the target price or above, with the reason."""
    moved = F.abs("change_pct") >= least_pct
    return changes.where(moved | (F.col("price") >= target)).select("event_id", "symbol", "price", "change_pct", F.when(F.col("price") >= target, "target").otherwise("change").alias("reason"))
