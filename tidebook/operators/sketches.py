"""Approximate aggregates from stored sketches: one row for each symbol and day, merged for any span of days without reading a tick again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count as a power of two (relative error about 1.04 / 2^(LG_K / 2): 1.6 %), and the size of a quantile sketch (rank error about 1 %).
LG_K, KLL_K = 12, 300


def daily(ticks: DataFrame) -> DataFrame:
    """symbol, day, n, users (a sketch of the distinct user_ids) and prices (a sketch of the distribution) of ticks (symbol, ts, price, user_id). Null users and prices are left out of their sketch."""
    sketches = [F.count("*").alias("n"), F.hll_sketch_agg("user_id", LG_K).alias("users"), F.kll_sketch_agg_double("price", KLL_K).alias("prices")]
    return ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(*sketches)


def append_daily(sketches: DataFrame, path: str) -> None:
    """Adds days to a table in folders by day. A day may come in several parts: they are merged when they are read."""
    sketches.write.mode("append").partitionBy("day").parquet(path)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches (n, users, prices) of the rows of each group together."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("prices").alias("prices"))


def estimates(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The other columns, n, users (about) and a price for each name of a quantile."""
    rest = [c for c in sketches.columns if c not in ("n", "users", "prices")]
    shown = [F.kll_sketch_get_quantile_double("prices", F.lit(q)).alias(name) for name, q in quantiles.items()]
    return sketches.select(*rest, "n", F.hll_sketch_estimate("users").alias("users"), *shown)


def ranks(sketches: DataFrame, prices: dict[str, float]) -> DataFrame:
    """The other columns, n, and for each name the share of ticks at or below a price (about)."""
    rest = [c for c in sketches.columns if c not in ("n", "users", "prices")]
    return sketches.select(*rest, "n", *(F.kll_sketch_get_rank_double("prices", F.lit(p)).alias(name) for name, p in prices.items()))
