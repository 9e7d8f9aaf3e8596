"""Canonical market views over Parquet tables, and the generated and literal relations."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.functions.params import CANDLES, DAYS, INTERVAL_MINUTES, within


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), or with a local master in a local one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidebook-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, whatever reads it, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, symbol, ts, price, volume: one row for each event; event_id breaks ties of ts."""
    volume = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.upper("event_type").alias("symbol"), "ts", F.col("value").alias("price"), volume.alias("volume"))


def assets(spark: SparkSession, sf_dir: str, symbol: str | None = None) -> DataFrame:
    """A wide catalogue: a part is an asset. Volume, market cap (price times volume) and change (of the last price paid against the mean one) are stand-ins;
    of 50 assets one has no change and one an unknown one.

    symbol: only that asset's rows are read, as its stored key reaches the scans.
    """
    parts, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    if symbol is not None:
        key = int(symbol[1:]) if re.fullmatch("[pP][0-9]{1,18}", symbol) else -1
        parts, lines = parts.where(F.col("p_partkey") == key), lines.where(F.col("l_partkey") == key)
    last = F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    traded = lines.groupBy("l_partkey").agg(F.sum("l_quantity").alias("volume_24h"), F.sum("l_extendedprice").alias("paid"), last.alias("last_paid")).withColumnsRenamed({"l_partkey": "id"})
    change = F.when(F.col("id") % 50 == 0, 0.0).when(F.col("id") % 50 != 1, F.round(100 * F.try_divide(F.col("last_paid") - F.try_divide(F.col("paid"), F.col("volume_24h")), F.try_divide(F.col("paid"), F.col("volume_24h"))), 4))
    price = F.col("p_retailprice")
    return (
        parts.withColumnRenamed("p_partkey", "id")
        .join(traded, "id", "left")
        .select(
            "id",
            F.upper(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("symbol"),
            F.col("p_name").alias("name"),
            price.alias("current_price"),
            F.round(price * F.col("volume_24h"), 2).alias("market_cap"),
            "volume_24h",
            change.alias("price_change_24h"),
        )
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, asset_id, quantity, cost: one row for each lot bought."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select("user_id", F.col("l_partkey").alias("asset_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("cost"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, source, sentiment. The sentiment is a stand-in: toxic is negative, of good quality is positive, all else neutral."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    sentiment = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", F.col("text").alias("title"), "source", sentiment.alias("sentiment"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, username, email, is_active; the address follows from the name, and is no address for some."""
    name = F.lower("c_name")
    local = F.when(F.col("c_custkey") % 3 == 0, F.replace(name, F.lit("#"), F.lit("."))).otherwise(name)
    host = F.when(F.col("c_custkey") % 5 == 0, "@example").otherwise("@example.com")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat(local, host).alias("email"), (F.col("c_acctbal") >= 0).alias("is_active"))


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """A table of a relational database, read in ranges of a numeric key by as many tasks; the driver class must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, **options).load()


def write_jdbc(df: DataFrame, url: str, name: str, partitions: int = 8, mode: str = "append", **options: str) -> None:
    """df into a table of a relational database, by at most so many connections at once."""
    df.coalesce(partitions).write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def synthetic_candles(spark: SparkSession, symbol: str, interval: str, limit: int | None, as_of: datetime) -> DataFrame:
    """Generated candles that end at as_of, oldest first; an unknown interval counts as an hour, and any symbol but BTC has the lower base."""
    limit = within(limit, CANDLES, "limit")
    # The generator's bases and steps.
    base = 62000 if symbol.upper() == "BTC" else 3200
    offset = F.lit(limit) - F.col("id")
    close = F.lit(base) + 10 * offset
    minutes = offset * INTERVAL_MINUTES.get(interval, 60)
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(mins=minutes.cast("int"))
    text = {"open": close - 35, "high": close + 65, "low": close - 75, "close": close, "volume": 1200 + 8 * offset}
    return spark.range(limit).select(start.alias("open_time"), *(v.cast("string").alias(k) for k, v in text.items())).select(*schemas.CANDLE_CONTRACT)


def synthetic_onchain(spark: SparkSession, symbol: str, metric: str, days: int | None, as_of: datetime) -> DataFrame:
    """A generated daily series; every metric but active_addresses shares one series."""
    days = within(days, DAYS, "days")
    # The generator's bases and steps.
    base, step = (900000, 1300) if metric.lower() == "active_addresses" else (550, 2)
    at = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=(F.lit(days) - F.col("id")).cast("int"))
    return spark.range(days).select(
        F.lit(metric.lower()).alias("metric"), F.lit(symbol.upper()).alias("symbol"), at.alias("timestamp"), (base + step * F.col("id")).cast("string").alias("value"), F.lit("coinmetrics-community").alias("source")
    )


# The rows that stand in for an empty catalogue, the built-in news items and the built-in overview.
MOCK_ASSETS = [
    (1, "BTC", "Bitcoin", "65000.00", "1280000000000", "35000000000", "2.45", True),
    (2, "ETH", "Ethereum", "3200.00", "385000000000", "18000000000", "-1.20", False),
    (3, "SOL", "Solana", "142.00", "62000000000", "3200000000", "5.10", True),
]
NEWS_ITEMS = [
    ("Bitcoin consolida por encima de 62k tras datos macro en EE.UU.", "https://example.com/news/btc-62k", "GDELT", "positive", 0.91),
    ("Aumento de actividad on-chain en Ethereum durante las ultimas 24h", "https://example.com/news/eth-onchain", "GDELT", "neutral", 0.84),
    ("Salida de capital en altcoins de baja capitalizacion", "https://example.com/news/altcoins-outflow", "GDELT", "negative", 0.77),
]
OVERVIEW = ("2450000000000", "156800000000", "48.30", 72)


def mock_assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MOCK_ASSETS, "id long, symbol string, name string, current_price string, market_cap string, volume_24h string, price_change_24h string, is_bullish_24h boolean")


def news_items(spark: SparkSession, as_of: datetime) -> DataFrame:
    rows = spark.createDataFrame(NEWS_ITEMS, "title string, url string, source string, sentiment string, relevance_score double")
    return rows.withColumn("published_at", F.lit(as_of).cast("timestamp_ntz")).select(*schemas.NEWS_CONTRACT)


def fixed_overview(spark: SparkSession, as_of: datetime) -> DataFrame:
    rows = spark.createDataFrame([OVERVIEW], "total_market_cap_usd string, total_volume_24h_usd string, btc_dominance_pct string, fear_greed_index int")
    return rows.withColumn("updated_at", F.lit(as_of).cast("timestamp_ntz")).select(*schemas.OVERVIEW_CONTRACT)
