"""Positions: accumulated lots, mark to market, profit and loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import columns as C


def split_lots(lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lots of a quantity above 0, and the rejected rest (null too)."""
    valid = F.coalesce(F.col("quantity") > 0, F.lit(False))
    return lots.where(valid), lots.where(~valid)


def positions(lots: DataFrame) -> DataFrame:
    """user_id, asset_id, quantity, purchase_value: the sums of the lots; one row for each pair."""
    return lots.groupBy("user_id", "asset_id").agg(F.sum("quantity").alias("quantity"), F.sum("cost").alias("purchase_value"))


def marked(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """positions with current_value, quantity times the asset's price; null without a price. Spark broadcasts the catalogue if it is small."""
    own = prices.select("asset_id", F.col("price").alias("_price"))
    return positions.join(own, "asset_id", "left").withColumn("current_value", F.col("quantity") * F.col("_price")).drop("_price")


def with_pnl(marked: DataFrame, purchase: str = "purchase_value", current: str = "current_value") -> DataFrame:
    """Adds avg_buy_price, unrealized_pnl and unrealized_pnl_pct."""
    paid, now = F.col(purchase), F.col(current)
    return marked.withColumns({"avg_buy_price": C.avg_buy_price(paid, F.col("quantity")), "unrealized_pnl": C.unrealized_pnl(now, paid), "unrealized_pnl_pct": C.unrealized_pnl_pct(now, paid)})


def add_lots(positions: DataFrame, lots: DataFrame) -> DataFrame:
    """positions with more lots added. As lots don't touch it, the current value stays that of before; a new pair has none."""
    new = lots.withColumnRenamed("cost", "purchase_value").withColumn("current_value", F.lit(None).cast("double"))
    both = positions.select("user_id", "asset_id", "quantity", "purchase_value", "current_value").unionByName(new.select("user_id", "asset_id", "quantity", "purchase_value", "current_value"))
    return both.groupBy("user_id", "asset_id").agg(F.sum("quantity").alias("quantity"), F.sum("purchase_value").alias("purchase_value"), F.max("current_value").alias("current_value"))
