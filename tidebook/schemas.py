"""Schemas of the market tables, and the ordered output columns of each result."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    """Of "name type" pairs. Unlike a DDL string it needs no session."""
    out = T.StructType()
    for field in text.split(", "):
        out = out.add(*field.split())
    return out


ASSET = _schema(
    "id long, symbol string, name string, current_price decimal(20,8), market_cap decimal(30,2), volume_24h decimal(30,2), "
    "price_change_24h decimal(10,4), coingecko_id string, logo_url string, asset_address string, decimals integer"
)

#: Output columns, in order.
ASSET_CONTRACT = ["id", "symbol", "name", "current_price", "market_cap", "volume_24h", "price_change_24h", "is_bullish_24h", "coingecko_id", "logo_url", "asset_address", "decimals"]
CANDLE_CONTRACT = ["open_time", "open", "high", "low", "close", "volume"]
NEWS_CONTRACT = ["title", "url", "source", "published_at", "sentiment", "relevance_score"]
OVERVIEW_CONTRACT = ["total_market_cap_usd", "total_volume_24h_usd", "btc_dominance_pct", "fear_greed_index", "updated_at"]
