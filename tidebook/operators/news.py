"""The news feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.params import NEWS_ITEMS, within


def filtered(news: DataFrame, query: str = "", sentiment: str = "all") -> DataFrame:
    """Items whose title contains the trimmed query in any case, of one sentiment; an empty query and '' or 'all' take everything."""
    q, s = query.strip().lower(), sentiment.strip().lower()
    if s not in ("", "all"):
        news = news.where(F.col("sentiment") == s)
    return news.where(F.contains(F.lower("title"), F.lit(q))) if q else news


def feed(news: DataFrame, order: str, query: str = "", sentiment: str = "all", limit: int | None = None) -> DataFrame:
    """The first items of the filtered feed in input order; the relevance score doesn't order them."""
    return filtered(news, query, sentiment).orderBy(order).limit(within(limit, NEWS_ITEMS, "limit"))


def sentiment_counts(news: DataFrame) -> DataFrame:
    return news.groupBy("sentiment").agg(F.count("*").alias("items"))
