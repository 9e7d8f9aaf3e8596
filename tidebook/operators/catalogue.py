"""The asset catalogue: scans, lookups, search, sorting, counts and output contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions import columns as C
from tidebook.schemas import ASSET_CONTRACT


def scan(assets: DataFrame) -> DataFrame:
    """The whole catalogue in its default order."""
    return assets.orderBy("symbol", "id")


def by_symbol(assets: DataFrame, symbol: str) -> DataFrame:
    """The row of a symbol in any case, or none. The equality reaches the scan where the symbol is stored; of a derived one, give the source the symbol too."""
    return assets.where(F.col("symbol") == symbol.upper()).limit(1)


def by_key(df: DataFrame, **keys: object) -> DataFrame:
    """Rows with all the given values, compared exactly."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def first_or_none(df: DataFrame, key: str) -> DataFrame:
    """The row of the smallest key, or none."""
    return df.orderBy(key).limit(1)


def entity(assets: DataFrame) -> DataFrame:
    """Symbols in upper case, zeros of the optional numbers as null, and the bullish flag. The price stays as it is."""
    optional = {c: C.zero_to_null(F.col(c)) for c in ("market_cap", "volume_24h", "price_change_24h")}
    return assets.withColumns({"symbol": F.upper("symbol"), **optional}).withColumn("is_bullish_24h", C.is_bullish(F.col("price_change_24h")))


def contract(assets: DataFrame) -> DataFrame:
    """The rows as they are handed out: decimals as strings, the columns in order; those that the catalogue lacks are null."""
    widths = {"current_price": "decimal(20,8)", "market_cap": "decimal(30,2)", "volume_24h": "decimal(30,2)", "price_change_24h": "decimal(10,4)"}
    rows = entity(assets)
    rows = rows.withColumns({c: F.col(c).cast(w).cast("string") for c, w in widths.items()})
    kinds = {"decimals": "int"}
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in ASSET_CONTRACT))


def search(assets: DataFrame, query: str) -> DataFrame:
    """Assets whose symbol or name contains the trimmed query, in any case; % and _ are plain characters. An empty query takes all."""
    q = query.strip().lower()
    return assets.where(F.contains(F.lower("symbol"), F.lit(q)) | F.contains(F.lower("name"), F.lit(q))) if q else assets


SORTS = {"symbol": "symbol", "price": "current_price", "change": "price_change_24h", "marketCap": "market_cap"}


def sort(assets: DataFrame, field: str = "marketCap", direction: str = "desc") -> DataFrame:
    """By a field, null as 0; ties by symbol."""
    if field not in SORTS or direction not in ("asc", "desc"):
        raise ValueError(f"no such order: {field!r} {direction!r}")
    key: Column = F.col(SORTS[field]) if field == "symbol" else F.coalesce(F.col(SORTS[field]), F.lit(0))
    return assets.orderBy(key.asc() if direction == "asc" else key.desc(), "symbol", "id")


def toggled(field: str, direction: str, chosen: str) -> tuple[str, str]:
    """The order after a field is chosen: the same field turns the direction, another one starts downwards."""
    return (field, "desc" if direction == "asc" else "asc") if chosen == field else (chosen, "desc")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(assets: DataFrame, limit: int, field: str = "marketCap", direction: str = "desc", after: tuple[object, str, int] | None = None) -> DataFrame:
    """The rows of sort() that follow one, given by its key (with 0 for null), symbol and id: the first page without it. Only rows beyond it are sorted, so a late page costs no more than an early one."""
    if field not in SORTS or direction not in ("asc", "desc"):
        raise ValueError(f"no such order: {field!r} {direction!r}")
    if after is not None:
        value, symbol, id_ = after
        key = F.col(SORTS[field]) if field == "symbol" else F.coalesce(F.col(SORTS[field]), F.lit(0))
        beyond = key > F.lit(value) if direction == "asc" else key < F.lit(value)
        assets = assets.where(beyond | (key == F.lit(value)) & ((F.col("symbol") > symbol) | (F.col("symbol") == symbol) & (F.col("id") > id_)))
    return sort(assets, field, direction).limit(limit)


def last_of(page: DataFrame, field: str = "marketCap") -> tuple[object, str, int] | None:
    """What page_after() needs to go on behind a page, which is at most its limit of rows; None for an empty one."""
    rows = page.collect()
    return (rows[-1][SORTS[field]] or (0 if field != "symbol" else ""), rows[-1]["symbol"], rows[-1]["id"]) if rows else None


#: A collation that takes letters of either case and with or without accents as one, in the order of the root locale.
LOCALE = "UNICODE_CI_AI"


def search_locale(assets: DataFrame, query: str, collation: str = LOCALE) -> DataFrame:
    """search() by a collation: "resume" finds "Résumé"."""
    q = query.strip()
    wanted = F.collate(F.lit(q), collation)
    return assets.where(F.contains(F.collate("symbol", collation), wanted) | F.contains(F.collate("name", collation), wanted)) if q else assets


def sort_locale(assets: DataFrame, column: str = "symbol", collation: str = "UNICODE") -> DataFrame:
    """By a text column in the order of a locale: a, A, á, b; ties by the column's bytes, then id."""
    return assets.orderBy(F.collate(column, collation), column, "id")


def counts(assets: DataFrame) -> DataFrame:
    """total, bullish and bearish assets; null and 0 count as bearish."""
    up = C.is_bullish(F.col("price_change_24h"))
    return assets.agg(F.count("*").alias("total"), F.count_if(up).alias("bullish"), F.count_if(~up).alias("bearish"))


def screen(assets: DataFrame) -> DataFrame:
    """What the market screen shows of each asset."""
    change = F.col("price_change_24h")
    return assets.select(
        "id", "symbol", C.badge(F.col("symbol")).alias("badge"), C.is_up(change).alias("is_up"), C.is_bullish(change).alias("is_bullish"),
        C.billions(F.col("market_cap"), 2, zero_dash=True).alias("market_cap_2dp"), C.billions(F.col("market_cap"), 1).alias("market_cap_1dp"),
    )
