"""Checks of arguments, before any plan is built."""

from __future__ import annotations

# The choices, bounds and defaults of the public interface.
INTERVAL_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440}
METRICS = ("active_addresses", "hashrate", "tx_count", "gas_price")
SENTIMENTS = ("all", "positive", "neutral", "negative")
ANALYSES = ("RSI", "MACD", "SMA", "EMA", "BOLLINGER")
CANDLES, DAYS, NEWS_ITEMS = (10, 500, 120), (7, 365, 30), (1, 100, 20)
SYMBOL_LENGTH = 20


def one_of(value: str, choices: tuple[str, ...] | dict, name: str) -> str:
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(choices)}; it is {value!r}")
    return value


def within(value: int | None, bounds: tuple[int, int, int], name: str) -> int:
    """value, or the default if it is None; bounds: least, most, default."""
    least, most, default = bounds
    value = default if value is None else value
    if not least <= value <= most:
        raise ValueError(f"{name} must be from {least} to {most}; it is {value}")
    return value
