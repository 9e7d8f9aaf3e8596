"""Technical indicators on the closes of each symbol's candles.

Moving means and bands are windows over candles: a few thousand rows a year for each symbol, whatever the number of ticks. The recursive ones (EMA, MACD, RSI) are run by slices of a day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.params import ANALYSES, SYMBOL_LENGTH, one_of

PLACES = 6


def sma(candles: DataFrame, n: int = 20) -> DataFrame:
    """symbol, open_time, sma: null for the first n - 1 candles."""
    last = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(1 - n, 0)
    value = F.when(F.count("close").over(last) == n, F.round(F.avg("close").over(last), PLACES))
    return candles.select("symbol", "open_time", value.alias("sma"))


def bollinger(candles: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """symbol, open_time, lower_band, middle_band, upper_band: the mean and so many population deviations around it."""
    last = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(1 - n, 0)
    rows = candles.select("symbol", "open_time", F.count("close").over(last).alias("_n"), F.avg("close").over(last).alias("_m"), F.stddev_pop("close").over(last).alias("_s"))
    band = lambda k: F.when(F.col("_n") == n, F.round(F.col("_m") + k * F.col("_s"), PLACES))
    return rows.select("symbol", "open_time", band(-width).alias("lower_band"), band(0.0).alias("middle_band"), band(width).alias("upper_band"))


def smoothed(rows: DataFrame, averages: dict[str, tuple[str, float]], seeds: dict[str, str] | None = None) -> DataFrame:
    """rows (symbol, open_time and others) with running averages: name -> (column x, share w), each e = (1 - w) * e + w * x in the order of time. It begins with its seed, a column whose value
    in a symbol's first row counts, or else with the first x.

    Such a step is affine in e, and so are several in a row: a slice of a symbol and a day becomes one factor and one summand, whatever came before it. The slices of a symbol, one short row a
    day, give each slice's beginning; then every slice is run by itself. All of it is Spark's own functions, and no task has more than a day of a symbol's candles.
    """
    seeds = {n: (seeds or {}).get(n, x) for n, (x, _) in averages.items()}
    kinds = ", ".join(f"{n}: double" for n in averages)
    run = lambda of, row: ", ".join(f"'{n}', {1 - w!r}D * {of}.{n} + {w!r}D * {row}.{x}" for n, (x, w) in averages.items())
    sliced = rows.groupBy("symbol", F.date_trunc("day", "open_time").alias("_day")).agg(F.sort_array(F.collect_list(F.struct("open_time", *(c for c in rows.columns if c not in ("symbol", "open_time"))))).alias("_rows"))
    nothing = ", ".join(f"'{n}', 0D" for n in averages)
    sums = sliced.select("symbol", "_day", F.size("_rows").alias("_n"), F.expr(f"aggregate(_rows, named_struct({nothing}), (e, r) -> named_struct({run('e', 'r')}))").alias("_sum"), F.expr(f"named_struct({', '.join(f"'{n}', CAST(_rows[0].{c} AS DOUBLE)" for n, c in seeds.items())})").alias("_seed"))
    days = sums.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("_day", "_n", "_sum", "_seed"))).alias("_days"))
    after = ", ".join(f"'{n}', pow({1 - w!r}D, d._n) * a.e.{n} + d._sum.{n}" for n, (_, w) in averages.items())
    begins = f"aggregate(_days, named_struct('e', _days[0]._seed, 'all', CAST(array() AS ARRAY<STRUCT<_day: TIMESTAMP_NTZ, e: STRUCT<{kinds}>>>)), (a, d) -> named_struct('e', named_struct({after}), 'all', concat(a.all, array(named_struct('_day', CAST(d._day AS TIMESTAMP_NTZ), 'e', a.e)))))"
    starts = days.select("symbol", F.expr(f"inline({begins}.all)")).select(F.col("symbol").alias("_s"), F.col("_day").alias("_d"), F.col("e").alias("_e"))
    joined = sliced.join(starts, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_day").cast("timestamp_ntz") == F.col("_d")))
    each = f"aggregate(_rows, named_struct('e', _e, 'all', CAST(array() AS ARRAY<STRUCT<{kinds}>>)), (a, r) -> named_struct('e', named_struct({run('a.e', 'r')}), 'all', concat(a.all, array(named_struct({run('a.e', 'r')})))), a -> a.all)"
    found = joined.select("symbol", "_rows", F.expr(each).alias("_found")).select("symbol", F.expr("inline(arrays_zip(_rows, _found))"))
    return found.select("symbol", "_rows.*", "_found.*")


def _closes(candles: DataFrame) -> DataFrame:
    return candles.select("symbol", "open_time", F.col("close").cast("double").alias("close"))


def _span(n: int) -> float:
    return 2 / (n + 1)


def ema(candles: DataFrame, n: int = 12) -> DataFrame:
    """symbol, open_time, ema: seeded with the first close."""
    return smoothed(_closes(candles), {"ema": ("close", _span(n))}).select("symbol", "open_time", F.round("ema", PLACES).alias("ema"))


def macd(candles: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """symbol, open_time, macd, signal, histogram; each mean is seeded with its first value."""
    line = smoothed(_closes(candles), {"fast": ("close", _span(fast)), "slow": ("close", _span(slow))}).select("symbol", "open_time", (F.col("fast") - F.col("slow")).alias("macd"))
    both = smoothed(line, {"signal": ("macd", _span(signal))})
    shown = {"macd": F.col("macd"), "signal": F.col("signal"), "histogram": F.col("macd") - F.col("signal")}
    return both.select("symbol", "open_time", *(F.round(v, PLACES).alias(k) for k, v in shown.items()))


def rsi(candles: DataFrame, n: int = 14) -> DataFrame:
    """symbol, open_time, rsi by Wilder's smoothing, which begins with the plain means of n moves; 100 where there was no loss, null until n moves are there."""
    by_time = Window.partitionBy("symbol").orderBy("open_time")
    last = by_time.rowsBetween(1 - n, 0)
    moves = _closes(candles).withColumns({"_at": F.row_number().over(by_time) - 1, "_move": F.col("close") - F.lag("close").over(by_time)})
    moves = moves.withColumns({"up": F.greatest("_move", F.lit(0.0)), "down": F.greatest(-F.col("_move"), F.lit(0.0))})
    moves = moves.withColumns({"_up": F.avg("up").over(last), "_down": F.avg("down").over(last)})
    # at row n the average is the seed itself, so that is what the first step takes
    first = F.col("_at") == n
    later = moves.where(F.col("_at") >= n).select("symbol", "open_time", *(F.when(first, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("up", "down")))
    found = smoothed(later, {"gain": ("up", 1 / n), "loss": ("down", 1 / n)})
    value = F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("gain", "loss")))
    early = moves.where(F.col("_at") < n).select("symbol", "open_time", F.lit(None).cast("double").alias("rsi"))
    return found.select("symbol", "open_time", F.round(value, PLACES).alias("rsi")).unionByName(early)


INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {"RSI": rsi, "MACD": macd, "SMA": sma, "EMA": ema, "BOLLINGER": bollinger}


def run_analysis(candles: DataFrame, symbol: str, kind: str) -> DataFrame:
    """One row in the shape of a job record: the indicator's last values of the symbol as JSON. Without candles of it there is no row."""
    one_of(kind, ANALYSES, "analysis type")
    if not symbol or len(symbol) > SYMBOL_LENGTH:
        raise ValueError(f"symbol must have 1 to {SYMBOL_LENGTH} characters")
    values = INDICATORS[kind](candles.where(F.col("symbol") == symbol.upper()))
    names = [c for c in values.columns if c not in ("symbol", "open_time")]
    last = values.groupBy("symbol").agg(F.max_by(F.struct(*names), "open_time").alias("last"))
    return last.select(F.lit(0).cast("long").alias("id"), F.lit(symbol).alias("asset_symbol"), F.lit(kind).alias("analysis_type"), F.lit("completed").alias("status"), F.to_json("last").alias("result"))
