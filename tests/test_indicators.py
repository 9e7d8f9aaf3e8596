"""Running averages against plain loops, over days of one candle and of many."""

import random
from datetime import datetime, timedelta

import pytest

from tidebook.operators import indicators


def closes(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    out, at = [], {s: datetime(2024, 1, 1) for s in ("A", "B", None)}
    for _ in range(n):
        s = rng.choice(["A", "A", "A", "B", None])
        at[s] += timedelta(hours=rng.choice([1, 1, 1, 1, 7, 30]))
        out.append((s, at[s], round(rng.uniform(1, 100), 2)))
    return out


def loop_ema(xs: list[float], n: int) -> list[float]:
    out = [xs[0]]
    for x in xs[1:]:
        out.append(2 / (n + 1) * x + (1 - 2 / (n + 1)) * out[-1])
    return out


def loop_rsi(xs: list[float], n: int) -> list[float | None]:
    out: list[float | None] = [None] * min(n, len(xs))
    moves = [b - a for a, b in zip(xs, xs[1:])]
    gain = loss = 0.0
    for i in range(n, len(xs)):
        if i == n:
            gain, loss = (sum(max(s * m, 0) for m in moves[:n]) / n for s in (1, -1))
        else:
            gain, loss = ((g * (n - 1) + max(s * moves[i - 1], 0)) / n for g, s in ((gain, 1), (loss, -1)))
        out.append(100.0 if loss == 0 else 100 - 100 / (1 + gain / loss))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_as_plain_loops(spark, seed):
    rows = closes(seed, 400)
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, close double").repartition(3)
    by_symbol = {s: [r for r in rows if r[0] == s] for s in ("A", "B", None)}
    for name, found, loop in (("ema", indicators.ema(df, 5), lambda x: loop_ema(x, 5)), ("rsi", indicators.rsi(df, 6), lambda x: loop_rsi(x, 6))):
        got = {(r.symbol, r.open_time): r[name] for r in found.collect()}
        assert len(got) == len(rows)
        for s, mine in by_symbol.items():
            for (_, at, _), wanted in zip(mine, loop([r[2] for r in mine])):
                assert got[s, at] == (None if wanted is None else pytest.approx(wanted, abs=2e-6))
    got = {(r.symbol, r.open_time): tuple(r)[2:] for r in indicators.macd(df, 3, 8, 4).collect()}
    for s, mine in by_symbol.items():
        xs = [r[2] for r in mine]
        line = [a - b for a, b in zip(loop_ema(xs, 3), loop_ema(xs, 8))]
        for (_, at, _), m, e in zip(mine, line, loop_ema(line, 4)):
            assert got[s, at] == pytest.approx((m, e, m - e), abs=2e-6)


def test_too_few_candles(spark):
    df = spark.createDataFrame([("A", datetime(2024, 1, i + 1), float(i)) for i in range(3)], "symbol string, open_time timestamp_ntz, close double")
    assert [r.rsi for r in indicators.rsi(df).collect()] == [None] * 3
    for f in (indicators.ema, indicators.macd, indicators.rsi):
        assert f(df.limit(0)).count() == 0
