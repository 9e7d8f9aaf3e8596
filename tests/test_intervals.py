import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebook.operators import candles, intervals, sketches

NUMBERS = [0.0, 0.5, 1.0, 1.0, 2.0, 3.75, 4.0, 7.9, 8.0, 100.0, 1e6, -1.0, -8.0, -7.5, 1e-9]


def spans(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), rng.choice(NUMBERS), rng.choice(NUMBERS)) for i in range(n)] + [(n, "a", None, 1.0), (n + 1, None, 0.0, 5.0), (n + 2, "b", 0.0, float("nan"))]


def test_points_in_spans(spark):
    rng = random.Random(1)
    points = [(i, rng.choice("abc"), rng.choice([*NUMBERS, 1.5, 5.0, -3.0, None])) for i in range(60)]
    bands = spans(2, 60)[:-1]  # nan: below
    left, right = spark.createDataFrame(points, "p int, k string, x double"), spark.createDataFrame(bands, "s int, k string, lo double, hi double")
    holds = lambda x, a, b: None not in (x, a, b) and a <= x < b
    found = intervals.within_spans(left, "x", right.withColumnRenamed("k", "k2"), "lo", "hi")
    assert found.columns == ["p", "k", "x", "s", "k2", "lo", "hi"]
    assert sorted((r.p, r.s) for r in found.collect()) == sorted((p, s) for p, _, x in points for s, _, a, b in bands if holds(x, a, b))
    found = intervals.within_spans(left, "x", right, "lo", "hi", ["k"])
    assert sorted((r.p, r.s) for r in found.collect()) == sorted((p, s) for p, k, x in points for s, j, a, b in bands if k is not None and k == j and holds(x, a, b))
    assert intervals.within_spans(left, "x", right.limit(0), "lo", "hi", ["k"]).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_overlapping_spans(spark, seed):
    x, y = spans(seed, 50)[:-1], spans(seed + 10, 40)[:-1]
    a, b = spark.createDataFrame(x, "i int, k string, a0 double, a1 double"), spark.createDataFrame(y, "j int, k string, b0 double, b1 double")
    fits = lambda p, q, r, s: None not in (p, q, r, s) and p < q and r < s and p < s and r < q
    pairs = intervals.overlapping(a, b.withColumnRenamed("k", "k2"), ("a0", "a1"), ("b0", "b1"))
    assert sorted((r.i, r.j) for r in pairs.collect()) == sorted((i, j) for i, _, p, q in x for j, _, r, s in y if fits(p, q, r, s))
    pairs = intervals.overlapping(a, b, ("a0", "a1"), ("b0", "b1"), ["k"])
    assert sorted((r.i, r.j) for r in pairs.collect()) == sorted((i, j) for i, k, p, q in x for j, m, r, s in y if k is not None and k == m and fits(p, q, r, s))


def test_spans_of_time_and_plans(spark, capsys):
    at = datetime(2024, 1, 1)
    trades = spark.createDataFrame([(i, at + timedelta(minutes=7 * i)) for i in range(50)], "t int, ts timestamp_ntz")
    valid = spark.createDataFrame([(i, at + timedelta(hours=i), at + timedelta(hours=i + 2)) for i in range(4)], "v int, since timestamp_ntz, until timestamp_ntz")
    found = intervals.within_spans(trades, "ts", valid, "since", "until")
    assert sorted((r.t, r.v) for r in found.collect()) == sorted((t, v) for t in range(50) for v in range(4) if 60 * v <= 7 * t < 60 * (v + 2))
    both = intervals.overlapping(valid, valid.toDF("w", "s2", "u2"), ("since", "until"), ("s2", "u2"))
    assert sorted((r.v, r.w) for r in both.collect()) == [(i, j) for i in range(4) for j in range(4) if abs(i - j) < 2]
    for df in (found, both):
        df.explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_gapless_candles(spark):
    rows = [("A", 0, 1.0, 3.0, 1.0, 2.0, 5), ("A", 3, 2.0, 2.0, 1.0, 1.0, 1), ("A", 49, 7.0, 7.0, 7.0, 7.0, 2), ("B", 5, 4.0, 4.0, 4.0, 4.0, None)]
    df = spark.createDataFrame([(s, datetime(2024, 1, 1) + timedelta(hours=h), *x) for s, h, *x in rows], "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume long")
    found = {(r.symbol, (r.open_time - datetime(2024, 1, 1)) // timedelta(hours=1)): tuple(r)[2:] for r in candles.gapless(df).collect()}
    assert len(found) == 51 and ("B", 5) in found
    assert (found["A", 0], found["A", 1], found["A", 2]) == ((1.0, 3.0, 1.0, 2.0, 5), (2.0, 2.0, 2.0, 2.0, 0), (2.0, 2.0, 2.0, 2.0, 0))
    assert (found["A", 3], found["A", 48], found["A", 49], found["B", 5]) == ((2.0, 2.0, 1.0, 1.0, 1), (1.0, 1.0, 1.0, 1.0, 0), (7.0, 7.0, 7.0, 7.0, 2), (4.0, 4.0, 4.0, 4.0, None))
    assert candles.gapless(df.limit(0)).count() == 0


def test_sketches_are_mergeable_and_near(spark, tmp_path):
    n = 60_000
    day = (F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 6).cast("int"))).alias("ts")
    user = F.when(F.col("id") % 100 != 0, F.col("id") % 20_000).alias("user_id")
    ticks = spark.range(n).select(F.lit("A").alias("symbol"), day, (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10.0).alias("price"), user)
    for some in ("id % 2 = 0", "id % 2 = 1"):  # two parts of every day
        part = spark.range(n).where(some).select(F.lit("A").alias("symbol"), day, (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10.0).alias("price"), user)
        sketches.append_daily(sketches.daily(part), str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    for where in ("true", "day BETWEEN DATE'2024-01-02' AND DATE'2024-01-03'"):
        exact = ticks.where(where.replace("day", "to_date(ts)")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), *(F.percentile("price", F.lit(q)).alias(f"q{q}") for q in (0.1, 0.5, 0.99))).first()
        total = sketches.merged(stored.where(where), ["symbol"])
        about = sketches.estimates(total, {"low": 0.1, "mid": 0.5, "high": 0.99}).first()
        assert about.n == exact.n
        assert abs(about.users - exact.users) <= 0.05 * exact.users
        for name, q in (("low", 0.1), ("mid", 0.5), ("high", 0.99)):
            share = ticks.where(where.replace("day", "to_date(ts)")).agg((F.count_if(F.col("price") <= about[name]) / F.count("*"))).first()[0]
            assert abs(share - q) < 0.02
        rank = sketches.ranks(total, {"half": exact["q0.5"]}).first().half
        assert abs(rank - 0.5) < 0.02
