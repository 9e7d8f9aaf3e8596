"""Counts and sums of the points in spans, without their pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.oracle import difference
from tests.test_intervals import NUMBERS, spans
from tidebook.operators import intervals
from tidebook.plans.registry import ORACLE_SQL, QUERIES

POINTS = "p int, k string, x double, v long"


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_as_every_pair(spark, partitions):
    """Over one range and several; some volumes pass a long together."""
    rng = random.Random(5)
    points = [(i, "a", rng.choice([*NUMBERS, 1.5, 5.0, -3.0, -0.0, None, float("nan"), float("inf")]), rng.choice([None, 0, -7, 3, 2**61])) for i in range(150)]
    bands = [*spans(6, 80)[:-1], (90, "a", 1.0, float("inf")), (91, "a", float("nan"), float("nan")), (92, "a", 200.0, 300.0), (93, "a", -0.0, 0.25)]
    inside = {s: [v for _, _, x, v in points if None not in (x, a, b) and a <= x < b] for s, _, a, b in bands if None not in (a, b) and a < b}
    total = lambda vs: sum(known) if (known := [v for v in vs if v is not None]) else None
    fits = lambda vs: total(vs) is None or abs(total(vs)) < 2**63
    kept = [b for b in bands if fits(inside.get(b[0], []))]
    assert len(kept) > 50
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = intervals.totals_in_spans(spark.createDataFrame(points, POINTS), "x", spark.createDataFrame(kept, "s int, k string, lo double, hi double"), "lo", "hi", "v")
        assert found.columns == ["s", "k", "lo", "hi", "n", "v"]
        assert sorted((r.s, r.n, r.v is None, r.v or 0) for r in found.collect()) == sorted((b[0], len(vs := inside[b[0]]), total(vs) is None, total(vs) or 0) for b in kept if b[0] in inside)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ends(spark):
    points, bands = spark.createDataFrame([(1, "a", 2.0, 5)], POINTS), spark.createDataFrame([(1, 0.0, 3.0)], "s int, lo double, hi double")
    assert intervals.totals_in_spans(points, "x", bands.limit(0), "lo", "hi", "v").count() == 0
    assert list(map(tuple, intervals.totals_in_spans(points.limit(0), "x", bands, "lo", "hi", "v").collect())) == [(1, 0.0, 3.0, 0, None)]
    with pytest.raises(TypeError, match="whole numbers"):
        intervals.totals_in_spans(points, "x", bands, "lo", "hi", "x")


def test_bands_of_many_ticks(spark, tmp_path):
    """100,000 ticks in each of 100,000 bands: ten billion pairs, whose number must not be the work."""
    n = 100_000
    spark.range(n).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), (10 + F.col("id") % 100 / 100).alias("value"), F.lit('{"k": 3}').alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit(24).alias("s_nationkey"), (F.col("id") % 200 - 100.0).alias("s_acctbal")).write.parquet(str(tmp_path / "supplier.parquet"))
    began = time.time()
    found = QUERIES["price_bands"](spark, str(tmp_path)).groupBy("n", "volume").count().collect()
    assert list(map(tuple, found)) == [(n, 3 * n, n)]
    assert time.time() - began < 60


def test_bands_as_duckdb(spark, tmp_path):
    """Repeated and missing bands, missing prices and volumes."""
    ticks = [(1, 1.0, '{"k": 1}'), (2, 1.0, None), (3, None, '{"k": 2}'), (4, 30.0, "{}"), (5, 2.5, '{"k": 4}'), (6, 0.0, '{"k": 5}')]
    bands = [(1, 0, 25.0), (1, 2, -25.0), (None, 1, 50.0), (2, 0, None), (3, 0, 750.0), (4, None, 25.0), (5, 0, 2000.0)]
    when = F.lit("2024-01-01").cast("timestamp_ntz").alias("ts")
    spark.createDataFrame(ticks, "event_id long, value double, props string").select("*", when, F.lit("view").alias("event_type")).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame(bands, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    assert difference(QUERIES["price_bands"], ORACLE_SQL["price_bands"], spark, str(tmp_path)) == ""
