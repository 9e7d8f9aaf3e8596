"""Joins by containment and overlap of spans: bins instead of a comparison of everything with everything.

A span's level is the power of two just above its length; at that level it lies in one bin or two. A point, or a shorter span, is put into its bins at each level that the
other side has (they are few: powers of two). So pairs meet by equality, and spans of seconds and of years don't spoil each other's bins. Each pair is kept in one agreed
bin alone. Rows with a null bound, and spans that end before they begin or where they begin, are in no pair.

Where only counts and sums of the points in a span are asked for, totals_in_spans() has them without any pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.sources.market import materialize

#: Levels that are told apart; lengths beyond are put into the last ones.
LOWEST, HIGHEST = -40, 80


def _number(df: DataFrame, column: str) -> Column:
    """Times as microseconds."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType | T.TimestampType | T.DateType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz")).cast("double")
    return F.col(column).cast("double")


def _spans(df: DataFrame, start: str, stop: str) -> DataFrame:
    """df with _a, _b and _level."""
    rows = df.withColumns({"_a": _number(df, start), "_b": _number(df, stop)}).where("_a < _b")
    level = F.ceil(F.log2(F.col("_b") - F.col("_a"))).cast("int")
    return rows.withColumn("_level", F.least(F.greatest(level, F.lit(LOWEST)), F.lit(HIGHEST)))


def _levels(spans: DataFrame) -> list[int]:
    """At most HIGHEST - LOWEST + 1 numbers."""
    return sorted(r[0] for r in spans.select("_level").distinct().collect())


def _bin(x: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), F.col("_level")))


def _last(b: Column) -> Column:
    """The last bin that a span that ends before b is in: b itself isn't part of it."""
    width = F.pow(F.lit(2.0), F.col("_level"))
    return F.ceil(b / width) - 1


def _in_bins(spans: DataFrame) -> DataFrame:
    return spans.withColumn("_from", _bin(F.col("_a"))).withColumn("_bin", F.explode(F.sequence("_from", F.greatest("_from", _last(F.col("_b"))))))


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*(f"{prefix}{c}" for c in df.columns))


def within_spans(points: DataFrame, at: str, spans: DataFrame, start: str, stop: str, on: list[str] | None = None) -> DataFrame:
    """Each point with each span that has start <= at < stop (and the same values of `on`): the points' columns as they are, then the spans' but for `on`. Names must differ."""
    on = on or []
    kept = [c for c in spans.columns if c not in on]
    levels = _levels(with_level := _spans(spans, start, stop))
    placed = points.withColumn("_x", _number(points, at)).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    placed = placed.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", _bin(F.col("_x")))
    right = _side(_in_bins(with_level), "s_")
    same = [F.col(c) == F.col(f"s_{c}") for c in ("_level", "_bin", *on)]
    pairs = placed.join(right, same).where("s__a <= _x AND _x < s__b")
    return pairs.select(*points.columns, *(F.col(f"s_{c}").alias(c) for c in kept))


def _sums_below(values: DataFrame, names: list[str]) -> DataFrame:
    """values, which has a row for each _x, with each of these columns summed over the rows of a lesser _x.

    One range sort, written once: running sums within each range, and before them those of the ranges themselves, one row for each.
    """
    ranged = materialize(values.repartitionByRange("_x").withColumn("_range", F.spark_partition_id()), "ranges")
    ranges, within = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.orderBy("_range"), Window.partitionBy("_range").orderBy("_x")))
    summed = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(c) for c in names)).select("_range", *(summed(c, ranges).alias(f"_before{c}") for c in names))
    return ranged.withColumns({c: summed(c, within) for c in names}).join(F.broadcast(totals), "_range").withColumns({c: F.col(c) + F.col(f"_before{c}") for c in names}).select(*values.columns)


def totals_in_spans(points: DataFrame, at: str, spans: DataFrame, start: str, stop: str, column: str) -> DataFrame:
    """spans with n, the number of points that have start <= at < stop, and the sum of a column of theirs (whole numbers; null if none has one). Spans that hold no moment are left out.

    That is what lies below stop, less what lies below start. Points of one place and equal bounds are one row each before they are sorted, so the work grows with points and
    spans, not with their pairs, however many spans a point is in.
    """
    if not isinstance(points.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} must have whole numbers: differences of other sums aren't exact")
    rows = spans.withColumns({"_a": _number(spans, start), "_b": _number(spans, stop)}).where("_a < _b")
    placed = points.withColumn("_x", _number(points, at)).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    value = F.col(column).cast("decimal(20,0)")  # the sum over all points may pass a long where no span's does
    valued = placed.groupBy("_x").agg(F.count("*").alias("_n"), F.count(column).alias("_known"), F.sum(value).alias("_sum"), F.lit(False).alias("_bound"))
    nothing = F.lit(0).cast("long")
    bounds = rows.select(F.explode(F.array("_a", "_b")).alias("_x")).distinct().select("_x", nothing.alias("_n"), nothing.alias("_known"), nothing.cast("decimal(30,0)").alias("_sum"), F.lit(True).alias("_bound"))
    sums = ["_n", "_known", "_sum"]
    places = valued.unionByName(bounds).groupBy("_x").agg(*(F.sum(c).alias(c) for c in sums), F.bool_or("_bound").alias("_bound"))
    below = _sums_below(places, sums).where("_bound").drop("_bound")
    from_, to = _side(below, "from"), _side(below, "to")
    both = rows.join(from_, F.col("_a") == F.col("from_x")).join(to, F.col("_b") == F.col("to_x"))
    n, known, total = (F.col(f"to{c}") - F.col(f"from{c}") for c in sums)
    return both.select(*spans.columns, n.alias("n"), F.when(known > 0, total.cast("long")).alias(column))


def _longer_first(long: DataFrame, short: DataFrame, on: list[str], strict: bool) -> DataFrame:
    """Overlapping pairs whose first span has the higher level (or the same, unless strict); columns of long with l_, of short with s_."""
    levels = F.array(*map(F.lit, _levels(long))).cast("array<int>")
    up = F.filter(levels, lambda x: (x > F.col("_own")) if strict else (x >= F.col("_own")))
    raised = short.withColumnRenamed("_level", "_own").withColumn("_level", F.explode(up))
    left, right = _side(_in_bins(long), "l_"), _side(_in_bins(raised), "s_")
    pairs = left.join(right, [F.col(f"l_{c}") == F.col(f"s_{c}") for c in ("_level", "_bin", *on)])
    return pairs.where("l__a < s__b AND s__a < l__b AND l__bin = greatest(l__from, s__from)")  # the bin in which the later one begins


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], on: list[str] | None = None) -> DataFrame:
    """Each pair of a row of a and one of b whose spans [start, stop) share a moment (and the same values of `on`): a's columns as they are, then b's but for `on`. Names must differ."""
    on = on or []
    x, y = _spans(a, *a_span), _spans(b, *b_span)
    kept = [c for c in b.columns if c not in on]
    out = lambda pairs, p, q: pairs.select(*(F.col(f"{p}{c}").alias(c) for c in a.columns), *(F.col(f"{q}{c}").alias(c) for c in kept))
    return out(_longer_first(x, y, on, False), "l_", "s_").unionByName(out(_longer_first(y, x, on, True), "s_", "l_"))
