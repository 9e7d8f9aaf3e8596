"""New states of tables, and integrity checks, as DataFrames. Where the table format has MERGE, that does the same in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.sources.market import materialize


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """table with the changes: for each key the change of the highest order replaces the row, or is a new row."""
    rows = [c for c in changes.columns if c != order]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rows), order).alias("_last")).select("_last.*")
    return table.join(last, key, "left_anti").unionByName(last.select(*table.columns))


def upsert_by_symbol(table: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """upsert() by symbol in any case: 'btc' replaces 'BTC'. All symbols come out in upper case."""
    upper = lambda df: df.withColumn("symbol", F.upper("symbol"))
    return upsert(upper(table), upper(changes), "symbol", order)


def numbered(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """df with a gapless number from 1 in the order of some columns, whatever its size.

    A range sort spreads the rows over tasks. They are written once in that order, as a sort that is computed twice need not split alike; then a task's first number comes from the counts of
    the tasks before it, one row for each task.
    """
    rows = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_task", F.shiftright("_at", 33))
    counts = rows.groupBy("_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    firsts = counts.select(F.col("_task").alias("_of"), "_first", before.alias("_before"))
    placed = rows.join(F.broadcast(firsts), F.col("_task") == F.col("_of"), "left")
    number = F.coalesce(F.col("_before") + 1 + F.col("_at") - F.col("_first"), F.raise_error(F.lit("a row without its task")).cast("long"))
    return placed.select(*df.columns, number.alias(column))


def upsert_or_insert(table: DataFrame, changes: DataFrame, key: str, natural: str, order: str | None = None) -> DataFrame:
    """table with the changes: rows with a key replace the row of that key, rows without one are new and get the next keys, in the order of a natural key.

    Of several changes of one key that of the highest `order` (a column of the changes) counts, without one that of the greatest natural key. Keys that the table lacks are added as they are; new keys go on
    from the greatest of both.
    """
    last = F.max_by(F.struct(*table.columns), F.col(order) if order else F.struct(natural, *table.columns)).alias("_last")
    known = changes.where(F.col(key).isNotNull()).groupBy(key).agg(last).select("_last.*")
    most = table.select(key).union(known.select(key)).agg(F.coalesce(F.max(key), F.lit(0)).alias("_most"))
    fresh = changes.where(F.col(key).isNull()).select(*table.columns)
    new = numbered(fresh, [natural], "_number").crossJoin(F.broadcast(most)).withColumn(key, F.col("_most") + F.col("_number")).select(*table.columns)  # most: one row
    return table.join(known.select(key), key, "left_anti").select(*table.columns).unionByName(known).unionByName(new)


def set_column(table: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """One column set in the rows that a condition is true for."""
    return table.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def delete(table: DataFrame, keys: DataFrame, key: str, of: str | None = None) -> DataFrame:
    """table without the rows whose key is among the keys; a missing key changes nothing."""
    gone = keys.select(F.col(key).alias("_gone"))
    return table.join(gone, F.col(of or key) == F.col("_gone"), "left_anti")


def delete_cascade(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """The parent (as "") and each child table without the rows that point to a deleted key; children: name -> (table, column)."""
    return {"": delete(parent, keys, key), **{name: delete(df, keys, key, column) for name, (df, column) in children.items()}}


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def existing(candidates: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return candidates.join(table.select(key), key, "left_semi")


def available(candidates: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return candidates.join(table.select(key), key, "left_anti")


def or_fallback(real: DataFrame, fallback: DataFrame) -> DataFrame:
    """real, or the fallback rows if real has no row; lazy."""
    some = real.limit(1).select(F.lit(1).alias("_some"))
    rest = fallback.withColumn("_some", F.lit(1)).join(F.broadcast(some), "_some", "left_anti").drop("_some")
    return real.unionByName(rest)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


STATES = {"start": "running", "complete": "completed", "fail": "failed"}


def job_states(log: DataFrame) -> DataFrame:
    """job_id, status, result from a log (job_id, action, result, order). The last action decides the status; the result is that of the last completion, also
    after a later failure. Any action may follow any other. A job without one of the actions is pending."""
    state = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    done = F.col("action") == "complete"
    rows = log.groupBy("job_id").agg(F.max_by("action", F.when(F.col("action").isin(*STATES), F.col("order"))).alias("_last"), F.max_by("result", F.when(done, F.col("order"))).alias("result"))
    return rows.select("job_id", F.coalesce(F.try_element_at(state, "_last"), F.lit("pending")).alias("status"), "result")
