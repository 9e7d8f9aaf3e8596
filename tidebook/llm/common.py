"""What the corpus operators share: tables, scratch tables and joins of checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The same for rows of one id.
BROADCAST_IDS = 1_000_000

#: ASCII white space, U+0020 and U+0009 to U+000D: what separates words.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or with a local master a local folder of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidebook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most limit rows; else as it is, for Spark to shuffle. df should be cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add: an operator's own column replaces one of the same name."""
    wanted = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in wanted))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by their place, which clash with no column that an operator adds, and the new name of each (the first of several alike)."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(reversed(docs.columns), reversed(names), strict=True))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the doc_ids in gone, a table of one column of distinct longs. Rows without doc_id stay; columns stay as they are."""
    rows, name = numbered(docs)
    gone = gone.toDF("gone")
    return rows.join(sized(gone, BROADCAST_IDS), F.col(name["doc_id"]).cast("long") == F.col("gone"), "left_anti").toDF(*docs.columns)


def in_turn(shared: list) -> Iterator:
    """The values of some broadcasts, of which a worker keeps one at a time."""
    for b in shared:
        yield b.value
        if len(shared) > 1:
            vars(b).pop("_value", None)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Each batch in pieces of about `most` bytes of the column (one row at least), to bound a task's memory."""
    for batch in batches:
        data, at, held = batch.column(column), 0, 0
        sizes = pc.binary_length(data).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < len(sizes):
            yield batch.slice(at)


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's UTF-8 bytes; null: none."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()
