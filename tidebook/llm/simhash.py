"""Near-duplicates by SimHash fingerprints and a segment-popcount embedding.

The 64 bits are cut into 16 segments of 4, and a fingerprint maps to its 16 bit counts. A differing bit
moves one count by one at most, so the Manhattan distance of the counts is a lower bound of the number of differing
bits: fingerprints within 2 bits lie within Manhattan distance 2. On the grid of counts, two such points are the same
point, or neighbours, or have a common neighbour; so every fingerprint goes into its own cell
and the cells one step up or down, and one equality join finds the candidates. Each candidate pair meets in one agreed cell,
and its bits are compared there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import as_bytes, materialize, sized, slices, without
from tidebook.llm.graph import connected_components

SEGMENTS, BITS = 16, 4
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash over XXH64 of the text's word shingles, as a signed 64-bit integer; 0 for no words."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = xxhash.xxh64_digest(joined, seed)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        pieces = map(joined.__getitem__, map(slice, (end - size)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist()))
        hashes = b"".join(map(xxhash.xxh64_digest, pieces, repeat(seed)))
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(rows[i : i + BLOCK], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(rows), BLOCK))
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, column: str = "_fp") -> DataFrame:
    """doc_id and the fingerprint of the whole text; null text: 0. One row for each row of docs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = pa.array(map(fingerprint, as_bytes(batch, "text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", column])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, f"doc_id long, {column} long")


def _cells(fp: Column) -> Column:
    """(role, cell) of a fingerprint: its own cell has role 0, a step up in segment i has role 1 + i, a step down -1 - i. Counts have 3 bits each in the cell."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))).cast("long") for i in range(SEGMENTS)]
    own = sum((n * F.lit(1 << 3 * i) for i, n in enumerate(counts)), F.lit(0).cast("long"))
    cell = lambda role, at: F.struct(F.lit(role).cast("byte").alias("role"), at.alias("cell"))
    ups = [F.when(n < BITS, cell(1 + i, own + F.lit(1 << 3 * i))) for i, n in enumerate(counts)]
    downs = [F.when(n > 0, cell(-1 - i, own - F.lit(1 << 3 * i))) for i, n in enumerate(counts)]
    return F.array_compact(F.array(cell(0, own), *ups, *downs))


def fingerprint_links(prints: DataFrame, most_bits: int = 2) -> DataFrame:
    """Pairs (a, b) of ids of distinct fingerprints that differ in at most most_bits (0 to 2) bits.

    prints: (id, fp), one row for each distinct fingerprint. Copies are no longer there, and a fingerprint
    has at most 2,080 others within 2 bits, so the links grow in proportion to the fingerprints.
    """
    if not 0 <= most_bits <= 2:
        raise ValueError("the grid finds pairs of up to 2 differing bits")
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.repartition(partitions).select("id", "fp", F.explode(_cells(F.col("fp"))).alias("c")).select("id", "fp", "c.role", "c.cell")
    a, b = spread.alias("a"), spread.alias("b")
    role_a, role_b = F.col("a.role"), F.col("b.role")
    meets = (
        ((role_a == 0) & (role_b == 0) & (F.col("a.fp") < F.col("b.fp")))  # same counts
        | ((role_a == 0) & (role_b > 0))  # one step apart
        | ((role_a > 0) & (role_b > role_a))  # one up and one down
        | ((role_a > 0) & (role_b < 0) & (role_a <= -role_b))  # two up
    )
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most_bits
    # never broadcast: Spark sizes exploded rows like the fingerprints that they come from, 33 times too low
    return a.hint("merge").join(b, (F.col("a.cell") == F.col("b.cell")) & meets & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def near_duplicates(docs: DataFrame, most_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links lead to; one row for each row of docs.

    A null or empty text has fingerprint zero and links like any other. Where rows repeat a doc_id, each
    is grouped by its own text; groups that have the same smallest doc_id are one. Rows without doc_id link others, but name no group: component_id
    is null if no row of the group has one. Other columns are ignored. An empty table gives no rows.
    """
    prints = materialize(with_fingerprints(docs), "fingerprints")
    classes = materialize(prints.groupBy("_fp").agg(F.min("doc_id").alias("id")).withColumnRenamed("_fp", "fp"), "classes")
    groups = connected_components(fingerprint_links(classes.select(F.col("fp").alias("id"), "fp"), most_bits))  # of fingerprints, as a class may have no doc_id
    linked = materialize(groups.join(classes, F.col("node") == F.col("fp")).select("node", "component", "id"), "linked")
    least = linked.groupBy(F.col("component").alias("_of")).agg(F.min("id").alias("least"))
    named = linked.join(sized(materialize(least, "least")), F.col("component") == F.col("_of")).select("node", "least")
    ids = materialize(classes.join(sized(materialize(named, "named")), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("least", "id").alias("component_id")), "groups")
    return prints.join(sized(ids), F.col("_fp") == F.col("fp"), "left").select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, most_bits: int = 2) -> DataFrame:
    """docs with one document of each group: that of the smallest doc_id. Columns stay as they are.

    Rows without doc_id stay. Rows that share a doc_id are one document and stay or go together. An empty table stays empty.
    """
    groups = near_duplicates(docs, most_bits)
    return without(docs, materialize(groups.where("component_id != doc_id").select("doc_id").distinct(), "gone"))
