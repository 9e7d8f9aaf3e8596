"""Near-copies by the Jaccard similarity of word shingles, for the corpus pipeline.

A lightly edited copy can be ten bits and more of a SimHash fingerprint away, and the grid of simhash.py grows too fast for
that radius. So candidates come from MinHash bands of the distinct five-word shingles as well (Broder, 1997): texts that agree in a band meet
in its bucket, each with two hubs of the bucket, so that pairs grow in proportion to the documents. Every candidate's similarity is then
computed from its whole sets of shingles. Pairs within two bits (the links of op3) stay links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import as_bytes, materialize, sized, slices, without
from tidebook.llm.graph import connected_components
from tidebook.llm.rolling import Roller, mixed
from tidebook.llm.simhash import fingerprint_links, with_fingerprints

#: Words of a shingle; least similarity of a near-copy; bands and their rows: a pair of similarity 0.8 shares none of them in 2 of 10,000 cases.
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 16, 4
#: Shingles whose minima are taken at once.
BLOCK = 1 << 12

_U = np.uint64
_XOR, _FACTOR = (mixed(np.arange(i, i + BANDS * ROWS, dtype=np.uint64) * _U(0xA0761D6478BD642F)) for i in (1, 1 + BANDS * ROWS))
_FACTOR |= _U(1)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xE7037ED1A0B428DB)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles. Fewer words are one shingle; no words, none."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    wide = min(WORDS, len(words))
    return np.unique(Roller(np.frombuffer(b" ".join(words), np.uint8)).of((stop - size)[: len(words) - wide + 1], stop[wide - 1 :]))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _key(found: np.ndarray) -> int:
    """A hash of a whole set."""
    return int(mixed(np.array([mixed(found).sum(dtype=np.uint64) + _U(len(found))]))[0].astype(np.int64))


def _bands(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~_U(0))
    for i in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[i : i + BLOCK, None] ^ _XOR) * _FACTOR).min(axis=0))
    out = _BAND.copy()
    for row in least.reshape(BANDS, ROWS).T:
        out = mixed(out ^ row) * _U(0xD6E8FEB86659FD93)
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        ids, keys, bands = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text"), strict=True):
            if len(found := shingles(text)):
                ids.append(doc_id)
                keys.append(_key(found))
                bands.append(_bands(found))
        flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [shingles(t) for t in as_bytes(batch, "text")]
        yield pa.RecordBatch.from_arrays([pa.array([_key(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names=["key", "found"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = ((np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)) for c in ("found_a", "found_b"))
        near = pa.array([similarity(a, b) >= LEAST for a, b in zip(x, y, strict=True)], pa.bool_())
        yield batch.select(["id_a", "id_b"]).rename_columns(["a", "b"]).filter(near)


def copy_links(docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of doc_ids: of texts with the same shingles, and of similar ones. docs: doc_id (long, no nulls), text."""
    signed = materialize(docs.mapInArrow(_signed, "doc_id long, key long, bands array<long>"), "signatures")
    classes = materialize(signed.groupBy("key").agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands")), "sets")
    named = classes.select(F.col("key").alias("_key"), "id")
    same = signed.join(named, F.col("key") == F.col("_key")).where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    banded = classes.select("key", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least != most").withColumnRenamed("band", "_band")
    met = banded.join(hubs, F.col("band") == F.col("_band")).select("key", F.explode(F.array("least", "most")).alias("hub")).where("key != hub")
    pairs = materialize(met.select(F.least("key", "hub").alias("key_a"), F.greatest("key", "hub").alias("key_b")).distinct(), "candidates")
    wanted = pairs.select(F.col("key_a").alias("_w")).union(pairs.select("key_b")).distinct()
    ids = materialize(named.join(wanted, F.col("_key") == F.col("_w")).select("_key", F.col("id").alias("_id")), "candidate-ids")
    texts = docs.join(sized(ids.select("_id").distinct()), F.col("doc_id") == F.col("_id"), "left_semi").select("text")
    sets = materialize(texts.mapInArrow(_sets, "key long, found binary").dropDuplicates(["key"]).join(ids, F.col("key") == F.col("_key")).select("key", "_id", "found"), "candidate-sets")
    side = lambda x: sets.select(F.col("key").alias(f"_{x}"), F.col("_id").alias(f"id_{x}"), F.col("found").alias(f"found_{x}"))
    both = pairs.join(side("a"), F.col("key_a") == F.col("_a")).join(side("b"), F.col("key_b") == F.col("_b")).select("id_a", "id_b", "found_a", "found_b")
    return same.union(both.mapInArrow(_close, "a long, b long"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each group that links lead to: fingerprints within two bits, and
    shingles of similarity LEAST or more. Columns stay as they are.

    Rows without doc_id stay. Rows that share a doc_id are one document and stay or go together. An empty table stays empty.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    prints = materialize(with_fingerprints(plain), "fingerprints")
    classes = materialize(prints.groupBy("_fp").agg(F.min("doc_id").alias("id")).withColumnRenamed("_fp", "fp"), "classes")
    same = prints.join(classes, F.col("_fp") == F.col("fp")).where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    groups = connected_components(same.union(fingerprint_links(classes)).union(copy_links(plain)))
    return without(docs, materialize(groups.where("component != node").select("node"), "gone"))
