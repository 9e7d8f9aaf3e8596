"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams, against which every text is scanned.

Texts and items are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. A window is 10
consecutive words of an item, or a whole shorter item. The words of the benchmark get numbers, and a window's key is its numbers;
so a key found is the very same words, and a stretch of text with a word that no item has is skipped without a probe.

The set of one block of items is bounded by BLOCK_WORDS; a larger benchmark is dealt into more blocks, each a broadcast of its own. A worker goes
through the blocks in turn for each slice of text, with one of them in memory, so the texts are read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import as_bytes, in_turn, replacing, slices

WINDOW = 10
#: Words of the benchmark in one broadcast block: some 200 MB of keys.
BLOCK_WORDS = 1_000_000

_WORD = rb"0123456789abcdefghijklmnopqrstuvwxyz"
#: Byte for byte: A-Z to a-z, other ASCII that is not part of a word to a space; so places in the text stay.
_NORMAL = bytes(b if b >= 0x80 or b in _WORD else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class WindowSet:
    """The windows of some items, by their length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list[str]]] = {}
        for item, text in items:
            numbers = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.int32)
            size = min(window, len(numbers))
            for key in {numbers[i : i + size].tobytes() for i in range(len(numbers) - size + 1) if size}:
                self.windows.setdefault(size, {}).setdefault(key, []).append(item)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of hit words, in order, and the items found."""
        numbers = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))
        unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
        marks, items = np.zeros(len(words) + 1, np.int32), set()
        for size, keys in self.windows.items():
            for i in np.flatnonzero(unknown[size:] == unknown[:-size]).tolist() if size <= len(words) else ():
                if found := keys.get(numbers[i : i + size].tobytes()):
                    items.update(found)
                    marks[i] += 1
                    marks[i + size] -= 1
        if not items:
            return [], items
        edge = np.diff(np.concatenate([[0], np.cumsum(marks[:-1]) > 0, [0]]).astype(np.int8))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)), items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "n_words long, hit_spans array<struct<start: int, stop: int>>, hit_items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (of words, merged, in order) and hit_items (item ids as strings); no shuffle.

    A null or empty text has no words, a null or wordless item no window; an empty benchmark hits nothing. Items
    that repeat count once for each item_id; an item without item_id counts under the id "". Columns of docs with these names are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))  # some six bytes a word
    shared = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        shared.append(spark.sparkContext.broadcast(WindowSet([(r.item, bytes(r.text)) for r in rows], window)))
    plain = replacing(docs, "n_words", "hit_spans", "hit_items")
    out = T.StructType([*plain.schema.fields, *T._parse_datatype_string(FOUND).fields])
    return plain.mapInArrow(_scanner(shared, plain.columns), out)


def _scanner(shared: list, plain: list[str]):
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = as_bytes(batch, "text")
            counts, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for windows in in_turn(shared):
                for i, text in enumerate(texts):
                    words = words_of(text)
                    hit, ids = windows.hits(words)
                    counts[i] = len(words)
                    spans[i] += hit
                    items[i] |= ids
            found = ([{"start": a, "stop": b} for a, b in _merged(x)] for x in spans)
            new = [pa.array(x, k) for x, k in zip((counts, list(found), list(map(sorted, items))), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *new], names=[*plain, "n_words", "hit_spans", "hit_items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document: a digest of scan(). Rows that repeat each have theirs."""
    ids = F.array_join("hit_items", ",")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + (x["stop"] - x["start"]))
    return scan(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that have a hit word; all columns stay as they are, whatever their names.

    Null and empty texts stay, as they have no words; repeated rows stay or go together; an empty table stays empty.
    """
    names = [f"_c{i}" if c != "text" else c for i, c in enumerate(docs.columns)]
    clean = scan(docs.toDF(*names), benchmark).where(F.size("hit_spans") == 0)
    return clean.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def _without_spans(text: bytes, spans: list[dict]) -> str:
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_NORMAL))]
    kept, at = [], 0
    for x in spans:
        kept.append(text[at : places[x["start"]][0]])
        at = places[x["stop"] - 1][1]
    return b"".join([*kept, text[at:]]).decode()


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = zip(as_bytes(batch, "text"), batch.column("hit_spans").to_pylist(), strict=True)
        cut = pa.array([_without_spans(t, s) if s else None for t, s in rows], pa.string())
        whole = pc.coalesce(cut, batch.column("text").cast(pa.string()))
        yield batch.set_column(batch.schema.get_field_index("text"), "text", whole).drop_columns(["n_words", "hit_items"])


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the hit spans cut out of the text, and removed_spans, their number. Each span goes from the first character of its first
    word to the last of its last word; what stood between words outside the spans stays as it is. A null text stays null. A column removed_spans is replaced."""
    plain = replacing(docs, "removed_spans")
    names = [f"_c{i}" if c != "text" else c for i, c in enumerate(plain.columns)]
    rows = plain.toDF(*names).withColumn("text", F.col("text").cast("string"))
    found = scan(rows, benchmark)
    cut = found.mapInArrow(_shortened, T.StructType([*rows.schema.fields, found.schema["hit_spans"]]))
    return cut.select(*names, F.size("hit_spans").cast("long").alias("removed_spans")).toDF(*plain.columns, "removed_spans")


def oracle_sql(window: int = WINDOW) -> str:
    """contamination() in DuckDB's SQL: windows of each length by a moving string aggregate, then equality joins."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    moving = lambda key, n: f"string_agg(word, ' ') OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    sizes = range(1, window + 1)
    item_windows = " UNION ALL ".join(f"SELECT item, {n} AS n, pos, total, {moving('item', n)} AS key FROM item_words WHERE least(total, {window}) = {n}" for n in sizes)
    doc_windows = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, pos, total, {moving('doc_id', n)} AS key FROM doc_words WHERE {n} IN (SELECT n FROM windows)" for n in sizes)
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
doc_words AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d), item_words AS (SELECT item, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM i),
windows AS MATERIALIZED (SELECT DISTINCT item, n, key FROM ({item_windows}) WHERE pos + n - 1 <= total), hits AS MATERIALIZED (SELECT doc_id, x.n, pos, item FROM ({doc_windows}) x JOIN windows v ON v.n = x.n AND v.key = x.key WHERE pos + x.n - 1 <= total),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY 1), found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""
