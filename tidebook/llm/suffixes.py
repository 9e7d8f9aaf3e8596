"""Suffix-array deduplication: removes the bytes of every 100-byte string that also starts earlier.

A suffix matters by its first 100 bytes alone, its window. The suffixes are sorted one bucket at a time, and the buckets are dealt
over the cluster:

1. A window's bucket is the least hash among its 32-byte substrings, so equal windows share a bucket wherever they
   stand. Neighbouring windows mostly share a bucket too: such a run, a context, is one row of some 30 bytes. A slice of text
   sorts the buckets that it has several contexts of by itself, and hands on only windows that it doesn't repeat.
2. A bucket left with one context has nothing to compare: most of a corpus ends here.
3. The suffixes of the other contexts are sorted, some buckets in a task. A bucket too wide for one task is
   split by its suffixes' bytes: its windows go through one range sort over the cluster.

A sort goes by the leading 32 bytes, whose ranks come from doubling. Suffixes that tie on those are told apart by the precomputed ranks of
a difference-cover sample (Burkhardt and Kärkkäinen, 2003; Kärkkäinen, 2007): for any two suffixes there is a step below the
cover's period that takes both to sampled places, and the ranks there stand for the next 69 bytes. Suffix buckets, by leading bytes, are sorted one at a time, so memory is bounded
by a bucket, and a tie costs one look at two ranks.

Hashes choose buckets and nothing else: only windows equal byte by byte count as repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import as_bytes, materialize, sized, slices
from tidebook.llm.rolling import Roller, mixed
from tidebook.llm.sharding import number_slots

WINDOW, PART = 100, 32
#: Bytes of text hashed at once; a longer text goes in overlapping pieces.
PIECE = 2 << 20
#: Contexts of one bucket that are sorted in one task; a wider bucket is split by a range sort of its windows.
WIDE = 10_000
#: Contexts for each task of the sort; windows of a suffix bucket.
SORTED, BUCKET = 10_000, 1 << 18
#: Bytes of spans that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
NO_ID = (1 << 63) - 1

_U = np.uint64


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo period is one of two of them: by depth-first search, smallest first."""
    size = next(k for k in range(2, period + 1) if k * (k - 1) + 1 >= period)

    def grow(cover: list[int], most: int) -> list[int] | None:
        if len({(a - b) % period for a in cover for b in cover}) == period:
            return cover
        if len(cover) == most:
            return None
        return next((x for n in range(cover[-1] + 1, period) if (x := grow([*cover, n], most))), None)

    return next(c for most in range(size, period + 1) if (c := grow([0, 1], most)))


PERIOD = 31
COVER = difference_cover(PERIOD)
#: STEP[a, b]: the least step that takes places of residues a and b both into the cover.
_IN = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
STEP = np.array([[next(d for d in range(PERIOD) if _IN[a + d] and _IN[b + d]) for b in range(PERIOD)] for a in range(PERIOD)])
#: Bytes by which sampled places are ranked: from any step they stay within the window.
RANKED = WINDOW - PERIOD


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbours."""
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (size - span)], values[size - span :])


def _periodic(parts: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which contexts [start, ends) may hold two equal windows.

    Two equal windows d apart make 69 neighbouring substrings equal to those d further on. If d is under 69, one at a multiple of
    64 shows it; a context of 69 windows or fewer has no greater d.
    """
    span = WINDOW - PART + 1
    rows = np.concatenate([parts, np.zeros(-len(parts) % 64 + 64, np.uint64)]).reshape(-1, 64)
    near = np.hstack([rows[:-1], rows[1:, : span - 63]])
    hits = np.flatnonzero((near[:, :1] == near[:, 1:]).any(axis=1)) * 64
    if not len(hits):
        return ends - start > span
    return (ends - start > span) | (np.searchsorted(hits, start - span) < np.searchsorted(hits, ends + span, side="right"))


def _contexts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For the pieces of some documents, joined: the piece, place, number of windows and bucket of each context, and whether it may repeat windows of its own."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    parts = Roller(buffer).every(PART)
    bucket = _least(parts, WINDOW - PART + 1)
    piece = np.repeat(np.arange(len(texts)), sizes)[: len(bucket)]
    fits = np.arange(len(bucket)) + WINDOW <= (begin + sizes)[piece]
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (piece[1:] != piece[:-1]) | ~fits[:-1]
    start = np.flatnonzero(new & fits)
    # a run ends before the next start, or where windows no longer fit
    ends = np.flatnonzero(fits & np.append(new[1:] | ~fits[1:], True)) + 1
    return piece[start], start, ends - start, bucket[start], _periodic(parts, start, ends)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Lists of pieces, their places and rows; each list of about PIECE bytes. Pieces of one text overlap by a window less one byte."""
    texts, firsts, rows, held = [], [], [], 0
    for row, text in enumerate(as_bytes(batch, "text")):
        for at in range(0, max(1, len(text) - WINDOW + 1), PIECE):
            part = text[at : at + PIECE + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            if texts and held + len(part) > PIECE:
                yield texts, firsts, rows
                texts, firsts, rows, held = [], [], [], 0
            texts.append(part)
            firsts.append(at)
            rows.append(row)
            held += len(part)
    if texts:
        yield texts, firsts, rows


FIELDS = {"kind": pa.int8(), "bucket": pa.int64(), "key": pa.int64(), "version": pa.int64(), "pos": pa.int32(), "n": pa.int32()}
FOUND = "kind byte, bucket long, key long, version long, pos int, n int"
#: A run of windows that are repeats; a context to be sorted with its bucket; one of a bucket that is split.
REPEAT, NARROW, SPLIT = 0, 1, 2


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(FIELDS[n]) for n, c in zip(names, columns, strict=True)], names=names)


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    """Which rows are equal to the row before in all columns."""
    same = np.ones(len(columns[0]), bool)
    same[:1] = False
    for c in columns:
        same[1:] &= c[1:] == c[:-1]
    return same


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after the other."""
    stop = np.cumsum(size)
    return np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)


def _find_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of each slice of the documents, and the windows that the slice itself repeats, as runs."""
    for batch in slices(batches, "text", 2 * PIECE):
        keys = batch.column("key").to_numpy().astype(np.int64)
        versions = batch.column("version").to_numpy().astype(np.int64)
        for texts, firsts, rows in _pieces(batch):
            piece, start, n, bucket, periodic = _contexts(texts)
            row, sizes = np.array(rows), np.array([len(t) for t in texts], np.int64)
            shift = np.array(firsts, np.int64) - np.cumsum(sizes) + sizes  # from the buffer to the document
            key, version = keys[row], versions[row]
            order = np.lexsort((start + shift[piece], version[piece], key[piece], bucket))
            order = order[~_same_as_before(bucket[order], key[piece[order]], version[piece[order]], (start + shift[piece])[order])]  # rows alike in doc_id and text are one document
            b = bucket[order]
            alone = np.append(True, b[1:] != b[:-1]) & np.append(b[1:] != b[:-1], True)
            some = order[~alone | periodic[order]]
            buffer = np.frombuffer(b"".join(texts), np.uint8)
            repeat = np.zeros(len(buffer), bool)
            if len(some):
                repeat[_repeats_of(buffer, some, start, n, key[piece], version[piece], start + shift[piece])] = True
                own = np.repeat(np.arange(len(texts)), sizes)
                a, z = _runs(repeat, own)
                at = own[a]
                spread = mixed((key[at] * 31 + a).astype(np.uint64))  # for the shuffle alone
                yield _batch([*FIELDS], np.full(len(a), REPEAT, np.int8), spread, key[at], version[at], a + shift[at], z - a)
                # what is left of the contexts
                places = _ranges(start[order], n[order])
                a, z = _runs(~repeat[places], np.repeat(np.arange(len(order)), n[order]))
                which = np.searchsorted(np.cumsum(n[order]), a, "right")
                first, count, order = places[a], z - a, order[which]
            else:
                first, count = start[order], n[order]
            at = piece[order]
            yield _batch([*FIELDS], np.full(len(order), NARROW, np.int8), bucket[order], key[at], version[at], first + shift[at], count)


def _repeats_of(buffer: np.ndarray, some: np.ndarray, start: np.ndarray, n: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Places in the buffer of the windows of some contexts that repeat an earlier one of them. place: what orders contexts, the first first."""
    some = some[np.lexsort([p[some] for p in place[::-1]])]
    at = _ranges(start[some], n[some])
    needed = np.zeros(len(buffer) + 1, np.int32)
    np.add.at(needed, start[some], 1)
    np.add.at(needed, start[some] + n[some] + WINDOW - 1, -1)
    needed = np.cumsum(needed[:-1]) > 0
    shorter = np.cumsum(needed) - 1
    return at[repeated_windows(buffer[needed], shorter[at])]


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by bucket and place: those of buckets with several, as SPLIT where a bucket has over WIDE; and the repeats as they are.

    At most WIDE rows of the last bucket are held, so a bucket may be of any size.
    """
    held: pa.RecordBatch | None = None
    split = None  # the bucket that goes on after it was found to be wide
    last = None
    for batch in batches:
        told = pc.equal(batch.column("kind"), REPEAT)
        if (repeats := batch.filter(told)).num_rows:
            yield repeats
        batch = batch.filter(pc.invert(told))
        rows = [batch.column(c).to_numpy() for c in ("bucket", "key", "version", "pos", "n")]
        twice = _same_as_before(*rows)
        if len(twice):
            twice[0] = last == [r[0] for r in rows]
            last = [r[-1] for r in rows]
        batch = batch.filter(pa.array(~twice))
        if held is not None:
            batch = pa.concat_batches([held, batch])
            held = None
        if not batch.num_rows:
            continue
        b = batch.column("bucket").to_numpy()
        run = np.cumsum(np.append(False, b[1:] != b[:-1]))
        size = np.bincount(run)
        wide = size > WIDE
        if split == b[0]:
            wide[0] = True
        begin = len(b) - size[-1]
        if wide[-1]:
            split, begin = b[-1], len(b)
        else:
            held, split = batch.slice(begin), None
        wanted = (size[run] > 1) | wide[run]
        wanted[begin:] = False
        out = batch.set_column(0, "kind", pa.array(np.where(wide[run], SPLIT, NARROW).astype(np.int8))).filter(pa.array(wanted))
        if out.num_rows:
            yield out
    if held is not None and held.num_rows > 1:
        yield held


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks that keep the order of values, equal ones alike."""
    order = np.argsort(values)
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.cumsum(np.append(False, values[order[1:]] != values[order[:-1]])[: len(values)])
    return ranks


def _ranked(text: np.ndarray) -> np.ndarray:
    """The rank of each place by its 32 bytes: those of 8 bytes, and twice the ranks of pairs of ranks. The last 31 places are left out."""
    n = len(text) - 7
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = (words << _U(8)) | text[k : k + n]
    ranks = _dense(words)
    for size in (8, 16):
        ranks = _dense(ranks[:-size] << 32 | ranks[size:])
    return ranks.astype(np.int32)


def repeated_windows(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the windows at places of text are equal to the window of an earlier entry of `at`."""
    leading = _ranked(np.concatenate([text, np.zeros(2 * WINDOW, np.uint8)]))
    # ranks of the cover's places by 69 bytes; of a place that isn't sampled, none
    sample = np.flatnonzero(_IN[np.arange(len(text)) % PERIOD])
    wide = lambda p: leading[p].astype(np.int64)
    ranks = np.full(len(text) + PERIOD, -1, np.int32)
    ranks[sample] = _dense(_dense(wide(sample) << 32 | wide(sample + 32)) << 32 | wide(sample + RANKED - 32))
    repeat = np.zeros(len(at), bool)
    order = np.argsort(leading[at], kind="stable")
    first = leading[at[order]]
    edges = np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
    begin = 0
    while begin < len(order):  # suffix buckets, by their leading bytes: each of about BUCKET windows, or of one leading string
        stop = max(edges[np.searchsorted(edges, begin + BUCKET, "right") - 1], edges[np.searchsorted(edges, begin, "right")])
        repeat[_repeats_in(at, order[begin:stop], leading, ranks)] = True
        begin = stop
    return repeat


def _repeats_in(at: np.ndarray, order: np.ndarray, leading: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Of the entries of a suffix bucket, sorted by leading bytes, those whose window an earlier one has.

    Ties are split into classes of equal windows: each entry is held against the first of its tie, by the cover's ranks; those that differ go on as a tie of their own.
    """
    out = []
    cls = np.cumsum(np.append(False, leading[at[order[1:]]] != leading[at[order[:-1]]]))
    for _ in range(12):
        tied = np.bincount(cls)[cls] > 1
        order, cls = order[tied], cls[tied]
        if not len(order):
            return np.concatenate([*out, order])
        new = np.append(True, cls[1:] != cls[:-1])
        i, j, cls = order[~new], order[np.flatnonzero(new)[np.cumsum(new) - 1]][~new], cls[~new]
        p, q = at[i], at[j]
        step = STEP[p % PERIOD, q % PERIOD]
        same = (ranks[p + step] == ranks[q + step]) & (leading[p + WINDOW - 32] == leading[q + WINDOW - 32])
        out.append(i[same])
        order, cls = i[~same], cls[~same]
    # many classes in one tie: what is left is sorted by the ranks of all its bytes
    order = np.sort(order)
    keys = [leading[at[order] + k] for k in (WINDOW - 32, 64, 32, 0)]
    by = np.lexsort(keys)
    return np.concatenate([*out, order[by[_same_as_before(*(k[by] for k in keys))]]])


def _runs(mask: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true entries that stay in one group."""
    edge = np.append(True, group[1:] != group[:-1])
    start = np.flatnonzero(mask & (edge | ~np.append(False, mask[:-1])))
    stop = np.flatnonzero(mask & (np.append(edge[1:], True) | ~np.append(mask[1:], False))) + 1
    return start, stop


SPANS = ["key", "version", "pos", "n"]
SPANS_TYPE = "key long, version long, pos int, n int"


def _equal_contexts(order: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the given order without those of equal bytes as an earlier one, and these: contexts are sorted as strings first, so that the windows of equal ones are sorted once."""
    by = np.array(sorted(order.tolist(), key=data.__getitem__), np.int64)  # stable: of equal ones the first in order stays
    again = np.zeros(len(data), bool)
    again[by[1:]] = [data[a] == data[b] for a, b in pairwise(by.tolist())]
    return order[~again[order]], np.flatnonzero(again)


def _sort_buckets(rows: pa.Table) -> pa.Table:
    """Repeats among the windows of some buckets, whole buckets together, as spans of window starts."""
    columns = [rows.column(c).to_numpy() for c in SPANS]
    order = np.lexsort(columns[::-1])
    order = order[~_same_as_before(*(c[order] for c in columns))]  # rows alike in doc_id and text are one document
    data = rows.column("data").to_pylist()
    order, again = _equal_contexts(order, data)
    told = _batch(SPANS, *(c[again] for c in columns))
    key, version, pos, n = (c[order].astype(np.int64) for c in columns)
    parts = [data[k] for k in order]
    sizes = np.array([len(p) for p in parts], np.int64)
    at = _ranges(np.cumsum(sizes) - sizes, n)
    owner = np.repeat(np.arange(len(order)), n)
    own_pos = _ranges(pos, n)
    if (_same_as_before(key, version) & (pos < np.append(0, (pos + n)[:-1]))).any():  # rows alike may have been cut otherwise by other slices: each place once
        by = np.lexsort((own_pos, version[owner], key[owner]))
        by = by[~_same_as_before(key[owner[by]], version[owner[by]], own_pos[by])]
        at, owner, own_pos = at[by], owner[by], own_pos[by]
    start, stop = _runs(repeated_windows(np.frombuffer(b"".join(parts), np.uint8), at), owner)
    return pa.Table.from_batches([told, _batch(SPANS, key[owner[start]], version[owner[start]], own_pos[start], stop - start)])


def _identified(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """docs with key and version, which together tell a document, and order documents. A null doc_id has the key NO_ID and comes after all others.

    The version is 0 where no other row has the key. Else the different texts of a key are numbered, those of a null doc_id last, by their checksum and digest (SHA-256): rows alike in doc_id
    and text are one document. Such rows are few in a corpus with ids, and then the numbers are broadcast.
    """
    number = F.col(doc_id).cast("long")
    rows = docs.withColumn("key", F.coalesce(number, F.lit(NO_ID)))
    repeated = materialize(rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("_repeated")), "repeated")
    if repeated.isEmpty():
        return rows.withColumn("version", F.lit(0).cast("long"))
    same = F.col("key") == F.col("_repeated")
    data = text.cast("binary")
    told = {"_missing": number.isNull(), "_sum": F.crc32(data), "_digest": F.sha2(data, 256)}
    some = rows.join(sized(repeated), same).drop("_repeated").withColumns(told)
    numbers = number_slots(some.select("key", *told, F.lit(0).alias("_one")).distinct(), "_one", ["key", *told], "_number")
    numbers = numbers.select(F.col("key").alias("_k"), F.col("_missing").alias("_m"), F.col("_digest").alias("_d"), (F.col("_number") + 1).alias("version"))
    numbered_ = some.join(sized(numbers), (F.col("key") == F.col("_k")) & (F.col("_missing") == F.col("_m")) & (F.col("_digest") == F.col("_d")))
    single = rows.join(sized(repeated), same, "left_anti").withColumn("version", F.lit(0).cast("long"))
    return single.unionByName(numbered_.select(*single.columns))


def _by_document(spans: DataFrame, *columns: str) -> DataFrame:
    """One row for each document, with its spans as arrays of equal length. A document's spans are bounded by its bytes."""
    lists = F.sort_array(F.collect_list(F.struct(*columns)))
    return spans.groupBy("key", "version").agg(lists.alias("_spans")).select("key", "version", *(F.col(f"_spans.{c}").alias(c) for c in columns))


def _with_text(docs: DataFrame, spans: DataFrame, size: int, how: str) -> DataFrame:
    """docs (with key, version) joined with their spans, of about `size` bytes: broadcast if those are few, else by a shuffle."""
    small = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    return docs.join(small.withColumnsRenamed({"key": "_key", "version": "_of"}), (F.col("key") == F.col("_key")) & (F.col("version") == F.col("_of")), how)


def _asked(texts: DataFrame, contexts: DataFrame, total: int) -> DataFrame:
    """Documents with the contexts asked for."""
    return _with_text(texts, _by_document(contexts, "pos", "n", "bucket"), 150 * total, "inner").select("key", "version", "text", "pos", "n", "bucket")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each context asked for."""
    names = {"bucket": pa.int64(), "key": pa.int64(), "version": pa.int64(), "pos": pa.int32(), "n": pa.int32(), "data": pa.binary()}
    for batch in slices(batches, "text", PIECE):
        lists = (batch.column(c).to_pylist() for c in ("key", "version", "pos", "n", "bucket"))
        rows = [(b, key, version, pos, n, text[pos : pos + n + WINDOW - 1]) for text, key, version, *asked in zip(as_bytes(batch, "text"), *lists, strict=True) for pos, n, b in zip(*asked, strict=True)]
        for k in range(0, len(rows), SORTED):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + SORTED], strict=True), names.values(), strict=True)], names=[*names])


PLACED = {"window": pa.binary(), "key": pa.int64(), "version": pa.int64(), "pos": pa.int32()}


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of the contexts asked for."""
    for batch in slices(batches, "text", PIECE):
        rows: list[tuple] = []
        lists = (batch.column(c).to_pylist() for c in ("key", "version", "pos", "n"))
        for text, key, version, *asked in zip(as_bytes(batch, "text"), *lists, strict=True):
            for pos, n in zip(*asked, strict=True):
                rows += [(text[at : at + WINDOW], key, version, at) for at in range(pos, pos + n)]
                if len(rows) >= SORTED:
                    yield _placed(rows)
                    rows = []
        yield _placed(rows)


def _placed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 4, PLACED.values(), strict=True)], names=[*PLACED])


MARKED = "task int, edge binary, key long, version long, pos int, n int, final boolean"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted windows: the repeats (without edge), the first row of the task with its window, and the last window alone."""
    task, last = TaskContext.get().partitionId(), None

    def out(windows: list, rows: pa.RecordBatch, final: bool) -> pa.RecordBatch:
        columns = [pa.array([task] * len(windows), pa.int32()), pa.array(windows, pa.binary()), *(rows.column(c) for c in ("key", "version", "pos")), pa.array([1] * len(windows), pa.int32()), pa.array([final] * len(windows), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in MARKED.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None:
            yield out([batch.column("window")[0].as_py()], batch.slice(0, 1), False)
            both = batch
        else:
            both = pa.concat_batches([last, batch])
        equal = [pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in both.columns]
        repeats = both.slice(1).filter(pa.array(equal[0] & ~(equal[1] & equal[2] & equal[3])))  # rows alike in doc_id and text are one document
        if repeats.num_rows:
            yield out([None] * repeats.num_rows, repeats, False)
        last = batch.slice(batch.num_rows - 1)
    if last is not None:
        yield out([last.column("window")[0].as_py()], last, True)


def _split_repeats(windows: DataFrame) -> DataFrame:
    """Repeats among single windows, by one range sort: copies of a window come one after the other, in order of place, in any number of tasks.

    A task knows all repeats but its first row's, which is held against the last window of the task before: two rows for each task.
    """
    marked = materialize(windows.orderBy("window", "key", "version", "pos").mapInArrow(_mark, MARKED), "sorted-windows")
    place = F.struct("key", "version", "pos")
    before = F.lag(F.struct("edge", place.alias("place"))).over(Window.orderBy("task", "final"))
    first = marked.where("edge is not null").withColumn("_before", before).where(~F.col("final") & (F.col("edge") == F.col("_before.edge")) & (place != F.col("_before.place")))
    return marked.where("edge is null").select(*SPANS).union(first.select(*SPANS))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of window starts as maximal spans of bytes."""
    for batch in batches:
        starts, stops = [], []
        for pos, n in zip(batch.column("pos").to_pylist(), batch.column("n").to_pylist(), strict=True):
            a, b = np.array(pos, np.int64), np.array(pos, np.int64) + np.array(n, np.int64) + WINDOW - 1
            reach = np.maximum.accumulate(b)
            new = np.append(True, a[1:] > reach[:-1])
            starts.append(a[new].tolist())
            stops.append(reach[np.append(new[1:], True)].tolist())
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (starts, stops)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("version"), *lists], names=["key", "version", "start", "stop"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """key, version, start, stop: for each document with repeats, its maximal spans [start, stop) of bytes to remove, as two arrays. texts: key, version, text."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(_find_contexts, FOUND).repartition("bucket").sortWithinPartitions("bucket", "key", "version", "pos", "n")
    found = materialize(dealt.mapInArrow(_sorted_buckets, FOUND), "contexts")
    counts = dict(found.groupBy("kind").count().collect())
    spans = [found.where(F.col("kind") == REPEAT).select(*SPANS)]
    if total := counts.get(NARROW, 0):
        cut = _asked(texts, found.where(F.col("kind") == NARROW), total).mapInArrow(_cut, "bucket long, key long, version long, pos int, n int, data binary")
        tasks = max(4 * partitions, -(-total // SORTED))
        spans.append(cut.groupBy(F.pmod(F.xxhash64("bucket"), F.lit(tasks))).applyInArrow(_sort_buckets, SPANS_TYPE))
    if total := counts.get(SPLIT, 0):
        windows = _asked(texts, found.where(F.col("kind") == SPLIT), total).mapInArrow(_cut_windows, "window binary, key long, version long, pos int")
        spans.append(_split_repeats(materialize(windows, "windows")))
    every = spans[0]
    for x in spans[1:]:
        every = every.union(x)
    return _by_document(every, "pos", "n").mapInArrow(_merge, "key long, version long, start array<int>, stop array<int>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for text, starts, stops in zip(as_bytes(batch, "text"), batch.column("start").to_pylist(), batch.column("stop").to_pylist(), strict=True):
            kept = kept_bytes(text, starts or [], stops or [])
            rows.append((len(text), len(text) - len(kept), len(starts or []), hashlib.sha256(kept).hexdigest()))
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def kept_bytes(text: bytes, starts: list[int], stops: list[int]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True)) if starts else text


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    spans = materialize(spans, "spans")
    size = spans.agg(F.sum(120 + 8 * F.size("start"))).first()[0] or 0
    return _with_text(docs, spans, size, "left")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs.

    A null text is empty; rows alike in doc_id and text are one document and get the same digest; rows alike in doc_id only are
    ordered by their checksum; a null doc_id comes last. Texts under 100 bytes have no window. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = _identified(rows, "doc_id", F.col("text"))
    joined = _joined(texts, repeated_spans(texts.select("key", "version", "text"))).select("doc_id", "text", "start", "stop")
    return joined.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = zip(as_bytes(batch, "text"), batch.column("start").to_pylist(), batch.column("stop").to_pylist(), strict=True)
        texts = [kept_bytes(t, a, b).decode(errors="replace") if a else None for t, a, b in rows]
        whole = pc.coalesce(pa.array(texts, pa.string()), batch.column("text").cast(pa.string()))
        yield batch.set_column(batch.schema.get_field_index("text"), "text", whole).drop_columns(["start", "stop"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut out of the text; a text stays null if it is null. A character that loses some
    of its bytes to a span becomes U+FFFD. All other columns stay as they are, whatever their names, and so do rows. An empty table stays empty."""
    names = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names).withColumn("text", F.col("text").cast("string"))
    whole = F.coalesce(F.col("text"), F.lit(""))
    told = _identified(plain, names[docs.columns.index("doc_id")], whole)
    joined = _joined(told, repeated_spans(told.select("key", "version", whole.alias("text")))).select(*names, "start", "stop")
    return joined.mapInArrow(_shortened, plain.schema).toDF(*docs.columns)
