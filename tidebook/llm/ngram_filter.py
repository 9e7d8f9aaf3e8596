"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counts of words and of word pairs are quantised on a log scale, and an n-gram of level q is put into a Bloom filter q times,
as (n-gram, 1) to (n-gram, q). A count is read back by probing level after level until one is missing; so it is never
too small, and too large with a chance that halves with each bit of a probe. Probabilities are those of a Dirichlet-smoothed
bigram model over the counts read back.

Counting: each task combines the n-grams of a slice of text, and deals them by hash to parts; a part counts its n-grams and
builds its own segment of the filter. A block is some neighbouring parts, of bounded size, and each block is a broadcast of its own.
One pass scores the texts: a worker takes some text, and goes through the blocks in turn, one at a time in memory, for
the levels of the n-grams that each is in charge of. So the text is read once, whatever the size of the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import as_bytes, in_turn, materialize, slices
from tidebook.llm.rolling import mixed

#: Base of the log scale; bits probed for each level; bits of the filter for each (n-gram, level).
BASE, PROBES, BITS = 1.5, 8, 11.6
#: Strength of the unigram prior of a pair's probability, in counts.
PRIOR = 200.0
#: N-grams that a part counts, on average; bytes of a block.
PART_ENTRIES, BLOCK_BYTES = 500_000, 24 << 20
#: Bytes of text whose n-grams a task combines or looks up at once; a longer text goes in pieces.
HELD, PIECE = 4 << 20, 1 << 20

_U = np.uint64
BEGIN, END = _U(0x0B5E55ED0B5E55ED), _U(0xE4DE4DE4DE4DE4D1)
_SPACES = frozenset(b" \t\n\x0b\x0c\r")


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        cut = next((i for i in range(at + PIECE, len(text)) if text[i] in _SPACES), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def _word_hashes(piece: bytes) -> np.ndarray:
    """XXH64 of each word; bytes are lower-cased and split as ASCII."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, piece.lower().split())), np.uint64)


def sequences(texts: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token hashes of some neighbouring texts, of about `most` bytes: owners and starts of segments, and the tokens.

    A segment is the token before, BEGIN for a text's first, and then a text's tokens, or those of a piece of it; the last one ends with END.
    """
    owner, parts, held = [], [], 0
    for i, text in enumerate(texts):
        before, at = BEGIN, 0
        for piece in _pieces(text):
            at += len(piece)
            words = _word_hashes(piece)
            part = np.concatenate([[before], words, [END]] if at == len(text) else [[before], words])
            if len(part) == 1:
                continue
            before = part[-1]
            owner.append(i)
            parts.append(part)
            held += len(piece) + 8
            if held >= most:
                yield _joined(owner, parts)
                owner, parts, held = [], [], 0
    if parts:
        yield _joined(owner, parts)


def _joined(owner: list[int], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.array(owner, np.int64), np.cumsum(sizes) - sizes, np.concatenate(parts)


def scored_places(starts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Places of all tokens but the first of each segment."""
    inner = np.ones(len(tokens), bool)
    inner[starts] = False
    return np.flatnonzero(inner)


def pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(before * _U(0xD6E8FEB86659FD93) + token)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are equal ranges of the hashes, in order."""
    return (((h >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE**level - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _seeds(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of the probes of (n-gram, level)."""
    a = mixed(h + _U(level * 0xA0761D6478BD642F % (1 << 64)))
    return a, mixed(a ^ _U(0xE7037ED1A0B428DB)) | _U(1)


def _probe(start: np.ndarray, stride: np.ndarray, k: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """The k-th probe's bit; bits (below 2^32): those of the segment."""
    return (((start + _U(k) * stride) >> _U(32)) * bits >> _U(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Byte by byte of all values: sorted hashes and small counts then compress well in the shuffle."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


WORD, PAIR = 0, 1


def _counter(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", HELD):
            for _, starts, token in sequences(as_bytes(batch, "text"), HELD):
                at = scored_places(starts, token)
                rows = []
                for kind, h in ((WORD, token[at]), (PAIR, pairs(token[at - 1], token[at]))):
                    value, n = np.unique(h, return_counts=True)
                    part = part_of(value, parts)
                    edges = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(part)]
                    rows += [(int(part[a]), kind, _planes(value[a:b]), _planes(n[a:b].astype(np.uint32))) for a, b in pairwise(edges)]
                kinds = (pa.int32(), pa.int8(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "kind", "hashes", "counts"])

    return run


def _summed(rows: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    mine = [(_unplaned(h, np.uint64), _unplaned(c, np.uint32)) for k, h, c in zip(*(rows.column(c).to_pylist() for c in ("kind", "hashes", "counts")), strict=True) if k == kind]
    if not mine:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, c = (np.concatenate(x) for x in zip(*mine, strict=True))
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[new], np.add.reduceat(c[order].astype(np.int64), new)


def _segment(entries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, bytes]:
    """The filter of some (hashes, levels): its bits and their number."""
    total = int(sum(level.sum() for _, level in entries))
    bits = max(64, 64 * -(-int(total * BITS) // 64))
    flags = np.zeros(bits, bool)
    for h, level in entries:
        for q in range(1, int(level.max(initial=0)) + 1):
            start, stride = _seeds(h[level >= q], q)
            for k in range(PROBES):
                flags[_probe(start, stride, k, _U(bits))] = True
    return bits, np.packbits(flags).tobytes()


PART_TYPE = "part int, words long, tokens long, hashes binary, counts binary, bits long, filter binary"


def _build(rows: pa.Table) -> pa.Table:
    h, c = _summed(rows, WORD)
    pair, n = _summed(rows, PAIR)
    bits, data = _segment([(h, level_of(c)), (pair, level_of(n))])
    row = (rows.column("part")[0].as_py(), len(h), int(c.sum()), h.tobytes(), c.tobytes(), bits, data)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
    return pa.table({f.split()[0]: pa.array([x], k) for f, x, k in zip(PART_TYPE.split(", "), row, kinds, strict=True)})


class Block:
    """Neighbouring parts: exact word counts and the filter's segments, as bytes, which cost one copy to send."""

    def __init__(self, rows: list[dict], parts: int, first: int, stop: int):
        have = {r["part"]: r for r in rows}
        at = [have.get(p) for p in range(first, stop)]
        self.parts, self.first, self.stop = parts, first, stop
        self.bits = np.array([r["bits"] if r else 64 for r in at], np.uint64)
        self.data = tuple(b"".join(r[c] if r else none for r in at) for c, none in (("hashes", b""), ("counts", b""), ("filter", bytes(8))))

    def own(self, h: np.ndarray) -> slice:
        """Of sorted hashes those of the block's parts."""
        return slice(*np.searchsorted(part_of(h, self.parts), (self.first, self.stop)))

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Training counts of sorted word hashes."""
        hashes, counts = np.frombuffer(self.data[0], np.uint64), np.frombuffer(self.data[1], np.int64)
        if not len(hashes):
            return np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[i] == h, counts[i], 0)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels by repeated probes: the last before the first that is missing."""
        flags = np.frombuffer(self.data[2], np.uint8)
        out = np.zeros(len(h), np.uint8)
        part = part_of(h, self.parts) - self.first
        bits, begin, left, q = self.bits[part], (np.cumsum(self.bits) - self.bits).astype(np.int64)[part], np.arange(len(h)), 1
        while len(left):
            start, stride = _seeds(h[left], q)
            for k in range(PROBES):
                at = begin[left] + _probe(start, stride, k, bits[left])
                found = np.flatnonzero(flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                left, start, stride = left[found], start[found], stride[found]
            out[left] = q
            q += 1
        return out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the place of each hash among them."""
    order = np.argsort(h)
    new = np.append(True, h[order[1:]] != h[order[:-1]])[: len(h)]
    where = np.empty(len(h), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    return h[order[new]], where


def _scorer(shared: list, total: int, words: int, documents: int):
    """Base score, known tokens, tokens and the model's log10 probability of each text."""
    counts_of = count_of(np.arange(256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", HELD):
            n = batch.num_rows
            base, score, known, n_tokens = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for owner, starts, token in sequences(as_bytes(batch, "text"), HELD):
                at = scored_places(starts, token)
                word, where = _distinct(token)
                pair, where_pair = _distinct(pairs(token[at - 1], token[at]))
                begin = token[at - 1] == BEGIN
                del token
                exact, level, level_pair = np.zeros(len(word), np.int64), np.zeros(len(word), np.uint8), np.zeros(len(pair), np.uint8)
                for block in in_turn(shared):
                    own, own_pair = block.own(word), block.own(pair)
                    exact[own], level[own], level_pair[own_pair] = block.exact(word[own]), block.levels(word[own]), block.levels(pair[own_pair])
                here = where[at]
                prior = PRIOR * (counts_of[level][here] + 1) / (total + words + 1)
                before = np.where(begin, float(documents), counts_of[level][where[at - 1]])
                likely = np.log10((np.minimum(counts_of[level_pair][where_pair], before) + prior) / (before + PRIOR))
                first = starts - np.arange(len(starts))
                np.add.at(score, owner, np.add.reduceat(likely, first))
                np.add.at(base, owner, np.add.reduceat(np.log10((exact + 1) / (total + words + 1))[here], first))
                np.add.at(known, owner, np.add.reduceat((exact > 0)[here].astype(np.int64), first))
                np.add.at(n_tokens, owner, np.diff(np.append(first, len(at))))
            columns = [pa.array(x) for x in (base, known, n_tokens, score)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "base", "known", "n_tokens", "score"])

    return run


def train(docs: DataFrame) -> tuple[DataFrame, int, int, int, int]:
    """The filter's parts, written to the shared folder, and their number; tokens, distinct words and documents of the training texts."""
    spark = docs.sparkSession
    size, documents = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // (3 * PART_ENTRIES))
    dealt = docs.select("text").mapInArrow(_counter(parts), "part int, kind byte, hashes binary, counts binary")
    built = materialize(dealt.groupBy("part").applyInArrow(_build, PART_TYPE), "filter")
    total, words = built.agg(F.sum("tokens"), F.sum("words")).first()
    return built, parts, total or 0, words or 0, documents


def blocks(built: DataFrame, parts: int, block_bytes: int) -> list[tuple[int, int]]:
    """Ranges of parts, each of about block_bytes (one part at least): n-grams are dealt by hash, so parts are of like size."""
    size = built.agg(F.sum(F.length("hashes") + F.length("counts") + F.length("filter"))).first()[0] or 0
    each = max(1, int(block_bytes * parts // max(1, size)))
    return [(a, min(a + each, parts)) for a in range(0, parts, each)]


def lm_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Training takes the rows whose crc32(doc_id as text) modulo 7 is not 2; a row without doc_id is one of them. A null text
    has one token, the end. Repeated rows count each time. Other columns are ignored. With no training rows all counts are 0.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    built, parts, total, words, documents = train(rows.where(~held))
    shared = []
    for a, b in blocks(built, parts, block_bytes):  # a block at a time is at the driver
        found = built.where(F.col("part").between(a, b - 1)).select("part", "hashes", "counts", "bits", "filter").toArrow().to_pylist()
        shared.append(spark.sparkContext.broadcast(Block(found, parts, a, b)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(shared, total, words, documents), f"doc_id {kind}, base double, known long, n_tokens long, score double")
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
