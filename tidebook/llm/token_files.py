"""Token-ID output: files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is a sequence of frames, each of some documents' IDs as little-endian unsigned integers; a document of more than FRAME_IDS
IDs has frames of its own. Then come two skippable frames, which plain zstandard readers pass over: the documents' ids and lengths,
and, last, the seek table of the public seekable zstandard format (sizes of every frame and the low 32 bits of its content's XXH64). A reader
takes the end of the file, and then only the frames of the documents asked for.

Documents are sorted by a range shuffle, so every task writes the files of one range of ids, and file names in order hold documents in order.
A file gets a new name with each attempt to write it, and counts only if the manifest, written last, has it: a task that runs again does no harm.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import materialize, scratch_path, slices
from tidebook.llm.rolling import mixed

END_ID = 2
#: IDs in a frame of several documents; IDs after which a file is closed.
FRAME_IDS, FILE_IDS = 1 << 16, 1 << 25
LEVEL = 3
#: Pieces of text that a worker remembers (some 70 bytes each); later ones are encoded each time that a slice of text has them.
REMEMBERED = 1_500_000
#: Bytes of a piece that is known by two numbers; bytes of longer pieces that a worker remembers; characters of a text encoded at once.
SHORT, REMEMBERED_BYTES, PART = 16, 8 << 20, 2 << 20

# Fixed values of the public seekable format, and a skippable frame's number for the documents.
SEEK_FRAME, SEEK_END, DOCUMENTS_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CHECKSUMS = 0x80


def piece_hash(head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mixed(mixed(head + length.astype(np.uint64)) ^ tail)


class Encoder:
    """IDs of whole texts by the tokenizers library.

    Byte-level pre-tokenization always cuts before ASCII white space that follows another character, so the pieces between such places have
    the same IDs in any text. Each distinct piece is encoded once and remembered; new ones are encoded many at a time, joined into one
    text, whose IDs are dealt to the pieces by the bytes that each ID stands for. A piece is known by all its bytes: one of up to 16 by its length, its first and its last 8 bytes,
    a longer one as a string. A long text is cut between pieces. Texts with other white space are encoded in one go.
    """

    SPACE, JOINED = b" \t\n\r\f\v", 1024
    IS_SPACE = np.isin(np.arange(256), list(SPACE))
    BETWEEN = re.compile(r"[^ \t\n\r\f\v](?=[ \t\n\r\f\v])")
    OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
    #: A boundary of pieces whatever spaces the text has elsewhere.
    BETWEEN_WORDS = re.compile(r"[A-Za-z](?= [A-Za-z])")
    known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])  # a byte-level token has one character for each byte
        #: Of the remembered pieces of up to 16 bytes, by hash: hash, first and last bytes, length, place and number of IDs.
        self.memory = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        self.ids = np.zeros(0, np.uint32)
        #: IDs of the remembered pieces of over 16 bytes, and the bytes of these.
        self.long: dict[bytes, np.ndarray] = {}
        self.n_long = 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """IDs of all pieces one after the other, and how many each has."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if p[0] in self.SPACE and p[-1] not in self.SPACE]
        alone = [i for i, p in enumerate(pieces) if p[0] not in self.SPACE or p[-1] in self.SPACE]
        for k in range(0, len(joined), self.JOINED):
            part = joined[k : k + self.JOINED]
            ids = self._whole([b"".join(pieces[i] for i in part).decode()])[0]
            stops = np.cumsum([len(pieces[i]) for i in part])
            ends = np.cumsum(self.bytes_of[ids])
            places = np.searchsorted(ends, stops)  # the last ID of each piece
            if len(ends) and ends[-1] == stops[-1] and (ends[places] == stops).all():
                for i, ids_of_piece in zip(part, np.split(ids, places[:-1] + 1), strict=True):
                    out[i] = ids_of_piece
            else:
                alone += part
        for k in range(0, len(alone), self.JOINED):
            part = alone[k : k + self.JOINED]
            for i, ids in zip(part, self._whole([pieces[i].decode() for i in part]), strict=True):
                out[i] = ids
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array([len(x) for x in out], np.int64)

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        sizes = np.array([len(t) for t in raw], np.int64)
        data = np.frombuffer(b"".join([*raw, bytes(8)]), np.uint8)
        n = len(data) - 8
        if not n:
            return [np.zeros(0, np.uint32) for _ in texts]
        space = self.IS_SPACE[data[:n]]
        cut = space & ~np.append(False, space[:-1])
        begin = (np.cumsum(sizes) - sizes)[sizes > 0]
        cut[begin] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], n)
        length = stop - start
        place, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        short, long = np.flatnonzero(length <= SHORT), np.flatnonzero(length > SHORT)
        pieces = [data[a:b].tobytes() for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True)]
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(p, len(number)) for p in pieces], np.int64)
        found = self._short(data, start[short], stop[short])
        if found is None:
            return self._whole(texts)
        place[short], count[short], every = found
        ids = self._long(list(number))
        sizes_long = np.array([len(x) for x in ids], np.int64)
        place[long], count[long] = (len(every) + np.cumsum(sizes_long) - sizes_long)[which], sizes_long[which]
        every = np.concatenate([every, *ids])
        stops = np.cumsum(count)
        flat = every[np.repeat(place - stops + count, count) + np.arange(stops[-1])]
        pieces_before = np.searchsorted(start, np.cumsum(sizes))  # pieces up to the end of each text
        return np.split(flat, np.append(0, stops)[pieces_before][:-1])

    def _long(self, pieces: list[bytes]) -> list[np.ndarray]:
        missing = [p for p in pieces if p not in self.long]
        ids, n_ids = self._pieces(missing)
        new = dict(zip(missing, np.split(ids, np.cumsum(n_ids)[:-1]), strict=True)) if missing else {}
        out = [new[p] if p in new else self.long[p] for p in pieces]
        if self.n_long <= REMEMBERED_BYTES:
            self.long |= {p: x.copy() for p, x in new.items()}
            self.n_long += sum(map(len, new))
        return out

    def _short(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Place and number of the IDs of each piece, and all IDs; None if two pieces have the same hash."""
        if not len(start):
            return start, start, self.ids
        length = stop - start
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the 8 bytes from each place on
        head = eight[start] & (np.uint64((1 << 64) - 1) >> (np.uint64(64) - np.uint64(8) * np.minimum(length, 8).astype(np.uint64)))
        tail = np.where(length > 8, eight[np.maximum(stop - 8, 0)], np.uint64(0))
        hashes = piece_hash(head, tail, length)
        order = np.argsort(hashes)
        new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        one = order[new]  # a piece of each kind
        if any((x != x[one][kind]).any() for x in (head, tail, length)):
            return None
        mine = [x[one] for x in (hashes, head, tail, length)]
        at = np.minimum(np.searchsorted(self.memory[0], mine[0]), max(0, len(self.memory[0]) - 1))
        hit = np.ones(len(one), bool) if len(self.memory[0]) else np.zeros(len(one), bool)
        if len(self.memory[0]):
            for x, y in zip(mine, self.memory, strict=False):
                hit &= x == y[at]
        missing = np.flatnonzero(~hit)
        ids, n_ids = self._pieces([data[start[i] : stop[i]].tobytes() for i in one[missing].tolist()])
        place, count = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        place[hit], count[hit] = self.memory[4][at[hit]], self.memory[5][at[hit]]
        place[missing], count[missing] = len(self.ids) + np.cumsum(n_ids) - n_ids, n_ids
        every = np.concatenate([self.ids, ids])
        if len(self.memory[0]) + len(missing) <= REMEMBERED:
            self.ids = every
            self.memory = [np.concatenate([a, b[missing]]) for a, b in zip(self.memory, [*mine, place, count], strict=True)]
            by_hash = np.argsort(self.memory[0], kind="stable")
            self.memory = [x[by_hash] for x in self.memory]
        return place[kind], count[kind], every

    def _cut(self, text: str, between: re.Pattern[str] = BETWEEN) -> Iterator[str]:
        """A text in parts of about PART characters, cut between pieces."""
        at = 0
        while len(text) - at > PART and (cut := between.search(text, at + PART)):
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts, owners, held = [], [], 0
        for i, text in enumerate(texts):
            if self.OTHER_SPACE.search(text):
                for part in self._cut(text, self.BETWEEN_WORDS):
                    out[i] += self._whole([part])
                continue
            for part in self._cut(text):
                if held and held + len(part) > PART:
                    for k, ids in zip(owners, self._by_pieces(parts), strict=True):
                        out[k].append(ids)
                    parts, owners, held = [], [], 0
                parts.append(part)
                owners.append(i)
                held += len(part)
        for k, ids in zip(owners, self._by_pieces(parts), strict=True):
            out[k].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


#: Schemes of Hadoop's file systems, and what pyarrow calls the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
_SCHEME = re.compile(r"([a-z][a-z0-9+.-]*):")


def located(path: str) -> str:
    """A path or URI of Hadoop's as pyarrow takes it. dbfs:/ is a mount of every machine."""
    scheme = _SCHEME.match(path)
    if not scheme:
        return path
    if scheme[1] == "dbfs":
        return "/dbfs/" + path[scheme.end() :].lstrip("/")
    return SCHEMES.get(scheme[1], scheme[1]) + path[scheme.end() - 1 :]


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, or of a URI of any scheme that pyarrow or SCHEMES knows, and the path in it."""
    path = located(path)
    return pafs.FileSystem.from_uri(path) if _SCHEME.match(path) else (pafs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark takes it: one without a scheme is on the default file system, as the cluster's files or the session set it."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path if _SCHEME.match(path) or default.startswith("file:") else default.rstrip("/") + "/" + path.lstrip("/")


class FileWriter:
    """Appends documents to one file; close() returns documents and IDs written."""

    def __init__(self, out, dtype: np.dtype):
        self.out, self.dtype, self.packer = out, dtype, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n_held + len(ids) > FRAME_IDS:
            self._frame()
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        if self.n_held > FRAME_IDS:
            self._frame()

    def _frame(self) -> None:
        if not self.n_held:
            return
        data = np.concatenate(self.held).astype(self.dtype)
        for i in range(0, len(data), FRAME_IDS):
            raw = data[i : i + FRAME_IDS].tobytes()
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> tuple[int, int]:
        self._frame()
        null = np.array([i is None for i in self.ids], bool)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        body = self.packer.compress(struct.pack("<QB", len(ids), self.dtype.itemsize) + np.packbits(null).tobytes() + ids.tobytes() + np.array(self.sizes, "<i8").tobytes())
        self.out.write(struct.pack("<II", DOCUMENTS_FRAME, len(body)) + body)
        self.frames.append((8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.out.close()
        return len(self.ids), self.n_ids


class FileReader:
    """Documents of one file. It reads the end of the file, and then the frames asked for."""

    def __init__(self, file: BinaryIO | pa.NativeFile, size: int):
        self.file = file
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_END or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - 9 - 12 * n, 12 * n)
        packed, raw, self.checks = np.frombuffer(table, "<u4").reshape(-1, 3).T.astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(packed)])
        body = zstandard.decompress(self._at(self.begin[n - 1] + 8, packed[n - 1] - 8))
        count, width = struct.unpack_from("<QB", body)
        self.dtype = np.dtype(f"<u{width}")
        at = 9 + -(-count // 8)
        self.null = np.unpackbits(np.frombuffer(body[9:at], np.uint8), count=count).astype(bool)
        self.ids, self.sizes = np.frombuffer(body[at:], "<i8").reshape(2, -1)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.edges = np.concatenate([[0], np.cumsum(raw[:-1] // width)])
        self.frames_read = 0

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(size))

    def frame(self, i: int) -> np.ndarray:
        raw = zstandard.decompress(self._at(self.begin[i], self.begin[i + 1] - self.begin[i]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[i]:
            raise ValueError(f"frame {i} has a wrong checksum")
        self.frames_read += 1
        return np.frombuffer(raw, self.dtype)

    def document(self, k: int) -> np.ndarray:
        """IDs of the document at place k of the file."""
        start, stop = self.starts[k], self.starts[k] + self.sizes[k]
        first, last = np.searchsorted(self.edges, start, "right") - 1, np.searchsorted(self.edges, stop, "left")
        data = [self.frame(i) for i in range(first, last)]
        return np.concatenate(data)[start - self.edges[first] : stop - self.edges[first]] if data else np.zeros(0, self.dtype)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """IDs of each document of this id; the ids are sorted in the file, nulls first."""
        nulls = int(self.null.sum())
        a, b = (nulls + np.searchsorted(self.ids[nulls:], doc_id, side) for side in ("left", "right"))
        return [self.document(k) for k in range(a, b)]

    def every(self) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order, each frame read once."""
        held, at, i = np.zeros(0, self.dtype), 0, 0
        for k, size in enumerate(self.sizes.tolist()):
            parts = [held[at : at + size]]
            missing = size - len(parts[0])
            at += len(parts[0])
            while missing:
                held, i = self.frame(i), i + 1
                at = min(missing, len(held))
                parts.append(held[:at])
                missing -= at
            yield k, np.concatenate(parts)


MANIFEST = "part int, seq int, name string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes doc_id and text of every row to files in folder, in ascending order of doc_id, and returns the manifest, one row for each file.

    A null text is empty: its document has the end id alone. Rows that repeat a doc_id are documents of their own, next to each other; null ids come first.
    The IDs are stored in 2 bytes where all fit, else in 4.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, fs_path = Encoder.of(tokenizer_path), TaskContext.get().partitionId(), open_fs(folder)
        fs, top = fs_path
        wide = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) > 1 << 16
        dtype, end = np.dtype("<u4" if wide else "<u2"), np.array([end_id], np.uint32)
        writer, name, done = None, "", []
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text").fill_null("").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                if writer is None:
                    name = f"{part:06d}-{len(done):05d}-{uuid.uuid4().hex}.zst"
                    writer = FileWriter(fs.open_output_stream(f"{top}/{name}", compression=None), dtype)
                writer.add(doc_id, np.concatenate([ids, end]))
                if writer.n_ids >= file_ids:
                    done.append((part, len(done), name, *writer.close()))
                    writer = None
        if writer is not None:
            done.append((part, len(done), name, *writer.close()))
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        columns = zip(*done, strict=True) if done else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    folder = qualified(docs.sparkSession, folder)
    fs, top = open_fs(folder)
    fs.create_dir(top, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).orderBy("doc_id", F.xxhash64("text"))
    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


DOCUMENT = "doc_id long, start long, n_tokens long, ids array<long>"


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (IDs of all documents before it), n_tokens, and the IDs, or only their ids_crc32: of every document of the files.

    A file is read by one task, frame by frame. Starts come from a running sum over the manifest: one row for each file.
    """
    folder = qualified(spark, folder)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("begin", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))).select("name", "begin")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        for batch in batches:
            for name, begin in zip(batch.column("name").to_pylist(), batch.column("begin").to_pylist(), strict=True):
                path = f"{top}/{name}"
                with fs.open_input_file(path) as file:
                    reader, rows, held = FileReader(file, file.size()), [], 0
                    for k, ids in reader.every():
                        last = zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.tolist()
                        rows.append((None if reader.null[k] else int(reader.ids[k]), begin + int(reader.starts[k]), len(ids), last))
                        held += 1 if digest else len(ids)
                        if held >= 1 << 17:
                            yield _rows(rows, digest)
                            rows, held = [], 0
                    yield _rows(rows, digest)

    return files.repartition(partitions, "name").mapInArrow(run, DOCUMENT.replace("ids array<long>", "ids_crc32 long") if digest else DOCUMENT)


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int64()))
    columns = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written to the shared folder and read back. An empty table has no files and gives no rows."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    return read_token_files(spark, write_token_files(docs, folder, tokenizer_path), folder, digest=True)
