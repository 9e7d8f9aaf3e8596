import random
import io
import zlib

import numpy as np
import pytest
import zstandard

from tests.llm import cases
from tidebook.llm.queries import tokenizer_path
from tidebook.llm import token_files
from tidebook.llm.token_files import FRAME_IDS, Encoder, FileReader, FileWriter, open_fs, read_token_files, token_digests, write_token_files

SPACES = ["a \n\nb", "a  b   c\n\n d", " lead", "trail  ", "<|endoftext|> x<|endoftext|>y", "!\x1c! x", "a\xa0 b\xa0\n\nc", "a\t\tb\r\n c", "it's we'll  'tis", "日本 語　x", "a\x85b \x0b c"]


def plain(text):
    return Encoder.of(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_pieces_as_whole_texts():
    texts = [t or "" for t in cases.texts()] + SPACES
    found = Encoder(tokenizer_path()).encode(texts)
    assert [f.tolist() + [2] for f in found] == [plain(t) for t in texts]


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr("tidebook.llm.token_files.REMEMBERED", 6)
    encoder = Encoder(tokenizer_path())
    for texts in (["a b c d e"], ["f g a", "h h"], ["a f h z"]):
        assert [f.tolist() + [2] for f in encoder.encode(texts)] == [plain(t) for t in texts]
    assert len(encoder.memory[0]) <= 6


def test_hashes_that_collide_change_nothing(monkeypatch):
    monkeypatch.setattr("tidebook.llm.token_files.piece_hash", lambda head, tail, length: length.astype(np.uint64) % np.uint64(2))
    encoder = Encoder(tokenizer_path())
    for texts in (["one two three"], ["one one", "two"], ["six"], ["ten six"]):
        assert [f.tolist() + [2] for f in encoder.encode(texts)] == [plain(t) for t in texts]


def test_words_of_equal_polynomial_hash_are_told_apart():
    """Thue-Morse strings, with the same 8 bytes at their ends, which any polynomial modulo a power of two takes for equal."""
    a, b = ("start123" + "".join(x if bin(i).count("1") % 2 else y for i in range(4096)) + "stop1234" for x, y in ("ab", "ba"))
    encoder = Encoder(tokenizer_path())
    for texts in ([f"x {a} y {b}"], [b, a], [f" {b}"]):
        assert [f.tolist() + [2] for f in encoder.encode(texts)] == [plain(t) for t in texts]


def test_parts_of_long_texts_change_nothing(monkeypatch):
    texts = [cases.LONG[:9_000], "a" * 3_000 + " b\n\n c  d" * 50, "", "日本 x " * 300, "x\u3000y " * 200, " \n " * 700 + "end"]
    monkeypatch.setattr("tidebook.llm.token_files.PART", 500)
    monkeypatch.setattr("tidebook.llm.token_files.REMEMBERED_BYTES", 100)
    assert [f.tolist() + [2] for f in Encoder(tokenizer_path()).encode(texts)] == [plain(t) for t in texts]


def written(docs, width="<u2"):
    class Out(io.BytesIO):
        def close(self):
            pass

    out = Out()
    writer = FileWriter(out, np.dtype(width))
    for i, ids in docs:
        writer.add(i, np.array(ids, np.uint32))
    writer.close()
    return out


def test_readers_decompress_only_what_is_asked_for():
    docs = [(None, [7]), *((i, [i] * 300) for i in range(1000)), (1000, list(range(60_000)) * 4), (1000, []), (1001, [5, 2])]
    out = written(docs)
    reader = FileReader(out, len(out.getvalue()))
    assert reader.find(500)[0].tolist() == [500] * 300
    assert reader.frames_read == 1
    assert [len(x) for x in reader.find(1000)] == [240_000, 0]
    assert reader.frames_read == 1 + -(-240_000 // FRAME_IDS)
    assert reader.find(77_777) == []
    every = [ids.tolist() for _, ids in reader.every()]
    assert every == [list(ids) for _, ids in docs]
    raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert np.frombuffer(raw, "<u2").tolist() == [x for _, ids in docs for x in ids]  # a plain reader passes over the tables


def test_a_changed_byte_is_found():
    out = written([(i, [i % 7] * 50_000) for i in range(4)], "<u4")
    data = bytearray(out.getvalue())
    table = FileReader(io.BytesIO(bytes(data)), len(data))
    table.checks = table.checks + 1
    with pytest.raises(ValueError, match="checksum"):
        table.document(0)
    with pytest.raises(ValueError, match="seek table"):
        FileReader(io.BytesIO(bytes(data[:-1])), len(data) - 1)


def test_round_trip(spark, tmp_path):
    docs = cases.documents(spark)
    folder = str(tmp_path / "out")
    manifest = write_token_files(docs, folder, tokenizer_path(), file_ids=1_000)
    assert manifest.count() > 4
    back = sorted(read_token_files(spark, manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted(r.doc_id for r in docs.collect())
    text = {r.doc_id: r.text for r in docs.collect()}
    at = 0
    for r in back:
        assert (r.start, r.n_tokens, r.ids) == (at, len(r.ids), plain(text[r.doc_id]))
        at += r.n_tokens
    fs, top = open_fs("file://" + folder)
    assert fs.get_file_info(f"{top}/{manifest.first().name}").size > 0


def test_digests_of_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    at, wanted = 0, []
    for r in sorted(docs.collect()):
        ids = plain(r.text)
        wanted.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = token_digests(docs, tokenizer_path())
    assert sorted(map(tuple, found.collect())) == wanted


def test_null_ids_and_empty_tables(spark):
    assert token_digests(cases.empty(spark), tokenizer_path()).count() == 0
    docs = spark.createDataFrame([(None, None), (None, "a b"), (3, "c")], "doc_id long, text string")
    rows = token_digests(docs, tokenizer_path()).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 3]
    assert sorted(r.n_tokens for r in rows) == [1, 2, 3]


def test_a_text_of_several_parts_through_spark(spark):
    long = " ".join(f"word{i % 5003}" for i in range(500_000))
    found = sorted(token_digests(spark.createDataFrame([(2, long), (1, "a b")], "doc_id long, text string"), tokenizer_path()).collect())
    ids = [np.array(plain(t), "<u4") for t in ("a b", long)]
    assert [tuple(r) for r in found] == [(1, 0, len(ids[0]), zlib.crc32(ids[0].tobytes())), (2, len(ids[0]), len(ids[1]), zlib.crc32(ids[1].tobytes()))]


def test_paths_of_clusters(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    was = conf.get("fs.defaultFS", "file:///")
    try:
        conf.set("fs.defaultFS", "hdfs://nn:8020/")
        assert token_files.qualified(spark, "/shared/x") == "hdfs://nn:8020/shared/x"
        assert token_files.qualified(spark, "s3a://b/x") == "s3a://b/x"
        conf.set("fs.defaultFS", "file:///")
        assert token_files.qualified(spark, "/shared/x") == "/shared/x"
    finally:
        conf.set("fs.defaultFS", was)
    assert [token_files.located(p) for p in ("s3a://b/x", "s3n://b/x", "s3://b/x", "abfss://c@a/x", "dbfs:/mnt/x", "hdfs://nn/x", "/x", "file:///x")] == ["s3://b/x", "s3://b/x", "s3://b/x", "abfs://c@a/x", "/dbfs/mnt/x", "hdfs://nn/x", "/x", "file:///x"]
    fs, top = token_files.open_fs("dbfs:/mnt/x")
    assert (fs.type_name, top) == ("local", "/dbfs/mnt/x")


def test_long_texts_with_other_spaces_are_cut(monkeypatch):
    encoder = Encoder.of(tokenizer_path())
    rng = random.Random(8)
    text = "".join(rng.choice(["word", "Other", "x1", "\u00a0", " ", " ", "  ", "\n", "\u3000 ", "é", ".", "\u00a0 "]) for _ in range(4000))
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    sizes = []
    plain = Encoder._whole
    monkeypatch.setattr(token_files, "PART", 500)
    monkeypatch.setattr(Encoder, "_whole", lambda self, texts: sizes.extend(map(len, texts)) or plain(self, texts))
    assert encoder.encode([text])[0].tolist() == whole
    assert len(sizes) > 10
