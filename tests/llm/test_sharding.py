import zlib
from collections import Counter

from tests.llm import cases
from tidebook.llm.sharding import assign_shards, shard_documents, write_shards


def jump(key: int, n: int) -> int:
    """One key at a time, as published."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_as_one_key_at_a_time(spark):
    docs = cases.documents(spark)
    rows = shard_documents(docs).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 8), jump(r.doc_id, 9))
        assert r.grown_shard in (r.shard, 8)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_null_ids_and_empty_tables(spark):
    assert shard_documents(cases.empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")
    assert [(r.shard, r.size) for r in shard_documents(docs).orderBy("size").collect()] == [(jump(0, 8), 1), (jump(0, 8), 2)]


def test_string_keys_and_files(spark, tmp_path):
    df = spark.range(500).selectExpr("cast(id as string) as key", "id")
    four, five = (assign_shards(df, ["key"], n) for n in (4, 5))
    moved = four.alias("a").join(five.alias("b"), "id").where("a.shard != b.shard").select("b.shard")
    assert {r[0] for r in moved.collect()} == {4}
    assert 50 < moved.count() < 160
    write_shards(four, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.shard for r in back.collect()) == Counter(r.shard for r in four.collect())
