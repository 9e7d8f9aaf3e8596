from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import cases
from tidebook.llm.simhash import drop_near_duplicates, fingerprint, fingerprint_links, near_duplicates


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (doc_id, fingerprint)."""
    group = {}
    for i, f in prints:
        group[f] = min(i, group.get(f, i))
    links = [(a, b) for a, b in combinations(group, 2) if (a ^ b).bit_count() <= 2]
    while True:
        before = dict(group)
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            return group


def test_as_brute_force(spark, sf_dir):
    for docs in (cases.documents(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        prints = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        group = brute_components(prints)
        wanted = sorted((i, f"{f:016x}", group[f]) for i, f in prints)
        assert cases.rows_of(near_duplicates(docs)) == sorted(wanted, key=repr)


def test_links_of_planted_fingerprints(spark):
    rng = __import__("random").Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {*base, 0, (1 << 64) - 1}
    for f in base:
        for bits in (1, 2, 3):
            prints.add(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    prints = sorted(prints)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)]
    for most in (0, 1, 2):
        found = fingerprint_links(spark.createDataFrame(signed, "id long, fp long"), most).collect()
        wanted = {(a, b) for (a, x), (b, y) in combinations(enumerate(prints), 2) if (x ^ y).bit_count() <= most}
        assert len(found) == len(wanted)
        assert {tuple(sorted(r)) for r in found} == wanted
    with pytest.raises(ValueError, match="differing bits"):
        fingerprint_links(spark.createDataFrame(signed, "id long, fp long"), 3)


def test_cells_are_not_broadcast(spark):
    links = fingerprint_links(spark.range(200).select("id", F.xxhash64("id").alias("fp")))  # far below Spark's size for a broadcast
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan


def test_one_of_each_group_stays(spark):
    docs = cases.documents(spark)
    kept = drop_near_duplicates(docs)
    groups = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(groups.values())


def test_nulls_and_empty(spark):
    assert near_duplicates(cases.empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "z"), (9, None)], "doc_id long, text string")
    assert sorted(r.component_id or 0 for r in near_duplicates(docs).collect()) == [0, 5, 5, 9]
    assert drop_near_duplicates(docs).count() == 4
    assert fingerprint(b"") == 0


def test_a_row_without_id_links_others(spark, monkeypatch):
    from tidebook.llm import simhash as S

    rows = spark.createDataFrame([(1, 0b0), (None, 0b11), (2, 0b1111), (None, 1 << 40 | 0xF00), (7, -1)], "doc_id long, _fp long")
    monkeypatch.setattr(S, "with_fingerprints", lambda docs: rows)
    found = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in near_duplicates(rows).collect()}
    assert found == {(1, 0): 1, (None, 0b11): 1, (2, 0b1111): 1, (None, 1 << 40 | 0xF00): None, (7, (1 << 64) - 1): 7}


def test_clashing_columns_stay(spark):
    names = ["doc_id", "text", "_gone", "gone", "fp", "_fp", "node", "id"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in ((3, "a b c d"), (5, "a b c d"), (6, "other words here"))], ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    out = drop_near_duplicates(docs)
    assert out.columns == names
    assert sorted(r.doc_id for r in out.collect()) == [3, 6]
