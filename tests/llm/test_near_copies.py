import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_simhash import brute_fingerprint
from tidebook.llm import near_copies as N


def brute_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_edited_copies_go(spark):
    """Copies with 1 % of the words replaced, of 5-word similarity 0.8 or more: all are found, as by comparing every pair."""
    rng = random.Random(5)
    docs = []
    for i in range(300):
        words = [f"w{rng.randint(0, 20_000)}" for _ in range(rng.randint(50, 600))]
        copy = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 100)):
            copy[at] = f"new{i}"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    sets = [brute_shingles(t) for _, t in docs]
    wanted = {(a, b) for a, b in combinations(range(len(docs)), 2) if jaccard(sets[a], sets[b]) >= 0.8}
    assert len(wanted) > 250
    prints = [brute_fingerprint(t) for _, t in docs]
    far = {(a, b) for a, b in wanted if (prints[a] ^ prints[b]).bit_count() > 2}
    assert len(far) > 150
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(sorted(r)) for r in N.copy_links(df).collect()} == wanted
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert not kept & {b for _, b in wanted}
    assert {a for a, _ in wanted} <= kept


def test_similarity_is_that_of_sets():
    a, b = "a b c d e f g h", "A b  c d e f g x"
    assert N.similarity(N.shingles(a.encode()), N.shingles(b.encode())) == jaccard(brute_shingles(a), brute_shingles(b)) == 3 / 5
    assert len(N.shingles(b" \n")) == 0 and len(N.shingles(b"a b")) == 1
    assert np.array_equal(N._bands(N.shingles(a.encode())), N._bands(N.shingles(a.upper().encode())))


def test_nulls_and_empty(spark):
    assert N.drop_near_copies(cases.empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "z"), (9, None), (9, "")], "doc_id long, text string")
    assert N.drop_near_copies(docs).count() == 5
    assert N.drop_near_copies(cases.documents(spark)).columns == cases.documents(spark).columns


def brute_kept(docs):
    """The smallest ids of the groups that links by fingerprint or by similarity lead to, over every pair of (doc_id, text)."""
    rows = [(i, brute_fingerprint(t), brute_shingles(t or "")) for i, t in docs]
    links = [(a, b) for (a, x, s), (b, y, t) in combinations(rows, 2) if (x ^ y).bit_count() <= 2 or 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and jaccard(s, t) >= 0.8]
    group, before = {r[0]: r[0] for r in rows}, None
    while group != before:
        before = dict(group)
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return sorted(set(group.values()))


def test_stage_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = brute_kept([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == wanted
