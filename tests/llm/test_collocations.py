import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from tests.oracle import difference
from tidebook.llm import collocations as C
from tidebook.llm.queries import op11_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most: int = 3, least: int = 10, top: int = 2000) -> list[tuple]:
    """Phrase by phrase; rows: (text, lang)."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, most + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    best = {}
    for (lang, p), a in f.items():
        if len(p) >= 2 and a >= least:
            best[lang, p] = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
    gone = set()
    for lang, p in best:
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * f[lang, p] >= 50 * f[lang, p[i : i + m]]:
                    gone.add((lang, p[i : i + m]))
    out = []
    for lang in total:
        kept = sorted(((-s, -f[x], " ".join(x[1]).encode(), l, r) for x, (s, _, l, r) in best.items() if x[0] == lang and x not in gone))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(kept[:top], 1)]
    return sorted(out)


def found(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


def test_as_sql(spark, sf_dir):
    assert difference(op11_collocations, C.oracle_sql(), spark, sf_dir) == ""
    assert dict(op11_collocations(spark, sf_dir).dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}


def words(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["a", "b", "É", "日本", "C", "\x00", "d e", "'f", *(f"rare{i}" for i in range(30))]
    gaps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", ";\t"]
    return [("".join(rng.choice(vocabulary if rng.random() < 0.2 else vocabulary[:5]) + rng.choice(gaps) for _ in range(rng.randint(0, 80))), rng.choice(["en", "de", "", None])) for _ in range(n)]


def test_as_phrase_by_phrase(spark, monkeypatch):
    rows = words(120, 4) + [(None, "en"), ("", None), (" \t\n", "de"), ("New York City. " * 40, "xx")]
    df = spark.createDataFrame([(i, t, x, 1) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, n int").repartition(3)
    wanted = plain(rows)
    assert len(wanted) > 50
    assert found(C.collocations(df)) == wanted
    assert found(C.collocations(df, top=3, least=5, most=4)) == plain(rows, 4, 5, 3)
    # shards and bitmaps of other sizes: texts cut where pieces end, words that share a bit
    monkeypatch.setattr(C, "SHARD", 300)
    monkeypatch.setattr(C, "ROWS", 7)
    assert sorted(map(tuple, C.word_counts(df.select("lang", "text").na.fill("und", ["lang"])).collect())) == sorted((lang, 1, w, n) for (lang, w), n in counted(rows).items())


def counted(rows) -> Counter:
    return Counter(("und" if lang is None else lang, w) for text, lang in rows for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)) for w in re.findall("[^ \t]+", piece))


def test_a_crowded_bitmap_changes_nothing():
    """Rare words that share a bit with frequent ones cost rows, which their count drops."""
    rows = words(60, 9)
    texts, langs = [(t or "").encode().translate(C._PLAIN) for t, _ in rows], ["und" if x is None else x for _, x in rows]
    shard = C.Shard(texts, langs)
    every = np.full(C.BITS // 64, np.uint64(2**64 - 1))
    got = Counter()
    for m in (2, 3):
        for b in shard.phrase_counts(m, [every] * (m - 1)):
            got.update({(r["lang"], r["phrase"]): r["n"] for r in b.to_pylist()})
    f = Counter()
    for text, lang in zip(texts, langs):
        for piece in text.decode().split("\n"):
            ws = piece.split(" ")
            ws = [w for w in ws if w]
            for m in (2, 3):
                f.update((lang, " ".join(ws[i : i + m])) for i in range(len(ws) - m + 1))
    assert got == f
    assert list(shard.phrase_counts(2, [np.zeros_like(every)])) == []
    assert not sum(b.num_rows for b in shard.phrase_counts(3, [every, np.zeros_like(every)]))


def test_cut_texts():
    texts = [b"a b\nc d e\nf" * 30, b"no breaks here " * 40, b"", b"x"]
    C_SHARD = C.SHARD
    try:
        C.SHARD = 100
        parts = list(C._cut(texts, ["en"] * 4))
    finally:
        C.SHARD = C_SHARD
    assert [w for t, _ in parts for x in t for w in x.split()] == [w for x in texts for w in x.split()]
    assert max(len(x) for t, _ in parts for x in t if b"\n" in x) <= 100


def test_exact_scores(spark):
    """Products beyond 64 bits."""
    a, l, r = 987_654_321_987, 2_000_000_000_001, 1_999_999_999_999
    df = spark.createDataFrame([(a, l, r), (l, l, l), (10, l, r)], "a long, l long, r long")
    assert [x[0] for x in df.select(C.score(df.a, df.l, df.r)).collect()] == [10**6 * a * a // (l * r), 10**6, 0]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffixes_are_sorted(depth):
    rng = np.random.default_rng(depth)
    ids = rng.integers(0, 3, 200)
    ends = np.sort(np.append(rng.choice(np.arange(1, 200), 20, replace=False), 200))
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(200)
    suffixes = C.suffix_array(ids, left, depth)
    heads = [tuple(ids[s : s + min(depth, left[s])]) for s in suffixes]
    assert heads == sorted(heads) and sorted(suffixes) == list(range(200))
    shared = C.common_prefixes(ids, left, suffixes, depth)
    for (a, b), n in zip(zip(heads, heads[1:]), shared[1:]):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_messy_documents(spark):
    docs = cases.documents(spark)
    assert found(C.collocations(docs)) == plain([(r.text, r.lang) for r in docs.select("text", "lang").collect()])
    assert C.collocations(cases.empty(spark)).count() == 0
