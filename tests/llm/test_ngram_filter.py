import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from tests.llm import cases
from tidebook.llm import ngram_filter as N


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def brute(rows):
    """The contract's columns, and the model's score with exact levels of counts."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    tokens = [[*words_of(t), None] for _, t in rows]
    count, pair = Counter(), Counter()
    for h, ts in zip(held, tokens):
        if not h:
            count.update(ts)
            pair.update(zip(["<s>", *ts[:-1]], ts))
    n, v, documents = sum(count.values()), len(count), held.count(False)
    level = lambda c: float(N.count_of(N.level_of(np.array([c])))[0]) if c else 0.0
    out = []
    for (i, _), h, ts in zip(rows, held, tokens):
        base = sum(log10((count[t] + 1) / (n + v + 1)) for t in ts)
        score = 0.0
        for b, t in zip(["<s>", *ts[:-1]], ts):
            before = documents if b == "<s>" else level(count[b])
            prior = (level(count[t]) + 1) / (n + v + 1)
            score += log10((min(level(pair[b, t]), before) + N.PRIOR * prior) / (before + N.PRIOR))
        out.append((i, h, len(ts), sum(count[t] > 0 for t in ts), n, base, score))
    return out


def test_as_brute_force(spark, sf_dir):
    for docs in (cases.documents(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        wanted = sorted(brute(rows), key=repr)
        found = sorted(map(tuple, N.lm_scores(docs).collect()), key=repr)
        assert len(found) == len(wanted)
        for f, w in zip(sorted(found, key=lambda r: (r[0], r[2])), sorted(wanted, key=lambda r: (r[0], r[2]))):
            assert f[:5] == w[:5]
            assert f[5] == pytest.approx(w[5], rel=1e-9)
            assert f[6] == pytest.approx(w[6], rel=0.03)  # counts that the filter has too large


def test_blocks_change_nothing(spark):
    docs = cases.documents(spark)
    one, many = ({(r.doc_id, r.n_tokens): r for r in N.lm_scores(docs, b).collect()} for b in (1 << 30, 3_000))
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert (many[k].n_known, many[k].base_score, many[k].score) == pytest.approx((r.n_known, r.base_score, r.score), rel=1e-12)


def test_counts_read_back_are_never_too_small():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    level = rng.integers(1, 12, len(h))

    bits, flags = N._segment([(h, level)])
    block = N.Block([{"part": 0, "hashes": b"", "counts": b"", "bits": bits, "filter": flags}], 1, 0, 1)
    found = block.levels(h)
    assert (found >= level).all()
    assert (found > level).mean() < 0.02
    others = block.levels(h + np.uint64(1))
    assert (others > 0).mean() < 0.02


def test_pieces_of_long_texts_change_nothing(spark, monkeypatch):
    text = " ".join(f"w{i * i % 611}" for i in range(9_000))
    docs = spark.createDataFrame([(1, text), (3, text[:30_000]), (4, " " * 5_000)], "doc_id long, text string")
    batch = docs.toArrow().to_batches()
    one = [N.sequences(N.as_bytes(b, "text"), N.HELD) for b in batch]
    tokens = [t[N.scored_places(s, t)] for g in one for _, s, t in g]
    pairs = [N.pairs(t[N.scored_places(s, t) - 1], t[N.scored_places(s, t)]) for b in batch for _, s, t in N.sequences(N.as_bytes(b, "text"), N.HELD)]
    monkeypatch.setattr(N, "PIECE", 700)
    many = [(s, t) for b in batch for _, s, t in N.sequences(N.as_bytes(b, "text"), 1_500)]
    assert len(many) > 20
    assert np.concatenate([t[N.scored_places(s, t)] for s, t in many]).tolist() == np.concatenate(tokens).tolist()
    assert np.concatenate([N.pairs(t[N.scored_places(s, t) - 1], t[N.scored_places(s, t)]) for s, t in many]).tolist() == np.concatenate(pairs).tolist()


def test_a_text_of_several_pieces_through_spark(spark):
    long = " ".join(f"w{i * i % 7919}" for i in range(500_000))
    assert len(long) > 2 * N.PIECE
    docs = spark.createDataFrame([(1, long), (2, "w1 w4 w9"), (5, None)], "doc_id long, text string")
    for f, w in zip(sorted(map(tuple, N.lm_scores(docs).collect())), sorted(brute([(1, long), (2, "w1 w4 w9"), (5, None)]))):
        assert f[:5] == w[:5]
        assert f[5:] == pytest.approx(w[5:], rel=0.03)


def test_words_of_equal_polynomial_hash_are_told_apart(spark):
    """Thue-Morse strings, which any polynomial modulo a power of two takes for equal."""
    a, b = ("".join(x if bin(i).count("1") % 2 else y for i in range(2048)) for x, y in ("ab", "ba"))
    rows = [(1, f"{a} x"), (3, f"{a} y"), (4, "x y")]
    held = next(i for i in range(10, 100) if zlib.crc32(str(i).encode()) % 7 == 2)
    found = {r.doc_id: r for r in N.lm_scores(spark.createDataFrame([*rows, (held, f"{b} x")], "doc_id long, text string")).collect()}
    assert (found[held].held_out, found[held].n_known) == (True, 2)
    assert found[1].n_known == 3


def test_likely_texts_score_higher(spark):
    rng = np.random.default_rng(2)
    draw = lambda: " ".join(f"w{int(x)}" for x in np.cumsum(rng.integers(0, 3, 200)) % 50)
    texts = [draw() for _ in range(200)]
    mixed_up = [" ".join(rng.permutation(t.split())) for t in texts[:50]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + mixed_up)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in N.lm_scores(docs).collect()}
    assert np.mean([score[i] for i in range(50)]) > np.mean([score[200 + i] for i in range(50)]) + 20


def test_empty_table(spark):
    assert N.lm_scores(cases.empty(spark)).count() == 0
    one = N.lm_scores(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.held_out, r.n_tokens, r.train_tokens) for r in one] == [(None, False, 1, 1)]
