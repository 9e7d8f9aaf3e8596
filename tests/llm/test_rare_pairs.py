from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pytest

from tests.llm.test_ngram_filter import words_of
from tidebook.llm import ngram_filter as N


def test_pairs_seen_once_count(spark):
    ids = [i for i in range(200) if crc32(str(i).encode()) % 7 != 2][:6]
    a, b = [i for i in range(200) if crc32(str(i).encode()) % 7 == 2][:2]
    docs = [(i, f"w{2 * k} w{2 * k + 1}") for k, i in enumerate(ids)] + [(a, "w0 w1"), (b, "w0 w3")]
    score = {r.doc_id: r.score for r in N.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    n, v = 3 * len(ids), 2 * len(ids) + 1
    prior = N.PRIOR * 2 / (n + v + 1)
    assert score[a] - score[b] == pytest.approx(log10((1 + prior) / prior), rel=1e-9)


def test_as_brute_force_with_every_pair(spark, sf_dir):
    """The score with exact levels of all counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, [*words_of(r.text), None]) for r in docs.select("doc_id", "text").collect()]
    count, pair, documents = Counter(), Counter(), 0
    for i, ts in rows:
        if crc32(str(i).encode()) % 7 != 2:
            documents += 1
            count.update(ts)
            pair.update(zip(["<s>", *ts[:-1]], ts))
    n, v = sum(count.values()), len(count)
    level = lambda c: float(N.count_of(N.level_of(np.array([c])))[0]) if c else 0.0
    found = {r.doc_id: r.score for r in N.lm_scores(docs).collect()}
    for i, ts in rows:
        score = 0.0
        for b, t in zip(["<s>", *ts[:-1]], ts):
            before = documents if b == "<s>" else level(count[b])
            score += log10((min(level(pair[b, t]), before) + N.PRIOR * (level(count[t]) + 1) / (n + v + 1)) / (before + N.PRIOR))
        assert found[i] == pytest.approx(score, rel=0.03)
