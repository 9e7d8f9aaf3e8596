import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import cases
from tidebook.llm import quality_rules as Q


def statistics(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    n = len(words)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics_as_brute_force(spark, sf_dir):
    for docs in (cases.documents(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        found = Q.quality_report(docs).drop("distance", "kept").collect()
        assert cases.rows_of_list(found) == cases.rows_of_list((r.doc_id, *statistics(r.text)) for r in docs.select("doc_id", "text").collect())


def transformed(s):
    n, chars, symbols, dup, repeats, _ = s
    n = max(n, 1)
    return [np.log1p(s[0]), chars / n, np.log1p(100 * symbols / max(chars, 1)), np.log1p(dup), repeats / n]


def mcd_distances(x):
    """The same estimate with numpy, for one group."""
    rounded = lambda v: np.floor(np.log1p(v) * Q.FINE + 0.3)
    median = lambda v: np.expm1(np.percentile(rounded(v), 50) / Q.FINE)
    centre = np.array([median(c) for c in x.T])
    spread = np.maximum(1.4826 * np.array([median(c) for c in np.abs(x - centre).T]), list(Q.HARMLESS.values()))
    z = (x - centre) / spread

    def estimate(rows):
        m = rows.mean(axis=0)
        free = (1 - Q.TARGET) * len(rows) / (len(rows) + Q.FEW)
        return m, free * (rows.T @ rows / len(rows) - np.outer(m, m)) + (1 - free) * np.eye(Q.P)

    def distance(est):
        d = z - est[0]
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(est[1]), d)

    best = []
    for d in ((z**2).sum(axis=1), (z**2).max(axis=1)):
        for _ in range(Q.STEPS + 1):
            est = estimate(z[rounded(d) <= np.percentile(rounded(d), 100 * Q.H)])
            d = distance(est)
        best.append((np.linalg.det(est[1]), est))
    est = min(best, key=lambda b: b[0])[1]
    near = distance(est) <= Q.chi2_quantile(0.975, Q.P) * Q.CONSISTENT
    return distance(estimate(z[near]))


def test_distances_as_numpy(spark, sf_dir):
    """One estimate for each language and source, from groups of a single row to one of over 200, and a distance for every row that passes the base rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.crossJoin(spark.range(1, 4).withColumnRenamed("id", "k"))  # a small fixture: each text with one to three words more
    hot = more.selectExpr("doc_id + 1000 * k as doc_id", "concat(text, repeat(' tail', k)) as text", "'en' as lang", "'src0' as source", "n_chars")
    lone = docs.where("doc_id in (5, 8, 11)").selectExpr("doc_id + 2000000 as doc_id", "text", "lang", "concat('lone', doc_id) as source", "n_chars")
    found = Q.judged(docs.unionByName(hot).unionByName(lone)).collect()
    groups = defaultdict(list)
    for r in found:
        if not r.base_failed:
            assert r.distance is not None
            groups[r.lang, r.source].append(r)
    sizes = list(map(len, groups.values()))
    assert min(sizes) == 1 and max(sizes) > 200 and len(groups) > 40
    for rows in groups.values():
        d = mcd_distances(np.array([transformed((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, None)) for r in rows]))
        assert np.allclose(d, [r.distance for r in rows], rtol=1e-6, atol=1e-9)
        assert [bool(x <= Q.chi2_quantile(Q.QUANTILE, Q.P)) for x in d] == [r.kept for r in rows]


def test_partitions_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert cases.rows_of(Q.quality_report(docs.repartition(1))) == cases.rows_of(Q.quality_report(docs.repartition(13)))


def test_clashing_columns_stay(spark):
    good = " ".join(f"word{i}" for i in range(80))
    names = ["doc_id", "text", "lang", "source", "_i", "_h", "cell", "kept", "n_words", "distance", "_c0"]
    docs = spark.createDataFrame([(1, good, "en", "s", *range(7)), (2, "short", "en", "s", *range(7))], ", ".join(f"{n} {'string' if n in ('text', 'lang', 'source') else 'long'}" for n in names))
    out = Q.keep_good(docs)
    assert out.columns == names and [tuple(r) for r in out.collect()] == [(1, good, "en", "s", *range(7))]


def test_planted_outliers_go_and_clean_rows_stay(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    clean = [" ".join(word() for _ in range(int(rng.integers(60, 400)))) for _ in range(300)]
    symbols = [" ".join(word() + "###$$$%%%" for _ in range(200)) for _ in range(6)]
    endless = [" ".join("x" * 60 + word() for _ in range(200)) for _ in range(6)]
    short = ["too short", None, ""]
    texts = clean + symbols + endless + short
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in Q.keep_good(docs).collect()}
    assert kept == set(range(300))


def test_rows_that_share_an_id_and_messy_tables(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, "en", None), (1, "short", "en", None), (None, good, None, "s"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id or 0, r.text) for r in Q.keep_good(docs).collect()) == [(0, good), (1, good)]
    docs = cases.documents(spark)
    assert Q.keep_good(docs).columns == docs.columns
    assert Q.quality_report(cases.empty(spark)).count() == 0
    assert Q.keep_good(cases.empty(spark)).count() == 0


def test_chi_square():
    assert Q.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert Q.chi2_quantile(0.975, 5) == pytest.approx(12.832502, abs=1e-5)
