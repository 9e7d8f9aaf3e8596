import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tests.oracle import difference
from tidebook.llm import mixing
from tidebook.llm.queries import op7_mixing, oracle_sql


def test_as_duckdb(spark, sf_dir):
    assert difference(op7_mixing, oracle_sql()["op7_mixing"], spark, sf_dir) == ""


def topic(text):
    lines = text.split("\n")
    if sum("|" in x or "\t" in x for x in lines) >= len(lines) / 2:
        return "tables"
    if sum(bool(re.match(" *([-*]|[0-9]+[.)]) ", x)) for x in lines) >= len(lines) / 2:
        return "lists"
    for chosen, most, name in (("#*$%&<>{}=+_~/@", 0.05, "symbols"), ("0123456789", 0.2, "numbers"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.25, "capitals")):
        if text and sum(c in chosen for c in text) >= most * len(text):
            return name
    return "prose"


TEXTS = ["a | b\nc | d\nend", "- one\n- two\nplain", "1. a\n 2) b", "x### y%%% z", "12 34 5a", "SHOUT it NOW", "Plain words, as ever.", "", " \n ", "a\tb", "été 日本"]


def test_topics(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", mixing.topic_of(F.col("text")).alias("topic")).collect()
    assert {r.text: r.topic for r in rows} == {t: topic(t) for t in TEXTS}
    assert {r.topic for r in rows} == set(mixing.TOPICS)


def brute(rows, targets=None):
    """rows: (doc_id, text, lang, source). Cells and the shares wanted of each value, by plain loops."""
    cells = defaultdict(float)
    keyed = [(i, (s or "", l or "", topic(t or "")), len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, l, s in rows]
    for _, cell, n in keyed:
        cells[cell] += n
    cells = {c: n for c, n in cells.items() if n}
    shares = []
    for k, key in enumerate(mixing.KEYS):
        sums = defaultdict(float)
        for c, n in cells.items():
            sums[c[k]] += n
        given = (targets or {}).get(key)
        weight = {v: given.get(v, 0) if given else n**mixing.POWER for v, n in sums.items()}
        share = {v: w / sum(weight.values()) for v, w in weight.items()}
        shares.append((share, sums))

    def within(goal):
        """By bisection: in proportion to the shares, but within reach of the goal."""
        out = []
        for share, sums in shares:
            low, high = 0.0, 1e9
            for _ in range(200):
                mid = (low + high) / 2
                asked = {v: min(mid * share[v], mixing.SLACK * sums[v] / goal) for v in share}
                low, high = (mid, high) if sum(asked.values()) < 1 else (low, mid)
            out.append(asked)
        return out

    return keyed, cells, within


def mixed_up(spark):
    rows = [(i * 3, t, ("en", "de", None)[i % 3], ("hot", "hot", "s0", "s1", None)[i % 5]) for i, t in enumerate(t for k in range(6) for t in cases.texts()[k:40])]
    return spark.createDataFrame([*rows, rows[7], rows[8]], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 0.25, "de": 0.25, "": 0.5}, "source": {"hot": 0.5, "s0": 0.5, "none has it": 0.3}}])
def test_as_brute_force(spark, targets):
    """The sample's marginals are the targets, and its cells are what only the optimum has: totals times a factor for each value, or all of a cell."""
    docs = mixed_up(spark)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    keyed, cells, shares = brute(rows, targets)
    frames = {k: spark.createDataFrame(list(v.items()), "value string, share double") for k, v in (targets or {}).items()}
    found = mixing.mix(docs, frames).collect()
    rate = {}
    for r in found:
        rate.setdefault((r.source, r.lang, r.topic), r.rate)
        u = int(hashlib.md5(f"mix-{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert 0 <= r.rate <= 1 and r.sampled == (u < r.rate)
    assert sorted((r.doc_id, r.n_tokens) for r in found) == sorted((i, n) for i, _, n in keyed)
    total = sum(rate[c] * n for c, n in cells.items())
    for k, share in enumerate(shares(total)):
        for v, wanted in share.items():
            assert sum(rate[c] * n for c, n in cells.items() if c[k] == v) == pytest.approx(wanted * total, abs=1e-6 * total)
    inner = [c for c in cells if 0 < rate[c] < 1 - 1e-9]
    design = np.array([[float(c[k] == v) for k in range(3) for v in shares(total)[k]] for c in inner])
    logs = np.log([rate[c] for c in inner])
    fit, *_ = np.linalg.lstsq(design, logs, rcond=None)
    assert np.allclose(design @ fit, logs, atol=1e-5)
    for c in cells:
        if rate[c] >= 1 - 1e-9 and inner:
            assert np.array([float(c[k] == v) for k in range(3) for v in shares(total)[k]]) @ fit > -1e-5 or targets
    assert total <= mixing.SHARE * sum(cells.values()) * (1 + 1e-9)
    assert targets or total == pytest.approx(mixing.SHARE * sum(cells.values()))


def test_the_expected_sample_meets_the_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(*(v.alias(k) for k, v in mixing._plain(docs).items()))
    rated, targets = mixing.raked(mixing.cells_of(rows))
    assert rated.agg(F.max("off")).first()[0] <= mixing.TOLERANCE
    table = mixing.reached(rated, targets).collect()
    assert {r.key for r in table} == set(mixing.KEYS)
    for r in table:
        assert r.share == pytest.approx(r.target, abs=1e-7)
    assert rated.agg(F.max("rate")).first()[0] <= 1


def test_targets_that_contradict_each_other_end(spark):
    cells = spark.createDataFrame([("a", "x", "p", 100.0), ("b", "y", "p", 100.0)], "source string, lang string, topic string, tokens double")
    targets = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, share double"), "lang": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "value string, share double")}
    rated, _ = mixing.raked(cells, targets)
    assert rated.agg(F.max("off")).first()[0] > 0.1
    assert rated.count() == 2


def test_targets_that_are_not_met_raise(spark, monkeypatch):
    """Where all lists are English, there is no sample of lists alone and German alone."""
    monkeypatch.setattr(mixing, "LEAST", 0.9)
    monkeypatch.setattr(mixing, "STALLED", 1)
    rows = spark.createDataFrame([("s", ("en", "de")[i % 2], "lists" if i % 10 == 0 else "prose", 20) for i in range(100)], "source string, lang string, topic string, n_tokens long")
    frame = lambda value: spark.createDataFrame([(value, 1.0)], "value string, share double")
    with pytest.raises(mixing.TargetsNotMet, match="of the sample for a target of"), pytest.warns(UserWarning, match="can't be met with"):
        mixing.cell_rates(rows, {"topic": frame("lists"), "lang": frame("de")})


def test_many_cells_as_few(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cells = mixing.cells_of(docs.select(*(v.alias(k) for k, v in mixing._plain(docs).items())))
    few = {tuple(r[:3]): r.rate for r in mixing.raked(cells, tolerance=1e-3)[0].collect()}
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 10)
    many = {tuple(r[:3]): r.rate for r in mixing.raked(cells, tolerance=1e-3)[0].collect()}
    assert few == pytest.approx(many, rel=1e-9)


def test_a_given_topic(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 20, "en", "s", "even" if i % 4 else "rest") for i in range(400)], "doc_id long, text string, lang string, source string, about string")
    wanted = spark.createDataFrame([("even", 0.5), ("rest", 0.5)], "value string, share double")
    found = mixing.mix(docs, {"topic": wanted}, topic="about")
    rates = {r.topic: r.rate for r in found.select("topic", "rate").distinct().collect()}
    assert rates["rest"] == pytest.approx(0.98) and rates["even"] == pytest.approx((0.6 - 0.25 * 0.98) / 0.75)  # the scarce topic is asked for what it has
    assert mixing.sample_mixture(docs, {"topic": wanted}, topic="about").count() == found.where("sampled").count()


def test_sampled_rows_stay_as_they_are(spark):
    docs = cases.documents(spark).withColumnRenamed("shard", "topic").withColumnRenamed("n_words", "_rate")
    kept = mixing.sample_mixture(docs)
    assert kept.columns == docs.columns
    chosen = {r.doc_id for r in mixing.mix(docs).where("sampled").collect()}
    assert {r.doc_id for r in kept.collect()} == chosen
    assert 0 < kept.count() < docs.count()


def test_empty_table(spark):
    assert mixing.mix(cases.empty(spark)).count() == 0
    assert mixing.sample_mixture(cases.empty(spark)).count() == 0
