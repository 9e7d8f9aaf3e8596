import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import whitening
from tidebook.llm.queries import op12_whitening
from tidebook.llm.whitening import whiten, whitening_report

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows) -> dict:
    """(vec_id, component) -> deviation, whitened up to its sign, explained; by numpy over the vectors that stay."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept], np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for (i, _), row, c in zip(kept, x, centred):
        dev = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
        for k in range(min(8, x.shape[1])):
            out[i, k + 1] = (n, dev, abs(c @ vectors[:, -1 - k]) / math.sqrt(values[-1 - k]), values[-1 - k] / values.sum())
    return out


def held(found, wanted):
    assert {(r.vec_id, r.component) for r in found} == set(wanted) and len(found) == len(wanted)
    for r in found:
        n, dev, white, share = wanted[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(r.whitened) == pytest.approx(white, abs=1e-8)
        assert r.explained == pytest.approx(share, rel=1e-8)
        assert r.identity_error < 1e-9


def test_as_numpy(spark, sf_dir):
    found = op12_whitening(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    held(found.collect(), plain([(r.vec_id, r.embedding) for r in rows]))
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


def test_same_sign_for_all_rows(spark):
    rows = [(i, [float(i), 2.0 * i, 0.1 * (i % 3)]) for i in range(20)]
    first = [r.whitened for r in whitening_report(spark.createDataFrame(rows, SCHEMA)).where("component = 1").orderBy("vec_id").collect()]
    assert first in (sorted(first), sorted(first, reverse=True))


def test_dropped_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0, 0.0, 0.0]), (102, [math.inf, 0.0, 0.0, 0.0, 0.0]), (103, [0.0, math.nan, 0.0, 0.0, 0.0]), (104, [-math.inf] * 5)]
    other = [(105, []), (106, [1.0, 2.0])]  # not the length of most
    df = spark.createDataFrame(rows + bad + other, SCHEMA).withColumns({"_x": F.lit("clash"), "whitened": F.lit(1), "n": F.lit(2)}).repartition(3)
    held(whitening_report(df).collect(), plain(rows))
    kept, _ = whiten(df)
    assert {"_x", "whitened", "n", "embedding"} <= set(kept.columns) and kept.count() == 40


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [-1.0, 0.125]), (2, [0.0, 3.0])]
    found = whitening_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r.n for r in found} == {4}


def test_no_rows_and_no_spread(spark):
    assert whitening_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening_report(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0
    alike = whitening_report(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], SCHEMA)).collect()
    assert len(alike) == 6 and all((r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, None, None) for r in alike)
    line = whitening_report(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(4)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)


def test_deviation_past_64_bits(spark):
    """By decimals where the bounds ask for it; null where a value doesn't fit."""
    large = float(2**31)
    rows = [(0, [large, 0.0]), (1, [-large, 0.0]), (2, [0.0, 0.0])]
    found = {r.vec_id: r.deviation for r in whitening_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {0: None, 1: None, 2: 0}
    rows = [(i, [2.0**k, 0.0]) for i, k in enumerate((18, 19, 20))]
    vectors, of = whiten(spark.createDataFrame(rows, SCHEMA))
    wide = replace(of, greatest=(1 << 40, 0))
    x = np.array([r[0] for r in vectors.select("_x").collect()])
    assert whitening.deviations(x, of) == whitening.deviations(x, wide) == [sum((3 * a - s) ** 2 for a, s in zip(v, of.sums)) for v in x.tolist()]


def test_every_pair_of_dimensions(spark):
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 6, 9):
        rows = [(i, (rng.normal(size=d) * range(1, d + 1)).tolist()) for i in range(50)]
        held(whitening_report(spark.createDataFrame(rows, SCHEMA)).collect(), plain(rows))
