"""Documents that try the operators: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def texts() -> list[str | None]:
    rng = random.Random(7)
    words = ["the", "of", "And", "ÉTÉ", "naïve", "x1", "#tag", "<b>", "日本", "end."]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 130))) for _ in range(40)]
    base = " ".join(f"token{rng.randint(0, 500)}" for _ in range(300))
    near = [base, base + " tail", base.replace("token1", "token2", 1), base]
    lines = ["one two three\none two three\nfour\n\n  \none two three", "a\tb\x0bc\x0cd\re\nf", "\x1ca\x1cb c d e f"]
    shared = [f"start {i} {PASSAGE} stop {i * 3}" for i in range(4)]
    return [None, "", " \n\t ", "one", "One two", "same same same same same same", *plain, *near, *lines, *shared, LONG, LONG[: len(LONG) // 2], "x" * 5_000, "ab" * 400, "É" * 300]


def documents(spark: SparkSession, extra: bool = True) -> DataFrame:
    rows = [(i * 3, t, ("en", "de", None)[i % 3], "hot" if i % 3 else f"s{i % 5}") for i, t in enumerate(texts())]
    rows += [rows[7], rows[8]]  # repeated rows
    df = spark.createDataFrame([(*r, len(r[1] or ""), "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, shard string, n_words int")
    return (df if extra else df.drop("shard", "n_words")).repartition(5)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df: DataFrame) -> list[tuple]:
    """All rows, sorted, with doubles rounded."""
    plain = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]
    return sorted(plain, key=repr)


def rows_of_list(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=repr)
