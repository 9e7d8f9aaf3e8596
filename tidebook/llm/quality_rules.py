"""Quality rules: fixed rules on word statistics, then robust multivariate outliers.

Each language and source has a minimum-covariance-determinant (MCD) estimate of the centre and scatter of five transformed
statistics. The search starts from two deterministic subsets and concentrates them (Rousseeuw and Van Driessen, 1999; Hubert et al., 2012):
each step keeps the share H of the rows that lie nearest and estimates anew. The estimate of the smaller determinant is made
consistent and reweighted once, and rows beyond a high quantile of Mahalanobis distance are rejected. Statistics that most of a group's
rows have alike would make the scatter singular; so it is drawn towards a fixed target (Boudt et al., 2020), whose unit
is the spread below which a statistic tells nothing.

All of it is DataFrame expressions over one narrow table of statistics: the text is read once, and each step is a join with one
row of estimates for each group and a combined aggregation, so a group of any size is spread over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import BROADCAST_ROWS, SPACE, materialize, numbered, replacing

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
#: Statistics as transformed, and the spread of each that is taken for harmless.
HARMLESS = {"length": 0.5, "word_length": 0.4, "symbols": 0.3, "dup_lines": 0.7, "repeats": 0.06}
NAMES = list(HARMLESS)
P = len(NAMES)
#: Share of a group's rows that the estimate rests on; weight of the target; concentration steps.
H, TARGET, STEPS = 0.75, 0.25, 4
#: Rows beyond this quantile of the squared distance's chi-square distribution are rejected.
QUANTILE = 1 - 1e-7
#: Rows of a group at which half of what the target doesn't have is drawn towards it too.
FEW = 10
#: Steps for each doubling-by-e of the values whose quantiles are taken.
FINE = 512


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


CONSISTENT = H / chi2_cdf(chi2_quantile(H, P), P + 2)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def word_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text; null text: all 0."""
    none = F.lit(0).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = replacing(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_t", "_words", "_lines", "_grams", "_places").withColumn("_t", text)
    df = df.withColumns(
        {
            "_words": _words(F.col("_t")),
            "_lines": F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
            "word_chars": F.length(F.translate("_t", SPACE, "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        }
    )
    gram = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_grams": F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), gram)),
        }
    )
    # the windows by hash and place, and of those the ones whose neighbour has the same hash
    placed = F.sort_array(F.transform("_grams", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_places", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), placed))
    same = lambda x, k: F.coalesce(F.get("_places", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_places", lambda x, k: same(x, k - 1) | same(x, k + 1))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_places").isNotNull(), F.size(covered)).cast("long"), none))
    return df.drop("_t", "_words", "_lines", "_grams", "_places")


def _transformed() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "length": F.log1p(F.col("n_words")),
        "word_length": F.col("word_chars") / words,
        "symbols": F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "dup_lines": F.log1p(F.col("n_dup_lines")),
        "repeats": F.col("n_repeat_words") / words,
    }


def _rounded(x: Column) -> Column:
    """A whole number that tells a value of 0 or more to about 0.2 %. The edges lie off the whole and half numbers on which medians fall."""
    return F.floor(F.log1p(x) * FINE + 0.3).cast("double")


def _quantile(x: Column, share: float) -> Column:
    return F.percentile(_rounded(x), F.lit(share))


def _median(x: Column) -> Column:
    return F.expm1(_quantile(x, 0.5) / FINE)


def _z(name: str) -> Column:
    return F.col(f"z_{name}")


def _moments(keep: Column, prefix: str) -> list[Column]:
    """Count, means and mean products of the standardised statistics over the rows to keep."""
    out = [F.sum(F.when(keep, 1.0)).alias(f"{prefix}n")]
    for i, a in enumerate(NAMES):
        out.append(F.avg(F.when(keep, _z(a))).alias(f"{prefix}m{i}"))
        out += [F.avg(F.when(keep, _z(a) * _z(b))).alias(f"{prefix}s{i}{j}") for j, b in enumerate(NAMES[: i + 1])]
    return out


def _factor(df: DataFrame, prefix: str) -> DataFrame:
    """The Cholesky factor {prefix}l.. and log-determinant {prefix}det of the scatter drawn towards the target."""
    free = (1 - TARGET) * F.col(f"{prefix}n") / (F.col(f"{prefix}n") + FEW)
    c = lambda *x: F.col(prefix + "".join(map(str, x)))
    for i in range(P):
        for j in range(i + 1):
            cov = free * (c("s", i, j) - c("m", i) * c("m", j)) + (1 - free if i == j else F.lit(0.0))
            for k in range(j):
                cov = cov - c("l", i, k) * c("l", j, k)
            df = df.withColumn(f"{prefix}l{i}{j}", F.sqrt(F.greatest(cov, F.lit(1e-9))) if i == j else cov / c("l", j, j))
    return df.withColumn(f"{prefix}det", sum((F.log(c("l", i, i)) for i in range(P)), F.lit(0.0)))


def _estimates(df: DataFrame, prefixes: list[str]) -> DataFrame:
    for p in prefixes:
        df = _factor(df, p)
    return df.select("cell", *(f"{p}{x}" for p in prefixes for x in ("det", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)))))


def _with_distance(df: DataFrame, prefix: str, column: str) -> DataFrame:
    """The squared Mahalanobis distance, by forward substitution."""
    total: Column = F.lit(0.0)
    for i, a in enumerate(NAMES):
        y = _z(a) - F.col(f"{prefix}m{i}")
        for j in range(i):
            y = y - F.col(f"{prefix}l{i}{j}") * F.col(f"_y{prefix}{j}")
        df = df.withColumn(f"_y{prefix}{i}", y / F.col(f"{prefix}l{i}{i}"))
        total = total + F.col(f"_y{prefix}{i}") * F.col(f"_y{prefix}{i}")
    return df.withColumn(column, total).drop(*(f"_y{prefix}{i}" for i in range(P)))


class _Mcd:
    """The estimates of all groups; rows: cell, the group, and standardised statistics of the rows that count."""

    def __init__(self, rows: DataFrame, cells: int):
        self.rows, self.hint = rows, F.broadcast if cells <= BROADCAST_ROWS else lambda df: df  # all sides have a row for each cell

    def joined(self, side: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        side = side.withColumnRenamed("cell", "_of")
        return (self.rows if rows is None else rows).join(self.hint(side), F.col("cell") == F.col("_of")).drop("_of")

    def nearest(self, df: DataFrame, starts: list[str]) -> DataFrame:
        """Estimates from the share H of each cell's rows with the least d_{start}."""
        edges = df.groupBy("cell").agg(*(_quantile(F.col(f"d_{s}"), H).alias(f"q_{s}") for s in starts))
        kept = self.joined(edges, df)
        sums = kept.groupBy("cell").agg(*(m for s in starts for m in _moments(_rounded(F.col(f"d_{s}")) <= F.col(f"q_{s}"), s)))
        return materialize(_estimates(sums, starts), "mcd")

    def run(self) -> DataFrame:
        square = [_z(n) * _z(n) for n in NAMES]
        starts = ["a", "b"]  # nearest by the sum, and by the largest, of the squared statistics
        est = self.nearest(self.rows.withColumns({"d_a": sum(square, F.lit(0.0)), "d_b": F.greatest(*square)}), starts)
        for _ in range(STEPS):
            df = self.joined(est)
            for s in starts:
                df = _with_distance(df, s, f"d_{s}")
            est = self.nearest(df, starts)
        better = F.col("adet") <= F.col("bdet")
        best = est.select("cell", *(F.when(better, F.col(f"a{c[1:]}")).otherwise(F.col(f"b{c[1:]}")).alias(f"r{c[1:]}") for c in est.columns if c[0] == "a"))
        near = _with_distance(self.joined(best), "r", "d").where(F.col("d") <= chi2_quantile(0.975, P) * CONSISTENT)
        return materialize(_estimates(near.groupBy("cell").agg(*_moments(F.lit(True), "r")), ["r"]), "mcd")


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _prepared(rows: DataFrame) -> DataFrame:
    """rows (with lang, source and text) with their statistics, group and base_failed, written to the shared folder; text and the two columns are dropped."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source"))
    cell = F.concat(F.length(lang).cast("string"), F.lit(":"), lang, source)
    stats = word_statistics(rows.withColumn("cell", cell)).withColumn("base_failed", failed).withColumns(_transformed())
    return materialize(stats.drop("lang", "source", "text"), "statistics")


def _with_verdict(stats: DataFrame) -> DataFrame:
    """stats with distance and kept: the groups' estimates, one row for each, are joined to the rows, which are not shuffled while those are few."""
    counted = stats.where("not base_failed").select("cell", *NAMES)
    centres = materialize(counted.groupBy("cell").agg(*(_median(F.col(n)).alias(f"c_{n}") for n in NAMES)), "centres")
    mcd = _Mcd(counted, centres.count())
    off = mcd.joined(centres)
    spreads = off.groupBy("cell").agg(*(F.greatest(1.4826 * _median(F.abs(F.col(n) - F.col(f"c_{n}"))), F.lit(HARMLESS[n])).alias(f"w_{n}") for n in NAMES))
    units = materialize(centres.join(spreads, "cell"), "units")
    standard = {f"z_{n}": (F.col(n) - F.col(f"c_{n}")) / F.col(f"w_{n}") for n in NAMES}
    mcd.rows = materialize(mcd.joined(units).withColumns(standard).select("cell", *standard), "standardised")
    final = materialize(mcd.run().join(units, "cell"), "estimates").withColumnRenamed("cell", "_of")
    rows = stats.join(mcd.hint(final), F.col("cell") == F.col("_of"), "left").withColumns(standard)
    outlier = F.coalesce(F.col("distance") > chi2_quantile(QUANTILE, P), F.lit(False))  # null: a group of base-failed rows alone
    return _with_distance(rows, "r", "distance").withColumn("kept", ~F.col("base_failed") & ~outlier)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance and kept of each row.

    Fewer than 50 words, or over half the words in repeated 3-word windows, fail the base rules; of the other rows, outliers of
    their group fail. A null text has no words and fails; null languages and sources are groups of their own. Base-failed rows of a group without
    other rows have no distance. Repeated rows count as often as they occur. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "lang", "source", "text", F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    return _with_verdict(_prepared(rows)).select("doc_id", F.col("_lang").alias("lang"), F.col("_source").alias("source"), *STATISTICS, "base_failed", "distance", "kept")


def quality_report(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", *STATISTICS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that judged() rejects; columns stay as they are, whatever their names. Each row is judged by itself, repeated ones alike; an empty table stays empty.

    The documents are written once with their statistics, so that no list of rejected rows is joined to them.
    """
    rows, name = numbered(docs)
    stats = _prepared(rows.select("*", *(F.col(name[c]).alias(c) for c in ("lang", "source", "text"))))
    return _with_verdict(stats).where("kept").select(*rows.columns).toDF(*docs.columns)
