"""Mixing sources to target weights by iterative proportional fitting (Deming and Stephan, 1940).

The token totals of the cells (source, language, topic) are raked until the marginal sums over sources, over languages and over topics are those
wanted. A cell's raked total over its own is the rate of its documents, and a document is sampled if its hash is below its rate: each document by itself, so the
sample doesn't depend on partitions. No cell can give more than it has: the raking keeps every rate at 1 or below, and fits the other cells around
those that give all. A value with too few tokens for its target is asked for what it has, and the others of its marginal share the rest; where marginals can't be met together, fewer
tokens are asked for. Sweeps end when every marginal is met.

All of it is DataFrame expressions over the table of cells, which has their factors, one for each of a cell's three values; a sweep writes it anew. A step
sums over the cells of each value: by a window where the cells are few, else by a combined aggregation and a join, however many cells a source, language or topic has.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import BROADCAST_ROWS, materialize, numbered, sized

KEYS = ["source", "lang", "topic"]
#: Share of all tokens to sample, at most; share of a value's tokens that is asked for at most.
SHARE, SLACK = 0.6, 0.98
#: A marginal is met if no value is off by more than this share of the sample; sweeps without progress after which fewer tokens are asked for, how many fewer, and the share of the first goal at which it ends.
TOLERANCE, STALLED, FEWER, LEAST = 1e-9, 5, 0.75, 0.05
#: Targets that were given must be met up to this share of the sample.
MOST_OFF = 0.01
#: Without targets a marginal's share is its share of tokens to this power: large values weigh less, small ones more.
POWER = 0.7
HASH_BITS = 52
SEED = "mix-"

#: Topics are told by the form of the text, the first that fits, from shares of its lines or of its characters on.
SYMBOLS, DIGITS, CAPITALS = "[#*$%&<>{}=+_~/@]", "[0-9]", "[A-Z]"
MOST_LINES, MANY_SYMBOLS, MANY_DIGITS, MANY_CAPITALS = 0.5, 0.05, 0.2, 0.25
LIST_LINE = "(^|\\n) *([-*]|[0-9]+[.)]) "
TOPICS = ["tables", "lists", "symbols", "numbers", "capitals", "prose"]


def topic_of(text: Column) -> Column:
    chars, lines = F.length(text), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    ruled = F.size(F.filter(F.split(text, "\n"), lambda x: x.contains("|") | x.contains("\t")))
    many = lambda pattern, share: (chars > 0) & (F.regexp_count(text, F.lit(pattern)) >= share * chars)
    out = F.when((text.contains("|") | text.contains("\t")) & (ruled >= MOST_LINES * lines), "tables").when(F.regexp_count(text, F.lit(LIST_LINE)) >= MOST_LINES * lines, "lists")
    return out.when(many(SYMBOLS, MANY_SYMBOLS), "symbols").when(many(DIGITS, MANY_DIGITS), "numbers").when(many(CAPITALS, MANY_CAPITALS), "capitals").otherwise("prose")


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone: the first 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("double") / F.lit(float(1 << HASH_BITS))


def cells_of(docs: DataFrame) -> DataFrame:
    """source, lang, topic and tokens, one row for each cell; nulls are the value ""."""
    return docs.groupBy(*KEYS).agg(F.sum("n_tokens").cast("double").alias("tokens")).where("tokens > 0")


def _marginals(cells: DataFrame) -> DataFrame:
    """key, value and tokens of every value that a cell has."""
    return reduce(DataFrame.union, (cells.groupBy(F.lit(k).alias("key"), F.col(k).alias("value")).agg(F.sum("tokens").alias("tokens")) for k in KEYS))


def _shares(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """key, value, tokens and share: the targets given, spread over the values that have tokens, or else tempered ones. Values without a target have the share 0."""
    sums = materialize(_marginals(cells), "marginals")
    given = reduce(DataFrame.union, (t.select(F.lit(k).alias("_k"), F.col("value").alias("_v"), F.col("share").cast("double").alias("w")) for k, t in targets.items())) if targets else None
    weight = F.pow("tokens", F.lit(POWER))
    if given is not None:
        sums = sums.join(given, (F.col("key") == F.col("_k")) & (F.col("value") == F.col("_v")), "left")
        weight = F.when(F.col("key").isin(*targets), F.coalesce("w", F.lit(0.0))).otherwise(weight)
    rows = materialize(sums.select("key", "value", "tokens", weight.alias("weight")), "weights")
    totals = rows.groupBy(F.col("key").alias("_key")).agg(F.sum("weight").alias("total"))  # one row for each of KEYS
    return rows.join(F.broadcast(totals), F.col("key") == F.col("_key")).select("key", "value", "tokens", F.coalesce(F.try_divide("weight", "total"), F.lit(0.0)).alias("share"))


def _within_reach(shares: DataFrame, goal: float) -> DataFrame:
    """shares with target, the share that is asked for: in proportion to share, but no more than SLACK of a value's tokens. The proportion is one number for each of KEYS."""
    cap = SLACK * F.col("tokens") / F.lit(goal)
    scale = dict.fromkeys(KEYS, 1.0)
    while True:
        now = F.create_map(*(F.lit(x) for k in KEYS for x in (k, scale[k])))[F.col("key")] * F.col("share")
        sums = shares.groupBy("key").agg(F.sum(F.when(now >= cap, cap).otherwise(0.0)).alias("full"), F.sum(F.when(now < cap, F.col("share")).otherwise(0.0)).alias("free")).collect()
        new = scale | {r.key: max(scale[r.key], (1 - r.full) / r.free) for r in sums if r.free > 0}
        if all(new[k] <= scale[k] * (1 + 1e-12) for k in KEYS):
            return shares.withColumn("target", F.least(now, cap))
        scale = new


def _with_sums(cells: DataFrame, key: str, sums: dict[str, Column], small: bool) -> DataFrame:
    """cells with sums over the cells of the same value. Few cells are one partition, in which windows cost no shuffle; many are combined where they are, and joined with the sums."""
    if small:
        return cells.withColumns({n: F.sum(x).over(Window.partitionBy(key)) for n, x in sums.items()})
    found = materialize(cells.groupBy(F.col(key).alias("_v")).agg(*(F.sum(x).alias(n) for n, x in sums.items())), "sums")
    return cells.join(sized(found), F.col(key) == F.col("_v")).drop("_v")


def _raked_once(cells: DataFrame, goal: float, small: bool) -> DataFrame:
    """cells with new factors, after one step for each of the marginals, and off: by how much a value was off before its step, as a share of the goal.

    A step solves for a value's factor with the cells that give all as they are.
    """
    cells = cells.withColumn("off", F.lit(0.0))
    for k in KEYS:
        mass = reduce(lambda a, x: a * F.col(f"f_{x}"), [x for x in KEYS if x != k], F.col("tokens"))
        factor, full = F.col(f"f_{k}"), mass * F.col(f"f_{k}") >= F.col("tokens")
        sums = {"given": F.when(full, F.col("tokens")).otherwise(0.0), "free": F.when(full, 0.0).otherwise(mass)}
        wanted, have = goal * F.col(f"share_{k}"), F.col("given") + F.col("free") * factor
        solved = F.when((wanted > F.col("given")) & (F.col("free") > 0), (wanted - F.col("given")) / F.col("free")).otherwise(F.coalesce(factor * F.try_divide(wanted, have), F.lit(0.0)))
        found = _with_sums(cells, k, sums, small)
        cells = found.withColumns({f"f_{k}": solved, "off": F.greatest("off", F.abs(have - wanted) / goal)}).drop("given", "free")
    return cells


def _started(cells: DataFrame, shares: DataFrame, goal: float, total: float | None, small: bool) -> tuple[DataFrame, DataFrame]:
    """The targets within reach of a goal, and cells with them and with first factors."""
    targeted = materialize(_within_reach(shares, goal), "targets") if goal else shares.withColumn("target", F.col("share"))
    for k in KEYS:
        side = targeted.where(F.col("key") == k).select(F.col("value").alias("_v"), F.col("target").alias(f"share_{k}"))
        cells = cells.join(sized(side), F.col(k) == F.col("_v")).drop("_v").withColumn(f"f_{k}", F.lit(goal / total if total and k == KEYS[0] else 1.0))
    return targeted, materialize((cells.coalesce(1) if small else cells).withColumn("off", F.lit(1.0)), "raked")


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, tolerance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells with rate, the probability of each of their documents, and off, by how much the sample misses a target of theirs; and key, value, tokens, share and target of each value: what was wanted, and what of it can be had.

    targets: key -> (value, share). Values without a target, or with a target of 0, get rate 0. The goal is `share` of all tokens; targets beyond a value's tokens are lowered to
    these (column target), and the goal is lowered, with a warning, while the marginals can't be met together with it. If that doesn't help (targets that contradict each
    other), the sweeps end, and `off` tells.
    """
    cells = materialize(cells, "cells")
    small = cells.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    shares = materialize(_shares(cells, targets or {}), "shares")
    total = shares.where(F.col("key") == KEYS[0]).agg(F.sum("tokens")).first()[0]
    allowed = [r[1] or 0.0 for r in shares.where("share > 0").groupBy("key").agg(F.sum("tokens")).collect()]  # one row for each of KEYS
    goal = min([share * (total or 0.0), *(SLACK * x for x in allowed)]) if len(allowed) == len(KEYS) else 0.0
    first, history = goal, []
    targeted, now = _started(cells, shares, goal, total, small)
    while goal:
        now = _raked_once(now.coalesce(1) if small else now, goal, small)
        now = materialize(now.select(*KEYS, "tokens", *(f"{x}_{k}" for k in KEYS for x in ("share", "f")), "off"), "raked")
        history.append(now.agg(F.max("off")).first()[0] or 0.0)
        if history[-1] <= (TOLERANCE if tolerance is None else tolerance) or goal < LEAST * first:
            break
        if len(history) > STALLED and history[-1] > 0.5 * history[-1 - STALLED]:
            goal, history = goal * FEWER, []
            targeted, now = _started(cells, shares, goal, total, small)
    if goal < first:
        warnings.warn(f"the targets can't be met with {share:.1%} of all tokens: {share * goal / first:.1%} are asked for", stacklevel=2)
    rate = F.least(reduce(lambda a, x: a * F.col(f"f_{x}"), KEYS, F.lit(1.0)), F.lit(1.0))
    return now.select(*KEYS, "tokens", rate.alias("rate"), "off"), targeted


def reached(rated: DataFrame, targets: DataFrame) -> DataFrame:
    """key, value, target and share of each value: of the targets and rated cells of raked(), the share asked for and that of the expected sample."""
    sums = _marginals(rated.select(*KEYS, (F.col("tokens") * F.col("rate")).alias("tokens")))
    total = rated.agg(F.sum(F.col("tokens") * F.col("rate"))).first()[0] or 1.0
    have = sums.select(F.col("key").alias("_key"), F.col("value").alias("_value"), (F.col("tokens") / total).alias("have"))
    return targets.join(sized(have), (F.col("key") == F.col("_key")) & (F.col("value") == F.col("_value")), "left").select("key", "value", "target", F.coalesce("have", F.lit(0.0)).alias("share"))


def _plain(docs: DataFrame, topic: str | None = None) -> dict[str, Column]:
    """What the mixture takes from a document."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return {"source": none("source"), "lang": none("lang"), "topic": none(topic) if topic else topic_of(none("text")), "n_tokens": token_count(none("text"))}


class TargetsNotMet(ValueError):
    """No sample of the documents meets the targets; the message tells the values that miss theirs."""


def cell_rates(rows: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, most_off: float | None = MOST_OFF) -> DataFrame:
    """_source, _lang, _topic and _rate of each cell of rows (source, lang, topic, n_tokens). Given targets that are missed by more than most_off raise TargetsNotMet, unless that is None."""
    rated, wanted = raked(cells_of(rows), targets, share)
    rated = materialize(rated, "rates")
    if targets and most_off is not None and (rated.agg(F.max("off")).first()[0] or 0.0) > most_off:
        gap = F.abs(F.col("share") - F.col("target"))
        missed = reached(rated, wanted).orderBy(gap.desc(), "key", "value").limit(10).collect()
        raise TargetsNotMet("; ".join(f"{r.key} {r.value!r}: {r.share:.4f} of the sample for a target of {r.target:.4f}" for r in missed))
    return rated.select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.col("rate").alias("_rate"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: str = SEED, topic: str | None = None, most_off: float | None = MOST_OFF) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, rate and sampled of every row of docs.

    targets: key -> (value, share) for any of source, lang and topic; the others are tempered. If a given one can't be met up to most_off of the sample, TargetsNotMet is raised. topic: a column that has the topics. Null texts have no tokens; documents without
    tokens are in no cell's total and get the rate of their cell, or 0 where it has none. Null sources, languages and topics are the value "". Rows that repeat a doc_id are
    sampled by the same number. Other columns are ignored. An empty table gives no rows.
    """
    rows = materialize(docs.select("doc_id", *(v.alias(k) for k, v in _plain(docs, topic).items())), "tokens")
    rated = cell_rates(rows, targets, share, most_off)
    joined = rows.join(sized(rated), [F.col(k) == F.col(f"_{k}") for k in KEYS], "left")
    rate = F.coalesce("_rate", F.lit(0.0))
    return joined.select("doc_id", *KEYS, "n_tokens", rate.alias("rate"), (uniform(F.col("doc_id"), seed) < rate).alias("sampled"))


def mixture_report(docs: DataFrame) -> DataFrame:
    """mix() with the rate rounded to 6 places, up to which it doesn't depend on when the sweeps end."""
    return mix(docs).withColumn("rate", F.round("rate", 6))


def sample_mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: str = SEED, topic: str | None = None, most_off: float | None = MOST_OFF) -> DataFrame:
    """docs with the rows that mix() samples; columns stay as they are, whatever their names. An empty table stays empty. Cells are joined to the documents, so there is no list of documents."""
    plain = _plain(docs, topic)
    rated = cell_rates(materialize(docs.select(*(v.alias(k) for k, v in plain.items())), "tokens"), targets, share, most_off)
    rows, name = numbered(docs)
    own = _plain(rows.select("*", *(F.col(name[c]).alias(c) for c in ("source", "lang", "text"))), name[topic] if topic else None)
    marked = rows.select("*", *(F.col(name[c]).alias(c) for c in ("source", "lang", "text"))).select(*rows.columns, uniform(F.col(name["doc_id"]), seed).alias("_u"), *(own[k].alias(k) for k in KEYS))
    kept = marked.join(sized(rated), [F.col(k) == F.col(f"_{k}") for k in KEYS]).where(F.col("_u") < F.col("_rate"))
    return kept.select(*rows.columns).toDF(*docs.columns)


def oracle_sql(sweeps: int = 40) -> str:
    """The same in DuckDB's SQL, for the default targets: each step of the raking is a common table expression, and there are more sweeps than the tolerance takes."""
    split = "[^\\x20\\x09-\\x0D]+"
    lines, count = "(len(t) - len(replace(t, chr(10), '')) + 1)", lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    many = lambda pattern, share: f"len(t) > 0 AND {count(pattern)} >= {share} * len(t)"
    ruled = "len([x for x in string_split(t, chr(10)) if contains(x, '|') OR contains(x, chr(9))])"
    topic = f"""CASE WHEN {ruled} >= {MOST_LINES} * {lines} THEN 'tables' WHEN {count(LIST_LINE)} >= {MOST_LINES} * {lines} THEN 'lists' WHEN {many(SYMBOLS, MANY_SYMBOLS)} THEN 'symbols'
WHEN {many(DIGITS, MANY_DIGITS)} THEN 'numbers' WHEN {many(CAPITALS, MANY_CAPITALS)} THEN 'capitals' ELSE 'prose' END"""
    parts = [
        "base AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents)",
        f"rows AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, CAST(len(regexp_extract_all(t, '{split}')) AS BIGINT) AS n_tokens FROM base)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for k in KEYS:
        parts.append(f"t_{k} AS MATERIALIZED (SELECT value, tokens, w / sum(w) OVER () AS share FROM (SELECT {k} AS value, sum(tokens) AS tokens, sum(tokens) ^ {POWER} AS w FROM cells GROUP BY 1))")
    parts.append(f"g AS MATERIALIZED (SELECT total, least({SHARE}, {SLACK}) * total AS goal FROM (SELECT sum(tokens) AS total FROM cells))")
    for k in KEYS:
        parts.append(f"l_{k}_0 AS (SELECT CAST(1 AS DOUBLE) AS scale)")
        for i in range(15):
            full = f"share * scale >= {SLACK} * tokens / goal"
            parts.append(f"l_{k}_{i + 1} AS MATERIALIZED (SELECT greatest(any_value(scale), coalesce((1 - coalesce(sum({SLACK} * tokens / goal) FILTER ({full}), 0)) / sum(share) FILTER (NOT {full}), 0)) AS scale FROM t_{k}, l_{k}_{i}, g)")
        parts.append(f"a_{k} AS MATERIALIZED (SELECT value, least(share * scale, {SLACK} * tokens / goal) AS share FROM t_{k}, l_{k}_15, g)")
    for k in KEYS:
        parts.append(f"f_{k}_0 AS MATERIALIZED (SELECT value, share, CAST({'goal / total' if k == KEYS[0] else '1'} AS DOUBLE) AS factor FROM a_{k}, g)")
    at = dict.fromkeys(KEYS, 0)
    joined = lambda: "cells " + " ".join(f"JOIN f_{k}_{at[k]} {k[0]} ON {k[0]}.value = cells.{k}" for k in KEYS)
    for _ in range(sweeps):
        for k in KEYS:
            mass = " * ".join(["tokens", *(f"{x[0]}.factor" for x in KEYS if x != k)])
            full = f"{mass} * {k[0]}.factor >= tokens"
            sums = f"SELECT cells.{k} AS v, coalesce(sum(tokens) FILTER ({full}), 0) AS given, coalesce(sum({mass}) FILTER (NOT {full}), 0) AS free FROM {joined()} GROUP BY 1"
            solved = "CASE WHEN goal * share > given AND free > 0 THEN (goal * share - given) / free ELSE factor * goal * share / (given + free * factor) END"
            parts.append(f"f_{k}_{at[k] + 1} AS MATERIALIZED (SELECT value, share, {solved} AS factor FROM f_{k}_{at[k]} JOIN ({sums}) ON v = value, g)")
            at[k] += 1
    parts.append(f"rated AS MATERIALIZED (SELECT source, lang, topic, least({' * '.join(f'{k[0]}.factor' for k in KEYS)}, 1.0) AS rate FROM {joined()})")
    hashed = f"CAST(concat('0x', substr(md5(concat('{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, {HASH_BITS // 4})) AS BIGINT)"
    last = f"SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(rate, 0), 6) AS rate, {hashed} / CAST({1 << HASH_BITS} AS DOUBLE) < coalesce(rate, 0) AS sampled FROM rows LEFT JOIN rated USING (source, lang, topic)"
    return f"WITH {', '.join(parts)} {last}"
