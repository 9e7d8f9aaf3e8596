"""Phrase collocations: word sequences that occur together more often than their parts would.

Counts come from suffix arrays over word ids (Manber and Myers, 1993). Each shard, some megabytes of text, gives its words ids, sorts its suffixes by prefix doubling up
to the phrases' length, and takes the longest common prefixes of neighbours: an interval of suffixes that share m words is a phrase of m words, and its width the
count. A shard so hands on each of its phrases once, however often it has it, and the shards' counts are summed by language and phrase.

No phrase is more frequent than its parts (Agrawal and Srikant, 1994). So words are counted first, then phrases of two words, and so on: words too rare for any candidate end a piece, and
phrases with a part too rare aren't handed on. Most phrases of a corpus occur once, and most of these have a rare part. Workers know the frequent ones by bitmaps of fixed size; a rare one that they
take for frequent costs a row and changes no result.

Scores are whole numbers, exact beyond 64 bits. All joins are by language and phrase; the counts of frequent phrases are broadcast if they are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import as_bytes, materialize, sized, slices

#: Bytes of text in a shard.
SHARD = 2 << 20
#: Rows of a batch that a shard hands on.
ROWS = 1 << 16
#: Candidates: their number of words, and of occurrences.
WORDS, LEAST = (2, 3), 10
#: A candidate goes if a longer one that it is part of has this share of its occurrences, in percent.
ABSORBED = 50
TOP = 2000
SCALE = 1_000_000
UNKNOWN = "und"
#: Size of a bitmap of frequent phrases: 4 MB.
BITS = 1 << 25
#: Tasks that rank parts of a language, before the first of each are ranked together.
SALTS = 64

#: A piece ends at . , ; : ! ? and U+000A to U+000D, here all made \n; words end at spaces and tabs; A-Z become a-z.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_BREAK, _SPACE = 10, 32

COUNTS = "lang string, words int, phrase string, n long"


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids sorted by the words from there on, up to `depth` of them (or somewhat more) and to the end of their piece. left: words to that end."""
    rank, known = ids.astype(np.int64), 1
    while known < depth:
        more = left > known
        pair = rank * (int(rank.max(initial=0)) + 2)
        at = np.flatnonzero(more)
        pair[at] += rank[at + known] + 1
        rank = np.unique(pair, return_inverse=True)[1]
        known *= 2
        if len(rank) and rank.max() == len(rank) - 1:
            break
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, left: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix and the one before it in order: how many words they share, up to `depth`; 0 for the first."""
    out = np.zeros(len(suffixes), np.int8)
    a, b = suffixes[:-1], suffixes[1:]
    same = np.ones(len(b), bool)
    for m in range(depth):
        same &= (left[a] > m) & (left[b] > m)
        at = np.flatnonzero(same)
        same[at] = ids[a[at] + m] == ids[b[at] + m]
        out[1:] += same
    return out


def intervals(left: np.ndarray, suffixes: np.ndarray, shared: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the number of occurrences of each phrase of so many words: runs of suffixes that share them."""
    heads = np.flatnonzero(shared < words)
    n = np.diff(np.append(heads, len(suffixes)))
    whole = left[suffixes[heads]] >= words
    return suffixes[heads[whole]], n[whole]


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of plain texts in order, the number of each one's text, and how many words are left in its piece."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    inner = (data != _BREAK) & (data != _SPACE)
    starts = np.flatnonzero(inner & ~np.append(False, inner[:-1]))
    stops = np.flatnonzero(inner & ~np.append(inner[1:], False)) + 1
    offsets = np.append(0, np.cumsum(stops - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inner])])
    piece = np.searchsorted(np.flatnonzero(data == _BREAK), starts)
    ends = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) + 1 if len(piece) else piece
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(starts))
    begins = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    return words, np.searchsorted(begins, starts, "right") - 1, left


class Shard:
    """The words of some plain texts, numbered by language and word."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        words, owner, self.left = _words(texts)
        coded = words.dictionary_encode()
        self.names, self.index = coded.dictionary, coded.indices.to_numpy()
        self.kinds = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.kinds)}
        self.lang = np.array([number[x] for x in langs], np.int64)[owner]
        _, self.first, self.ids, self.times = np.unique(self.lang * len(self.names) + self.index, return_index=True, return_inverse=True, return_counts=True)

    def phrases(self, words: int, places: np.ndarray) -> pa.Array:
        parts = [self.names.take(pa.array(self.index[places + i])) for i in range(words)]
        return pc.binary_join_element_wise(*parts, " ") if words > 1 else parts[0]

    def rows(self, words: int, places: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of COUNTS of the phrases of so many words from these places on."""
        told = pa.array(self.kinds, pa.string())
        for k in range(0, len(places), ROWS):
            at, n = places[k : k + ROWS], counts[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([told.take(pa.array(self.lang[at])), pa.array(np.full(len(at), words, np.int32)), self.phrases(words, at), pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "n"])

    def word_counts(self) -> Iterator[pa.RecordBatch]:
        yield from self.rows(1, self.first, self.times)

    def _frequent(self, words: int, places: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        """Whether the bitmap has the phrases of so many words from these places on."""
        seeds = [xxhash.xxh64_intdigest(k, 42) for k in self.kinds]
        bits = np.fromiter((xxhash.xxh64_intdigest(w, seeds[x]) & (BITS - 1) for w, x in zip(self.phrases(words, places).to_pylist(), self.lang[places].tolist(), strict=True)), np.int64, len(places))
        return (bitmap[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) > 0

    def phrase_counts(self, words: int, bitmaps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Every phrase of so many words whose words, and whose parts one word shorter, are frequent by the first and the last bitmap."""
        kept = np.flatnonzero(self._frequent(1, self.first, bitmaps[0])[self.ids])
        if not len(kept):
            return
        # a word left out ends the piece before it
        together = np.append((np.diff(kept) == 1) & (self.left[kept[:-1]] > 1), False)
        ends = np.flatnonzero(~together) + 1
        left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(kept))
        ids = self.ids[kept]
        suffixes = suffix_array(ids, left, words)
        shared = common_prefixes(ids, left, suffixes, words)
        places, counts = intervals(left, suffixes, shared, words)
        if words > 2:
            heads = np.flatnonzero(shared < words - 1)
            told = left[suffixes[heads]] >= words - 1
            told[told] = self._frequent(words - 1, kept[suffixes[heads[told]]], bitmaps[-1])
            known = np.empty(len(kept), bool)
            known[suffixes] = np.repeat(told, np.diff(np.append(heads, len(suffixes))))
            some = known[places] & known[places + 1]
            places, counts = places[some], counts[some]
        yield from self.rows(words, kept[places], counts)


def _cut(texts: list[bytes], langs: list[str]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Plain texts and languages; a text longer than a shard in parts, cut where pieces end."""
    if max(map(len, texts), default=0) <= SHARD:
        yield texts, langs
        return
    for text, lang in zip(texts, langs, strict=True):
        at = 0
        while at < len(text):
            stop = len(text) if len(text) - at <= SHARD else text.rfind(b"\n", at, at + SHARD)
            stop = text.find(b"\n", at + SHARD) if stop < 0 else stop
            stop = len(text) if stop < 0 else stop
            yield [text[at:stop]], [lang]
            at = stop + 1


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in slices(batches, "text", SHARD):
        for texts, langs in _cut([t.translate(_PLAIN) for t in as_bytes(batch, "text")], batch.column("lang").to_pylist()):
            yield Shard(texts, langs)
            pa.default_memory_pool().release_unused()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, words (1), phrase and n of each word, by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            yield from shard.word_counts()

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def bitmap_of(phrases: DataFrame) -> np.ndarray:
    """BITS bits, of which each phrase's (by its language and its hash) is set. What comes to the driver is bounded by the bits."""
    bit = F.xxhash64("lang", "phrase").bitwiseAND(F.lit(BITS - 1))
    told = phrases.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(xxhash64(lang, phrase) & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[told.column("at").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
    return out


def _longer(docs: DataFrame, words: int, bitmaps: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            yield from shard.phrase_counts(words, [b.value for b in bitmaps])

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int = LEAST, most: int = WORDS[1]) -> tuple[DataFrame, DataFrame]:
    """Two tables (lang, words, phrase, n): of every word; and of each phrase of 1 to `most` words that occurs `least` times or more within pieces. docs: lang, text, which is read once for each length."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    words = materialize(word_counts(docs), "words")
    every = frequent = words.where(F.col("n") >= least)
    bitmaps: list = []
    for m in range(2, most + 1):
        bitmaps.append(docs.sparkSession.sparkContext.broadcast(bitmap_of(frequent)))
        frequent = materialize(_longer(docs, m, bitmaps).where(F.col("n") >= least), "phrases")
        every = every.union(frequent)
    return words, every


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a^2 / (l * r)) in 128 bits, for counts up to 10^15. At most SCALE, as no phrase is more frequent than its parts."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", (wide(a) * wide(a)) * F.lit(SCALE).cast("decimal(7,0)"), wide(left) * wide(right))


def _first(k: Column | int) -> Column:
    return F.array_join(F.slice("_w", 1, k), " ")


def scored(phrases: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, a, l, r and score of each candidate; phrases: the counts, of all parts of candidates too. A candidate is as good as its lowest-scoring cut in two, the first of several."""
    candidates = phrases.where((F.col("words") >= WORDS[0]) & (F.col("n") >= least)).withColumn("_w", F.split("phrase", " ", -1))
    cuts = candidates.select("lang", "words", "phrase", F.col("n").alias("a"), "_w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", _first(F.col("k")).alias("_l"), F.array_join(F.expr("slice(_w, k + 1, words - k)"), " ").alias("_r"))
    for side, out in (("_l", "l"), ("_r", "r")):
        of = phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias(out))
        cuts = cuts.join(sized(of), (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))).drop("_lang", "_phrase")
    least_cut = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "words", "phrase", "a").agg(least_cut.alias("_c")).select("lang", "words", "phrase", "a", "_c.l", "_c.r", "_c.score")


def absorbed(candidates: DataFrame) -> DataFrame:
    """lang and phrase of the candidates (with a) that a longer one has as a part and ABSORBED percent of their occurrences."""
    longer = candidates.where(F.col("words") > WORDS[0]).select("lang", F.col("a").alias("_a"), "words", F.split("phrase", " ", -1).alias("_w"))
    parts = longer.select("lang", "_a", "_w", "words", F.explode(F.expr(f"sequence({WORDS[0]}, words - 1)")).alias("_m"))
    parts = parts.select("lang", "_a", "_w", "_m", F.explode(F.expr("sequence(1, words - _m + 1)")).alias("_i"))
    most = parts.groupBy(F.col("lang").alias("_lang"), F.array_join(F.expr("slice(_w, _i, _m)"), " ").alias("_phrase")).agg(F.max("_a").alias("_most"))
    both = candidates.join(most, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")))
    return both.where(100 * F.col("_most") >= ABSORBED * F.col("a")).select("_lang", "_phrase")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, most: int = WORDS[1]) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to `most` words: those that occur `least` times, less those that a longer one absorbs; by
    score, then a, both downwards, then phrase in the order of UTF-8 bytes.

    A null text is empty, a null language is UNKNOWN. Repeated rows count as often as they occur. Languages without a candidate, and empty tables, give no rows. Other columns are ignored. A text is cut
    where pieces end into parts of SHARD bytes, so only a single longer piece needs more memory than that.
    """
    words, phrases = phrase_counts(docs, least, most)
    candidates = materialize(scored(phrases, least), "candidates")
    kept = candidates.join(absorbed(candidates), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rank = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    best = rank(rank(kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), "lang", "_salt"), "lang")  # at most SALTS * top rows of a language meet
    totals = words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n"))
    return best.join(sized(totals), F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    plain = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(f"SELECT lang, {m} AS words, unnest([array_to_string(ws[i:i + {m - 1}], ' ') for i in range(1, len(ws) - {m - 2})]) AS phrase FROM w" for m in range(1, WORDS[1] + 1))
    cuts = " UNION ALL ".join(
        f"SELECT lang, words, phrase, n AS a, {k} AS k, array_to_string(string_split(phrase, ' ')[1:{k}], ' ') AS left_, array_to_string(string_split(phrase, ' ')[{k + 1}:], ' ') AS right_ FROM f WHERE n >= {LEAST} AND words > {k}" for k in range(1, WORDS[1])
    )
    inside = " OR ".join(f"array_to_string(string_split(y.phrase, ' ')[{i}:{i + 1}], ' ') = x.phrase" for i in range(1, WORDS[1]))
    return f"""WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array({plain}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS ws FROM p),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS n FROM ({grams}) GROUP BY ALL),
c AS (SELECT x.lang, x.words, x.phrase, x.a, x.k, l.n AS l, r.n AS r, CAST(CAST({SCALE} AS HUGEINT) * x.a * x.a // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM ({cuts}) x JOIN f l ON l.lang = x.lang AND l.phrase = x.left_ JOIN f r ON r.lang = x.lang AND r.phrase = x.right_),
best AS MATERIALIZED (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT x.lang, x.phrase FROM best x JOIN best y ON x.lang = y.lang AND x.words = {WORDS[0]} AND y.words = {WORDS[1]} AND 100 * y.a >= {ABSORBED} * x.a AND ({inside})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, CAST(total AS BIGINT) AS n, score FROM ranked JOIN (SELECT lang, sum(n) AS total FROM f WHERE words = 1 GROUP BY 1) USING (lang) WHERE rank <= {TOP}"""
