"""Quality classifier: ordinal regression on graded ratings, as a cumulative link model.

A text is a set of hashed features: its words, their beginnings, and their last bytes. One weight vector, shared by all grades, gives a
text's place on one line; ordered thresholds cut the line into grades: P(grade >= k) = logistic(place - threshold k). It is fitted
by L-BFGS (Liu and Nocedal, 1989) over all rated texts: their features are written once, and each evaluation of loss and gradient is a job over
them. The weights, one vector of fixed size, are broadcast; the tasks' gradients are summed slice by slice on the executors, and one vector comes back.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import as_bytes, materialize, sized, slices
from tidebook.llm.rolling import Roller, mixed

BITS = 18
SIZE = 1 << BITS
#: Grades: 0 harmful, 1 poor, 2 good.
GRADES = 3
RIDGE, ROUNDS, MEMORY = 3.0, 30, 8
#: A text is kept if the top grade has at least this probability.
LEAST = 0.4
#: Slices in which gradients are summed; tasks whose slices are summed at once.
SLICES, FAN = 8, 64
#: Bytes of a word's beginnings and ending that are features.
HEADS, TAIL = (3, 5, 7), 3
PIECE = 2 << 20

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LETTER = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_U = np.uint64


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features (below SIZE) of all texts, one text after the other, and how many each text has. Feature 0 is in every text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    lower = Roller(_LOWER[data])
    start, stop = _runs(_LETTER[data])
    raw_start, raw_stop = _runs(~_SPACE[data])
    kinds = [(start, stop)] + [(start, np.minimum(start + k, stop)) for k in HEADS] + [(np.maximum(raw_stop - TAIL, raw_start), raw_stop)]
    hashes, owners = [], []
    for kind, (a, b) in enumerate(kinds):
        h = mixed(lower.of(a, b) + _U((kind + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        hashes.append(h >> _U(64 - BITS))
        owners.append(np.searchsorted(ends, a, "right"))
    everyone = np.arange(len(texts))
    key = np.concatenate([np.concatenate(owners).astype(np.int64) << BITS | np.concatenate(hashes).astype(np.int64), everyone << BITS])
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    return (key & (SIZE - 1)).astype(np.int32), np.bincount(key >> BITS, minlength=len(texts))


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in slices(batches, "text", PIECE):
        if batch.num_rows:
            yield batch, *features(as_bytes(batch, "text"))


def _write_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, found, counts in _in_pieces(batches):
        stops = np.cumsum(counts)
        rows = [found[a:b].tobytes() for a, b in zip(stops - counts, stops, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(rows, pa.binary())], names=["grade", "features"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then logarithms of the steps."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def tails(place: np.ndarray, free: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ...; one row for each place."""
    return sigmoid(place[:, None] - thresholds_of(free)[None, :])


def loss_and_slopes(place: np.ndarray, grade: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed negative log-likelihood, its derivative by each place, and by the free numbers."""
    cut = np.concatenate([[-np.inf], thresholds_of(free), [np.inf]])
    upper, lower = (sigmoid(place - cut[grade + d]) for d in (0, 1))  # P(>= grade), P(> grade)
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_cut = np.zeros(len(cut))
    np.add.at(by_cut, grade, du)
    np.add.at(by_cut, grade + 1, -dl)
    by_threshold = by_cut[1:-1]
    by_free = np.concatenate([[by_threshold.sum()], [by_threshold[k:].sum() * np.exp(free[k]) for k in range(1, len(free))]])
    return float(-np.log(p).sum()), dl - du, by_free


PART = "slice int, salt int, gradient binary, rest binary"
REST = SLICES


def _part(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """Slices of gradients in single precision, and under the number REST the other sums in double precision."""
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())]
    data = [[x.astype(np.float32).tobytes() if k < REST else b"" for k, _, x in rows], [x.tobytes() if k == REST else b"" for k, _, x in rows]]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(d, pa.binary()) for d in data)], names=["slice", "salt", "gradient", "rest"])


def _total(rows: pa.Table) -> tuple[int, np.ndarray]:
    k = rows.column("slice")[0].as_py()
    parts = rows.column("gradient" if k < REST else "rest").to_pylist()
    return k, sum((np.frombuffer(x, np.float32 if k < REST else np.float64) for x in parts), np.zeros(1))


def _summed(rows: pa.Table) -> pa.Table:
    k, x = _total(rows)
    return pa.Table.from_batches([_part([(k, rows.column("salt")[0].as_py(), x)])])


class _Objective:
    """Loss and gradient over the written features; each call is one job."""

    def __init__(self, rated: DataFrame):
        self.rated, self.spark = rated, rated.sparkSession
        self.n, tasks = rated.select(F.spark_partition_id().alias("task")).agg(F.count("*"), F.max("task")).first()
        self.tasks = 1 + (tasks or 0)

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = self.spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, free = shared.value[:SIZE], shared.value[SIZE:]
            gradient, rest = np.zeros(SIZE), np.zeros(len(free) + 1)
            for batch in batches:
                rows = batch.column("features").to_pylist()
                if not rows:
                    continue
                found, counts = np.frombuffer(b"".join(rows), np.int32), np.array([len(r) // 4 for r in rows])
                place = np.add.reduceat(w[found], np.cumsum(counts) - counts)
                lost, slope, by_free = loss_and_slopes(place, batch.column("grade").to_numpy().astype(np.int64), free)
                gradient += np.bincount(found, np.repeat(slope, counts), SIZE)
                rest += np.append(by_free, lost)
            salt = TaskContext.get().partitionId() // FAN
            yield _part([*((k, salt, g) for k, g in enumerate(np.split(gradient, SLICES))), (REST, salt, rest)])

        sums, tasks = self.rated.mapInArrow(run, PART), self.tasks
        while True:
            sums = sums.groupBy("slice", "salt").applyInArrow(_summed, PART)
            if tasks <= FAN:
                break
            tasks = -(-tasks // FAN)
            sums = sums.withColumn("salt", F.expr(f"salt div {FAN}").cast("int"))
        total = np.zeros(len(x) + 1)
        for row in sums.toArrow().to_pylist():  # one row for each slice
            k = row["slice"]
            if k < REST:
                total[k * SIZE // SLICES : (k + 1) * SIZE // SLICES] = np.frombuffer(row["gradient"], np.float32)
            else:
                total[SIZE:] = np.frombuffer(row["rest"])
        shared.destroy()
        ridge = np.concatenate([np.full(SIZE, RIDGE), np.zeros(len(x) - SIZE)])
        return (total[-1] + 0.5 * float(ridge @ (x * x))) / self.n, (total[:-1] + ridge * x) / self.n


def lbfgs(f, x: np.ndarray, rounds: int = ROUNDS, memory: int = MEMORY, tolerance: float = 1e-4) -> np.ndarray:
    """Minimiser of a smooth function that returns value and gradient; steps are halved until the value falls enough."""
    value, g = f(x)
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        step, fall = 1.0, g @ q
        for _ in range(12):
            new = x - step * q
            new_value, new_g = f(new)
            if new_value <= value - 1e-4 * step * fall:
                break
            step /= 2
        else:
            return x
        if (new - x) @ (new_g - g) > 1e-12:
            pairs.append((new - x, new_g - g))
        settled = value - new_value < tolerance * abs(value)
        x, value, g = new, new_value, new_g
        if settled:
            break
    return x


class Model:
    def __init__(self, weights: np.ndarray, free: np.ndarray):
        self.weights, self.free = weights, free


def train(rated: DataFrame) -> Model:
    """rated: text and grade (0 to GRADES - 1); rows with another grade, or none, are left out. Without rows all weights are 0."""
    known = rated.where(F.col("grade").between(0, GRADES - 1)).select("text", F.col("grade").cast("int"))
    written = materialize(known.mapInArrow(_write_features, "grade int, features binary"), "features")
    counts = {r.grade: r[1] for r in written.groupBy("grade").count().collect()}
    total = sum(counts.values())
    if not total:
        return Model(np.zeros(SIZE), np.array([-1.0, 0.0]))
    # start from the grades' shares
    above = [(sum(n for g, n in counts.items() if g >= k) + 1) / (total + 2) for k in range(1, GRADES)]
    cut = np.array([-np.log(a / (1 - a)) for a in above])
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 0.1))])
    x = lbfgs(_Objective(written), np.concatenate([np.zeros(SIZE), free]))
    return Model(x[:SIZE].copy(), x[SIZE:].copy())


def grade_of(quality, toxic):
    """The grade of a rating: harmful 0, poor 1, good 2; null if neither is known."""
    return F.when(toxic == 1, 0).when(quality == 1, 2).when(quality == 0, 1)


def score(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the top grade), harmful_probability and kept of each row; no shuffle. A null text has no features but that of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.free))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, free = shared.value
        for batch, found, counts in _in_pieces(batches):
            tail = tails(np.add.reduceat(weights[found], np.cumsum(counts) - counts), free)
            columns = [tail.sum(axis=1), tail[:, -1], 1 - tail[:, 0], tail[:, -1] >= least]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "expected_grade", "tail_probability", "harmful_probability", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, harmful_probability double, kept boolean")


def rated_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and grade of the documents that have a label; a document with several labels counts with each, one without doc_id not at all."""
    marks = labels.select(F.col("doc_id").alias("_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade")).where("grade is not null")
    return docs.select("doc_id", "text").join(sized(marks), F.col("doc_id") == F.col("_id")).select("text", "grade")


def classify(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """score() of all docs by a model of all rated ones. Other columns are ignored; an empty table gives no rows."""
    return score(docs, train(rated_documents(docs, labels)), least)
