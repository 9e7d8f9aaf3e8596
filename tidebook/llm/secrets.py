"""Secret scans: passwords, keys and tokens in texts, found by one automaton of all rules (see automaton.py).

Each task scans slices of its texts, joined to one buffer; nothing is shuffled. The automaton is built once from the rules and goes to the workers with the
function, at some 300 KB whatever the data. A text longer than a block is scanned block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.automaton import BETWEEN, Rule, Scanner
from tidebook.llm.common import as_bytes, numbered, slices

#: The rules whose spans the report counts.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further rules: credentials of a known form.
FORMS = (
    Rule("private_key", r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 16),
    Rule("url_login", r"://[A-Za-z0-9_.~%-]+:[A-Za-z0-9_.~%!$&*+=-]+@"),
)
RULES = BASE + FORMS
MASK = "[REDACTED]"


class Span(NamedTuple):
    """A match: number of its rule, and its code points [start, end)."""

    rule: int
    start: int
    end: int


@lru_cache(8)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def found_in(texts: list[bytes], scanner: Scanner) -> list[list[Span]]:
    """Of each text its spans, by start, then in the order of the rules."""
    out: list[list[Span]] = [[] for _ in texts]
    begins = [0, *accumulate(len(t) + 1 for t in texts)]
    spans = scanner.spans(BETWEEN.join(texts))
    owners = np.searchsorted(begins, [s[0] for s in spans], "right") - 1
    for i, mine in groupby(zip(owners.tolist(), spans, strict=True), itemgetter(0)):
        points = np.append(0, np.cumsum((np.frombuffer(texts[i], np.uint8) & 0xC0) != 0x80))  # code points before each byte
        out[i] = [Span(rule, int(points[start - begins[i]]), int(points[end - begins[i]])) for _, (start, rule, end) in mine]
    return out


def written(spans: Iterable[Span], rules: tuple[Rule, ...]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{rules[s.rule].kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span], mask: str = MASK) -> str:
    """The text with a mask in place of each run of overlapping spans."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, kind, start, end of every match of every rule: code points, end exclusive. Null and empty texts have none; repeated rows have theirs each. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in slices(batches, "text"):
            found = found_in(as_bytes(batch, "text"), scanner)
            rows = pa.array([i for i, spans in enumerate(found) for _ in spans], pa.int64())
            flat = [s for spans in found for s in spans]
            columns = [pa.array([rules[s.rule].kind for s in flat], pa.string()), pa.array([s.start for s in flat], pa.int64()), pa.array([s.end for s in flat], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), *columns], names=["doc_id", "kind", "start", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, kind string, start long, end long")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """docs with a mask in place of each secret. Null texts stay null; all other columns stay as they are, whatever their names, and so do rows. An empty table stays empty."""
    rows, name = numbered(docs)
    column = name["text"]
    rows = rows.withColumn(column, F.col(column).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in slices(batches, column):
            found = found_in(as_bytes(batch, column), scanner)
            texts = [redacted(t.as_py(), spans, mask) if spans else t.as_py() for t, spans in zip(batch.column(column), found, strict=True)]
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


REPORT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs.

    base_sha256 is that of the base rules' spans, written as kind:start:end and comma-joined; spans has those of all rules, written alike. Null and empty texts have no spans (and
    the checksum of the empty string). Repeated rows come out as often; a null doc_id stays null. Other columns are ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(RULES)
        for batch in slices(batches, "text"):
            found = found_in(as_bytes(batch, "text"), scanner)
            counts = [pa.array([sum(s.rule == k for s in spans) for spans in found], pa.int64()) for k in range(len(BASE))]
            base = [hashlib.sha256(written((s for s in spans if s.rule < len(BASE)), RULES).encode()).hexdigest() for spans in found]
            every = [written(spans, RULES) for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(c.split()[0] for c in REPORT.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {REPORT}")
