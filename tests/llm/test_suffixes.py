import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm import cases
from tidebook.llm import suffixes as S


def brute(rows):
    """rows: (doc_id, text), a row once for each distinct pair."""
    docs = sorted({(i if i is not None else S.NO_ID, __import__("zlib").crc32((t or "").encode()), (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for key, _, data in docs:
        cover = np.zeros(len(data) + 1, np.int64)
        for at in range(len(data) - S.WINDOW + 1):
            w = data[at : at + S.WINDOW]
            if w in seen:
                cover[at] += 1
                cover[at + S.WINDOW] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[key, data] = (None if key == S.NO_ID else key, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[i if i is not None else S.NO_ID, (t or "").encode()] for i, t in rows), key=repr)


def messy():
    rng = random.Random(11)
    text = lambda n, k=26: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é"[:k]) for _ in range(n))
    shared, period = text(400), text(37)
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "y" * 3000, shared, shared[:150] + text(50) + shared[100:], text(50) + shared, period * 40, text(30) + period * 12]
    texts += [text(700, 2) for _ in range(4)] + [text(300) + shared[i : i + 130] + text(60) for i in range(0, 120, 17)]
    texts += ["é" * 120, "a" + "é" * 120, text(5000), "ab" * 300, "ba" * 200 + "c" + "ab" * 150]
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, shared), (None, text(120)), (4, shared[:200])]


def with_bound(run, wide):
    """run() with the bound of a wide bucket set in the worker too."""

    def bounded(batches):
        from tidebook.llm import suffixes

        suffixes.WIDE, old = wide, suffixes.WIDE
        try:
            yield from run(batches)
        finally:
            suffixes.WIDE = old

    return bounded


@pytest.mark.parametrize("wide", [S.WIDE, 3, 1])
def test_messy_rows_as_brute_force(spark, wide, monkeypatch):
    rows = messy()
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(S, "WIDE", wide)
    monkeypatch.setattr(S, "_sorted_buckets", with_bound(S._sorted_buckets, wide))
    assert cases.rows_of(S.removals(docs)) == brute(rows)


def test_given_documents_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert cases.rows_of(S.removals(docs)) == brute([tuple(r) for r in docs.collect()])


def test_small_pieces_change_nothing(spark):
    text = cases.LONG[:60_000] + " " + cases.LONG[5_000:40_000]
    rows = [(1, text), (2, text[10_000:30_000]), (3, text[::-1])]
    old = S.PIECE
    S.PIECE = 7_001
    try:
        pieces = [(t, first) for batch in [__import__("pyarrow").RecordBatch.from_pydict({"text": [t for _, t in rows]})] for texts, firsts, _ in S._pieces(batch) for t, first in zip(texts, firsts)]
        assert max(len(t) for t, _ in pieces) <= 7_001 + S.WINDOW
    finally:
        S.PIECE = old
    assert cases.rows_of(S.removals(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_texts_are_cut_and_columns_stay(spark):
    passage = " ".join(f"passage{i}" for i in range(30))
    docs = spark.createDataFrame([(1, passage, 5), (2, f"before {passage} after", 6), (3, None, 7)], "doc_id long, text string, n long")
    found = {r.doc_id: r.text for r in S.remove_repeats(docs).collect()}
    assert found == {1: passage, 2: "before  after", 3: None}
    assert S.remove_repeats(docs).columns == docs.columns


@pytest.mark.parametrize("classes", [1, 2, 23, 24, 25, 26, 60])
def test_many_windows_that_tie_on_their_first_bytes(classes):
    rng = np.random.default_rng(classes)
    heads = rng.integers(97, 123, 40).astype(np.uint8)
    windows = [np.concatenate([heads, rng.integers(97, 123, S.WINDOW - 40).astype(np.uint8)]) for _ in range(classes)]
    picks = [*range(classes), *rng.integers(0, classes, 80).tolist()]
    text = np.concatenate([*(windows[k] for k in picks), np.zeros(S.WINDOW + 16, np.uint8)])
    at = np.arange(len(picks)) * S.WINDOW
    seen, wanted = set(), []
    for k in picks:
        wanted.append(k in seen)
        seen.add(k)
    assert S.repeated_windows(text, at).tolist() == wanted


def test_difference_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
    assert len(S.COVER) == 6


def test_empty_table(spark):
    assert S.removals(cases.empty(spark)).count() == 0
    assert S.remove_repeats(cases.empty(spark)).count() == 0


def test_clashing_columns_stay(spark):
    passage = " ".join(f"passage{i}" for i in range(30))
    names = ["doc_id", "text", "key", "_key", "_crc", "start", "stop", "_of", "pos"]
    docs = spark.createDataFrame([(1, passage, 1, "a", 2, 3, 4, 5, 6), (2, f"b {passage} a", 7, "b", 8, 9, 10, 11, 12)], ", ".join(f"{n} {'string' if n in ('text', '_key') else 'long'}" for n in names))
    out = S.remove_repeats(docs)
    assert out.columns == names
    assert sorted(map(tuple, out.collect())) == [(1, passage, 1, "a", 2, 3, 4, 5, 6), (2, "b  a", 7, "b", 8, 9, 10, 11, 12)]


def test_strings_of_equal_polynomial_hash_are_told_apart(spark):
    """Thue-Morse strings, which any polynomial modulo a power of two takes for equal."""
    a, b = ("".join(x if bin(i).count("1") % 2 else y for i in range(2048)) for x, y in ("ab", "ba"))
    rows = [(1, f"1{a}2"), (2, f"3{b}4"), (3, f"5{a[:1500]}6")]
    assert cases.rows_of(S.removals(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_a_text_of_several_pieces_through_spark(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(2 * S.PIECE + 10_000))
    rows = [(1, text), (2, text[S.PIECE - 500 : S.PIECE + 500] + "tail"), (3, "x" + text[-400:])]
    found = {r.doc_id: r for r in S.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(found[i].n_bytes, found[i].n_removed, found[i].n_spans) for i in (1, 2, 3)] == [(len(text), 0, 0), (1004, 1000, 1), (401, 400, 1)]


@pytest.mark.parametrize("size", [100, 101, 333, 4000])
def test_windows_of_a_text(size):
    """Few letters and long repeats, in suffix buckets of any size."""
    rng = np.random.default_rng(size)
    text = rng.integers(97, 99, size).astype(np.uint8)
    text[size // 2 :] = text[: size - size // 2]
    at = rng.permutation(size - S.WINDOW + 1)
    seen, wanted = set(), []
    for k in at:
        wanted.append((w := text[k : k + S.WINDOW].tobytes()) in seen)
        seen.add(w)
    old = S.BUCKET
    for S.BUCKET in (1, 50, old):
        assert S.repeated_windows(text, at).tolist() == wanted


def test_equal_checksums_tell_no_document(spark):
    """Different texts of one doc_id, or of none, with one CRC-32."""
    rng, seen, pair = random.Random(5), {}, None
    base = "".join(rng.choice("abcdefgh ") for _ in range(120))
    while pair is None:
        text = base + "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        pair = (other, text) if other != text else None
    shared = next(i for i in range(130) if pair[0][: i + 1] != pair[1][: i + 1])
    for doc_id in (7, None):
        rows = [(doc_id, pair[0]), (doc_id, pair[1]), (3, "x" * 50)]
        found = S.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r.n_removed for r in found) == [0, 0, shared]
        assert [r.doc_id for r in found if r.n_removed] == [doc_id]
    again = [(7, pair[0])] * 3 + [(7, pair[1])] * 2
    assert sorted(r.n_removed for r in S.removals(spark.createDataFrame(again, "doc_id long, text string")).collect()) in ([0, 0, 0, shared, shared], [0, 0, shared, shared, shared])


def test_the_greatest_doc_id_is_not_null(spark):
    text = "".join(random.Random(6).choices("abcdefgh ", k=150))
    rows = [(S.NO_ID, text), (None, text), (None, "short")]
    found = {(r.doc_id, r.n_bytes): r.n_removed for r in S.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(S.NO_ID, 150): 0, (None, 150): 150, (None, 5): 0}
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    assert sorted((r.n, r.text) for r in S.remove_repeats(docs).collect()) == [(0, text), (1, ""), (2, "short")]
