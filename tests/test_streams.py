import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidebook.operators import quotes
from tidebook.sources.stored import StoredTable
from tidebook.streaming import prices

START = datetime(2024, 1, 1)


def rows(n: int, seed: int) -> list[tuple]:
    """Ticks of three symbols over some days: with gaps of over a day, ties of time, and prices of 0."""
    rng = random.Random(seed)
    out, at = [], START
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 30, 600, 600, 3600, 40 * 3600] if rng.random() < 0.1 else [0, 60, 300, 900]))
        out.append((i, at, rng.choice("aaab") if rng.random() < 0.9 else "c", float(rng.choice([0, 1, 2, 5, 9, 50]))))
    return out


def write(folder, name: str, ticks: list[tuple]) -> None:
    folder.mkdir(exist_ok=True)
    columns = {"event_id": [t[0] for t in ticks], "ts": pa.array([t[1] for t in ticks], pa.timestamp("us")), "user_id": [1] * len(ticks), "event_type": [t[2] for t in ticks], "value": [t[3] for t in ticks], "props": ['{"k": 1}'] * len(ticks)}
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def batch(spark, ticks: list[tuple]):
    return spark.createDataFrame([(i, s.upper(), at, p, 1) for i, at, s, p in ticks], "event_id long, symbol string, ts timestamp_ntz, price double, volume long")


def test_changes_over_restarts(spark, tmp_path):
    """Files that come one after the other, out of order within the lateness, over three runs from one checkpoint: as the batch has it, each tick once."""
    ticks = rows(600, 1)
    own = prices.with_rocksdb(spark)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    rng = random.Random(2)
    for k in range(3):
        for j in range(4):
            part = ticks[(4 * k + j) * 50 : (4 * k + j + 1) * 50]
            rng.shuffle(part)
            write(tmp_path / "in", f"events-{k}-{j}", part)
        stream = prices.tick_stream(own, str(tmp_path / "in"), files_per_trigger=1)
        prices.run_to_parquet(prices.price_changes(stream, 24), out, state)
    found = sorted(map(tuple, spark.read.parquet(out).select("event_id", "symbol", "ts", "price", "earlier", "change_pct").collect()))
    mark = (max(t[1] for t in ticks) - timedelta(minutes=10)).replace(minute=0, second=0)
    wanted = quotes.change(batch(spark, ticks), 24).select("event_id", "symbol", "ts", "price", "earlier", "change_pct")
    assert found == sorted(tuple(r) for r in wanted.collect() if r.ts < mark)
    assert len(found) > 500 and sum(r[4] is None for r in found) > 0 and len({r[0] for r in found}) == len(found)


@pytest.mark.parametrize("hours", [1, 5])
def test_alerts_over_other_spans(spark, tmp_path, hours):
    ticks = rows(300, hours)
    write(tmp_path / "in", "events", ticks)
    stream = prices.change_alerts(prices.tick_stream(prices.with_rocksdb(spark), str(tmp_path / "in")), hours, 100, 50.0)
    prices.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    mark = (max(t[1] for t in ticks) - timedelta(minutes=10)).replace(minute=0, second=0)
    wanted = quotes.alerts(quotes.change(batch(spark, ticks).where(F.col("ts") < F.lit(mark).cast("timestamp_ntz")), hours), 100, 50.0)
    found = spark.read.parquet(str(tmp_path / "out")).select(wanted.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) != []
    assert {r.reason for r in found.collect()} == {"change", "target"}


def test_quotes_survive_a_replay(spark, tmp_path):
    ticks = rows(200, 3)
    table = StoredTable.create(spark.createDataFrame([], prices.QUOTES), str(tmp_path / "quotes"), "symbol", 4)
    for k in (0, 100):
        write(tmp_path / "in", f"events-{k}", ticks[k : k + 100])
        prices.latest_quotes(prices.tick_stream(spark, str(tmp_path / "in")), table, str(tmp_path / "state"))
    wanted = sorted(map(tuple, quotes.latest(batch(spark, ticks)).collect()))
    shown = lambda: sorted(map(tuple, table.read().select("symbol", F.col("ts").cast("timestamp_ntz"), "price", "volume").collect()))
    assert shown() == wanted
    batches = {r.symbol: r.batch for r in table.read().collect()}
    # all batches again, from no checkpoint
    prices.latest_quotes(prices.tick_stream(spark, str(tmp_path / "in"), files_per_trigger=1), table, str(tmp_path / "state2"))
    assert shown() == wanted
    assert {r.symbol: r.batch for r in table.read().collect()}.keys() == batches.keys()
