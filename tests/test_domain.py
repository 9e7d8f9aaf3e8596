"""The rules of single rows and small tables, with the values that the domain's own examples use."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.functions import columns as C
from tidebook.functions import params
from tidebook.operators import candles, catalogue, indicators, mutations, news, portfolio, quotes
from tidebook.sources import market

AT = datetime(2026, 3, 9, 12)


def column(spark, values, kind, expression):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(expression(F.col("v"))).collect()]


def test_bullish_and_up(spark):
    changes = [Decimal("2.5"), Decimal("-1.2"), None, Decimal(0), Decimal("0.000001")]
    assert column(spark, changes, "decimal(12,6)", C.is_bullish) == [True, False, False, False, True]
    assert column(spark, changes, "decimal(12,6)", C.is_up) == [True, False, True, True, True]


def test_validity(spark):
    emails = ["user@example.com", "user@mail.example.com", "user+tag@example.com", "first.last@example.com", "josé@example.com", "invalidemail.com", "user@", "user@example", "", "@", None]
    assert column(spark, emails, "string", C.email_valid) == [True] * 5 + [False] * 6
    assert column(spark, ["BTC", "btc", "eTh", "", "BTC1", "BT C", "BT-C", None], "string", C.symbol_valid) == [True] * 3 + [False] * 5
    rows = spark.createDataFrame([("BTC", 1.0), ("", 1.0), ("BTC", -1.0), ("BTC", 0.0), (None, 1.0)], "s string, p double")
    assert [r[0] for r in rows.select(C.asset_valid(F.col("s"), F.col("p"))).collect()] == [True, False, False, True, False]
    rows = spark.createDataFrame([("a@b", "abc"), ("ab", "abc"), ("a@b", "ab"), (None, "abc")], "e string, u string")
    assert [r[0] for r in rows.select(C.user_valid(F.col("e"), F.col("u"))).collect()] == [True, False, False, False]


def test_numbers_and_rendering(spark):
    assert column(spark, ["12.5", "12abc", "abc", "", None, " 7", "-3e2x", ".5", "NaN", "1."], "string", C.number_or_zero) == [12.5, 12.0, 0.0, 0.0, 0.0, 7.0, -300.0, 0.5, 0.0, 1.0]
    caps = [1.28e12, None, 0.0, 5e8]
    assert column(spark, caps, "double", C.billions) == ["$1280.00B", "-", "$0.00B", "$0.50B"]
    assert column(spark, caps, "double", lambda c: C.billions(c, 1, zero_dash=True)) == ["$1280.0B", "-", "-", "$0.5B"]
    assert column(spark, [1234.5, None], "double", C.money) == ["$1,234.50", None]
    assert column(spark, [2.456, -1.2, None], "double", C.signed_percent) == ["+2.46%", "-1.20%", "+0.00%"]
    assert column(spark, ["BTC", "B"], "string", C.badge) == ["BT", "B"]
    assert column(spark, [" a ", "\t\n"], "string", C.stripped) == ["a", ""]


def assets(spark, *rows):
    names = ["id", "symbol", "name", "current_price", "market_cap", "volume_24h", "price_change_24h"]
    kinds = dict(zip(schemas.ASSET.names, (f.dataType.simpleString() for f in schemas.ASSET.fields)))
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds[n]}" for n in names))


D = Decimal


def test_catalogue(spark):
    df = assets(spark, (1, "BTC", "Bitcoin", D(65000), D("1200000000000"), D(0), D("2.5")), (2, "ETH", "Ethereum", D(3200), None, D(5), D(0)), (3, "SOL", "100% Sol_ana", D(150), D(0), None, None))
    assert [r.symbol for r in catalogue.scan(df).collect()] == ["BTC", "ETH", "SOL"]
    assert [catalogue.by_symbol(df, s).count() for s in ("btc", "Btc", "XRP")] == [1, 1, 0]
    assert [r.id for r in catalogue.search(df, "  ETHER ").collect()] == [2]
    assert [catalogue.search(df, q).count() for q in ("", "%", "_", "0% sol_", "%%")] == [3, 1, 1, 1, 0]
    assert [r.symbol for r in catalogue.sort(df).collect()] == ["BTC", "ETH", "SOL"]
    assert [r.symbol for r in catalogue.sort(df, "change", "asc").collect()] == ["ETH", "SOL", "BTC"]
    with pytest.raises(ValueError, match="no such order"):
        catalogue.sort(df, "volume")
    assert catalogue.toggled("price", "desc", "price") == ("price", "asc")
    assert catalogue.toggled("price", "asc", "change") == ("change", "desc")
    assert catalogue.counts(df).first().asDict() == {"total": 3, "bullish": 1, "bearish": 2}
    out = catalogue.contract(df)
    assert out.columns == schemas.ASSET_CONTRACT
    rows = {r.symbol: r for r in out.collect()}
    assert (rows["BTC"].current_price, rows["BTC"].volume_24h, rows["ETH"].price_change_24h, rows["SOL"].market_cap) == ("65000.00000000", None, None, None)
    assert catalogue.entity(assets(spark, (1, "btc", "b", D(0), None, None, None))).first().symbol == "BTC"
    assert catalogue.screen(df).where("symbol = 'SOL'").first().asDict() == {"id": 3, "symbol": "SOL", "badge": "SO", "is_up": True, "is_bullish": False, "market_cap_2dp": "-", "market_cap_1dp": "$0.0B"}


def positions(spark, *rows):
    return spark.createDataFrame(rows, "user_id long, asset_id long, quantity decimal(20,8), purchase_value decimal(20,8), current_value decimal(20,8)")


def test_portfolio(spark):
    df = positions(spark, (1, 1, D(2), D(80000), None), (2, 1, D(1), D(30000), D(36000)), (3, 1, D(0), D(5), D(5)), (4, 1, D(1), D(0), D(9)))
    rows = {r.user_id: r for r in portfolio.with_pnl(df).collect()}
    assert (rows[1].avg_buy_price, rows[1].unrealized_pnl, rows[1].unrealized_pnl_pct) == (40000, None, None)
    assert (rows[2].unrealized_pnl, rows[2].unrealized_pnl_pct) == (6000, 20)
    assert (rows[3].avg_buy_price, rows[4].unrealized_pnl_pct) == (None, None)
    prices = spark.createDataFrame([(1, D(2500))], "asset_id long, price decimal(20,8)")
    marked = portfolio.marked(positions(spark, (1, 1, D(3), D(6000), None), (1, 2, D(3), D(1), None)).drop("current_value"), prices)
    assert {r.asset_id: r.current_value for r in marked.collect()} == {1: 7500, 2: None}
    lots = spark.createDataFrame([(1, 1, 0.5, 18000.0), (2, 2, 0.0, 1.0), (2, 2, None, 1.0)], "user_id long, asset_id long, quantity double, cost double")
    valid, rejected = portfolio.split_lots(lots)
    assert (valid.count(), rejected.count()) == (1, 2)
    held = spark.createDataFrame([(1, 1, 1.0, 30000.0, 36000.0)], "user_id long, asset_id long, quantity double, purchase_value double, current_value double")
    assert portfolio.add_lots(held, valid).first()[2:] == (1.5, 48000.0, 36000.0)


def test_upsert_by_symbol_in_any_case(spark):
    df = spark.createDataFrame([("BTC", D(65000)), ("eth", D(3200))], "symbol string, price decimal(10,0)")
    changes = spark.createDataFrame([("btc", D(70000), 1), ("sol", D(150), 2), ("Btc", D(71000), 3)], "symbol string, price decimal(10,0), seq int")
    assert {tuple(r) for r in mutations.upsert_by_symbol(df, changes, "seq").collect()} == {("BTC", D(71000)), ("ETH", D(3200)), ("SOL", D(150))}


def test_users_are_updated_by_id_or_inserted(spark):
    df = spark.createDataFrame([(1, "a@x.y"), (2, "b@x.y")], "id long, email string")
    changes = spark.createDataFrame([(2, "c@x.y"), (None, "z@x.y"), (None, "d@x.y"), (9, "n@x.y")], "id long, email string")
    assert sorted(map(tuple, mutations.upsert_or_insert(df, changes, "id", "email").collect())) == [(1, "a@x.y"), (2, "c@x.y"), (9, "n@x.y"), (10, "d@x.y"), (11, "z@x.y")]
    assert sorted(map(tuple, mutations.upsert_or_insert(df.limit(0), changes.where("id is null"), "id", "email").collect())) == [(1, "d@x.y"), (2, "z@x.y")]


def test_a_symbol_reaches_the_scans(spark, sf_dir, capsys):
    market.assets(spark, sf_dir, "p17").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(p_partkey,17)" in plan and "EqualTo(l_partkey,17)" in plan
    assert market.assets(spark, sf_dir, "none").count() == 0


def test_changes_of_every_kind(spark, sf_dir):
    changes = [r.price_change_24h for r in market.assets(spark, sf_dir).collect()]
    assert None in changes and 0 in changes and min(c for c in changes if c is not None) < 0 < max(c for c in changes if c is not None)


def test_upsert_and_other_states(spark):
    df = assets(spark, (1, "BTC", "Bitcoin", D(65000), None, None, None)).select("symbol", "current_price")
    changes = spark.createDataFrame([("BTC", D(68000), 1), ("BTC", D(70000), 2), ("ETH", D(3200), 1)], "symbol string, current_price decimal(20,8), seq int")
    assert {tuple(r) for r in mutations.upsert(df, changes, "symbol", "seq").collect()} == {("BTC", D(70000)), ("ETH", D(3200))}
    users = spark.createDataFrame([(1, False), (2, False)], "id long, verified boolean")
    assert {tuple(r) for r in mutations.set_column(users, F.col("id") == 2, "verified", F.lit(True)).collect()} == {(1, False), (2, True)}
    gone = spark.createDataFrame([(1,), (99,)], "id long")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, user_id long")
    left = mutations.delete_cascade(users, {"child": (child, "user_id")}, gone, "id")
    assert [r.id for r in left[""].collect()] == [2]
    assert sorted(r.id for r in left["child"].collect()) == [11, 12]
    assert mutations.duplicate_keys(child.union(child), "id").count() == 3
    assert mutations.or_fallback(users.where("id = 9"), users).count() == 2
    assert mutations.or_fallback(users.where("id = 1"), users).count() == 1


def test_job_states(spark):
    log = [(1, "start", None, 1), (2, "start", None, 1), (2, "complete", "a", 2), (2, "fail", None, 3), (3, "complete", "b", 2), (3, "complete", "c", 5), (4, "note", None, 1), (5, "complete", "d", 1), (5, "start", None, 2)]
    df = spark.createDataFrame(log, "job_id long, action string, result string, order int")
    assert {tuple(r) for r in mutations.job_states(df).collect()} == {(1, "running", None), (2, "failed", "a"), (3, "completed", "c"), (4, "pending", None), (5, "running", "d")}


def test_parameters(spark):
    assert params.within(None, params.CANDLES, "limit") == 120
    for value in (9, 501):
        with pytest.raises(ValueError, match="from 10 to 500"):
            market.synthetic_candles(spark, "BTC", "1h", value, AT)
    with pytest.raises(ValueError, match="interval must be one of"):
        candles.candles(spark.range(1), "2h")
    with pytest.raises(ValueError, match="analysis type"):
        indicators.run_analysis(spark.range(1), "BTC", "VWAP")
    rows = market.synthetic_candles(spark, "xyz", "15m", 10, AT).orderBy("open_time").collect()
    assert (rows[0].close, rows[-1].close, rows[-1].open_time) == ("3300", "3210", datetime(2026, 3, 9, 11, 45))


def test_news(spark):
    items = market.news_items(spark, AT)
    assert news.filtered(items, "  BITCOIN ").count() == 1
    assert [news.filtered(items, sentiment=s).count() for s in ("", "ALL", " negative ", "bad")] == [3, 3, 1, 0]
    assert news.feed(items, "published_at", limit=2).count() == 2
    with pytest.raises(ValueError, match="limit"):
        news.feed(items, "published_at", limit=101)


def ticks(spark, rows):
    return spark.createDataFrame([(i, s, t, p, v) for i, (s, t, p, v) in enumerate(rows)], "event_id long, symbol string, ts timestamp_ntz, price double, volume long")


def at(day, hour, minute=0):
    return datetime(2024, 1, day, hour, minute)


def test_candles_and_ties(spark):
    df = ticks(spark, [("A", at(1, 0, 5), 3.0, 1), ("A", at(1, 0, 5), 2.0, 1), ("A", at(1, 0, 59), 5.0, 2), ("A", at(1, 0, 59), 4.0, 1), ("A", at(1, 1), 9.0, 7), ("B", at(1, 1), 1.0, None)])
    rows = {(r.symbol, r.open_time.hour): r[2:] for r in candles.candles(df).collect()}
    assert rows == {("A", 0): (3.0, 5.0, 2.0, 4.0, 5), ("A", 1): (9.0, 9.0, 9.0, 9.0, 7), ("B", 1): (1.0, 1.0, 1.0, 1.0, None)}
    day, hour = candles.candles(df, "1d"), candles.candles(df)
    assert day.agg(F.sum("volume")).first() == hour.agg(F.sum("volume")).first()
    assert hour.where("low > least(open, close) or high < greatest(open, close)").count() == 0


def test_as_of_over_days(spark):
    df = ticks(spark, [("A", at(1, 10), 1.0, 1), ("A", at(1, 11), 2.0, 1), ("A", at(4, 9), 3.0, 1), ("B", at(2, 0), 7.0, 1)])
    probes = spark.createDataFrame([("A", at(1, 9)), ("A", at(1, 10)), ("A", at(1, 23)), ("A", at(2, 5)), ("A", at(4, 8)), ("A", at(4, 9)), ("A", at(9, 0)), ("B", at(1, 0)), ("C", at(1, 0))], "symbol string, t timestamp_ntz")
    found = {(r.symbol, r.t): r.price for r in quotes.as_of(probes, df, "t", "price").collect()}
    assert list(found[k] for k in sorted(found)) == [None, 1.0, 2.0, 2.0, 2.0, 3.0, 3.0, None, None]


def test_extremes_and_overview(spark):
    df = ticks(spark, [("A", at(1, 1), 5.0, 1), ("A", at(1, 2), 1.0, 1), ("A", at(1, 3), 5.0, 2), ("A", at(1, 4), 1.0, 1)])
    assert quotes.extremes(df).first() == ("A", 5.0, at(1, 1), 1.0, at(1, 2))
    assert quotes.latest(df).first() == ("A", at(1, 4), 1.0, 1)
    rows = spark.createDataFrame([("BTC", 30.0, 1), ("X", 70.0, 2)], "symbol string, market_cap double, volume long")
    assert quotes.overview(rows, "BTC").first() == (100.0, 3, 30.0)
    assert quotes.overview(rows.limit(0), "BTC").first() == (None, None, None)


def test_snapshots_are_appended_by_day(spark, tmp_path):
    df = ticks(spark, [("A", at(1, 1), 4.0, 1), ("A", at(2, 1), 5.0, 1), ("A", at(2, 2), 3.0, 1)])
    rows = quotes.snapshots(candles.candles(df))
    assert [tuple(r)[2:7] for r in rows.orderBy("timestamp").collect()] == [(4.0, 1, 4.0, 4.0, None), (5.0, 1, 5.0, 4.0, 25.0), (3.0, 1, 5.0, 3.0, -25.0)]
    for _ in range(2):
        quotes.append_snapshots(rows, str(tmp_path / "snapshots"))
    assert spark.read.parquet(str(tmp_path / "snapshots")).where("day = '2024-01-02'").count() == 4


def test_indicators(spark):
    closes = [float(x) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 14, 13)]
    df = spark.createDataFrame([("A", datetime(2024, 1, 1 + i), c) for i, c in enumerate(closes)], "symbol string, open_time timestamp_ntz, close double")
    rsi = [r.rsi for r in indicators.rsi(df).orderBy("open_time").collect()]
    assert rsi[:14] == [None] * 14
    assert rsi[14] == 100.0  # no loss yet
    assert rsi[15] == pytest.approx(100 - 100 / (1 + (13 / 14) / (1 / 14)))
    assert [r.sma for r in indicators.sma(df, 3).orderBy("open_time").collect()][:4] == [None, None, 2.0, 3.0]
    assert [r.ema for r in indicators.ema(df, 3).orderBy("open_time").collect()][:3] == [1.0, 1.5, 2.25]
    assert indicators.macd(df).orderBy("open_time").first()[2:] == (0.0, 0.0, 0.0)
    both = indicators.bollinger(df, 3).join(indicators.sma(df, 3), ["symbol", "open_time"])
    assert both.where("middle_band != sma or upper_band < lower_band").count() == 0
    assert indicators.run_analysis(df, "zzz", "RSI").count() == 0
    with pytest.raises(ValueError, match="symbol must have"):
        indicators.run_analysis(df, "x" * 21, "RSI")


def test_alert_stream(spark, sf_dir, tmp_path):
    from tidebook.streaming import prices

    stream = prices.price_alerts(prices.tick_stream(spark, sf_dir), 100.0)
    prices.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == spark.read.parquet(f"{sf_dir}/events.parquet").where("value >= 100").count() > 0
