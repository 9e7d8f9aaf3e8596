import pytest
from pyspark.sql import functions as F

from tests.oracle import duck
from tidebook.operators import catalogue, jobs, mutations
from tidebook.plans.registry import ASSETS, QUERIES
from tidebook.sources import files, market

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_a_database_round_trip(spark, tmp_path, capsys):
    """Written and read by several tasks; a filter on a column goes to the database."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1, 1001).select("id", F.concat(F.lit("user"), "id").alias("name"), (F.col("id") * 1.5).alias("balance"))
    market.write_jdbc(rows.repartition(4), url, "users", driver=DERBY)
    back = market.jdbc_table(spark, url, "users", "id", (1, 1000), 4, driver=DERBY)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in rows.collect())
    back.where("balance > 1490").explain("formatted")
    assert "GreaterThan(BALANCE" in capsys.readouterr().out.upper().replace("GREATERTHAN", "GreaterThan")
    market.write_jdbc(rows.limit(10), url, "users", driver=DERBY)
    assert market.jdbc_table(spark, url, "users", "id", (1, 1000), 4, driver=DERBY).count() == 1010


def test_records_that_do_not_fit(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, price double, name string").schema
    (tmp_path / "a.csv").write_text('1,2.5,x\n2,oops,y\n3,,z\n,1.0,w\n4,1.0\n5,1.5,"a, b"\n')
    accepted, rejected = files.read_checked(spark, str(tmp_path / "a.csv"), schema, required=("id", "price"))
    assert sorted(tuple(r) for r in accepted.collect()) == [(1, 2.5, "x"), (5, 1.5, "a, b")]
    found = {(r.record, r.reason) for r in rejected.collect()}
    assert ("2,oops,y", "malformed") in found and ("4,1.0", "malformed") in found
    assert {r for _, r in found} == {"malformed", "incomplete"} and len(found) == 4
    (tmp_path / "b.json").write_text('{"id": 1, "price": 2, "name": "x"}\n{"id": "a"}\n{broken\n{"id": 3}\n')
    accepted, rejected = files.read_checked(spark, str(tmp_path / "b.json"), schema, "json", ("id", "price"))
    assert [tuple(r) for r in accepted.collect()] == [(1, 2.0, "x")]
    assert sorted(r.reason for r in rejected.collect()) == ["incomplete", "malformed", "malformed"]
    with pytest.raises(ValueError, match="no such kind"):
        files.read_checked(spark, "x", schema, "xml")


@pytest.mark.parametrize(("field", "direction", "order"), [("marketCap", "desc", "coalesce(market_cap, 0) DESC"), ("change", "asc", "coalesce(price_change_24h, 0)"), ("symbol", "desc", "symbol DESC")])
def test_all_pages_are_the_whole_order(spark, sf_dir, field, direction, order):
    assets = market.assets(spark, sf_dir).cache()
    pages, after = [], None
    while rows := catalogue.page_after(assets, 60, field, direction, after).collect():
        pages.append([r.id for r in rows])
        after = (rows[-1][catalogue.SORTS[field]] or (0 if field != "symbol" else ""), rows[-1].symbol, rows[-1].id)
    assets.unpersist()
    wanted = [r[0] for r in duck(sf_dir).execute(f"WITH {ASSETS} SELECT id FROM assets ORDER BY {order}, symbol, id").fetchall()]
    assert [i for p in pages for i in p] == wanted and {len(p) for p in pages[:-1]} == {60}


def test_order_and_search_of_a_locale(spark):
    names = ["beta", "Alpha", "älter", "alpha", "Zulu", "éclair", "Eclair", "zebra"]
    df = spark.createDataFrame([(i, n, f"x {n}") for i, n in enumerate(names)], "id long, symbol string, name string")
    assert [r.symbol for r in catalogue.sort_locale(df).collect()] == ["alpha", "Alpha", "älter", "beta", "Eclair", "éclair", "zebra", "Zulu"]
    assert {r.symbol for r in catalogue.search_locale(df, " ECLAIR ").collect()} == {"éclair", "Eclair"}
    assert {r.symbol for r in catalogue.search_locale(df, "alt").collect()} == {"älter"}
    assert catalogue.search_locale(df, "").count() == len(names) and catalogue.search_locale(df, "%").count() == 0


def test_job_log(spark, tmp_path):
    path = str(tmp_path / "log")
    jobs.create_log(spark, path)
    runs = spark.createDataFrame([("B", "SMA", "completed", "{}"), ("A", "RSI", "failed", None), ("A", "EMA", "completed", "[]")], "asset_symbol string, analysis_type string, status string, result string")
    first = jobs.append_runs(runs, path)
    assert sorted(tuple(r)[:3] for r in first.collect()) == [(1, "A", "EMA"), (2, "A", "RSI"), (3, "B", "SMA")]
    assert [r.id for r in jobs.append_runs(runs.limit(1), path).collect()] == [4]
    states = mutations.job_states(jobs.read_log(spark, path).withColumnRenamed("step", "order"))
    assert sorted(tuple(r) for r in states.collect()) == [(1, "completed", "[]"), (2, "failed", None), (3, "completed", "{}"), (4, "completed", "{}")]
    assert jobs.append_runs(runs.limit(0), path).count() == 0


def test_toggled_orders(spark, sf_dir):
    """Choosing the same field again turns the rows around."""
    field, direction = catalogue.toggled("price", "asc", "marketCap")
    assert (field, direction) == ("marketCap", "desc")
    down = [r.id for r in QUERIES["market_sort_cap"](spark, sf_dir).collect()]
    up = [r.id for r in catalogue.sort(market.assets(spark, sf_dir), *catalogue.toggled(field, direction, "marketCap")).collect()]
    assert len(up) == len(down) and set(up) == set(down) and up[0] != down[0]
