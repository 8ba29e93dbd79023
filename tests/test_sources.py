"""Files, payloads, state tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from marketframe.functions import num
from marketframe.functions.timeutil import timeframe_seconds
from marketframe.sources import book as sb, state as st, trades as tr, venue as vn


def test_trade_files_with_different_headers(spark, tmp_path):
    a = tmp_path / "AUSDT" / "Trade"
    b = tmp_path / "BUSDT" / "Trade"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    (a / "1.csv").write_text(",".join(tr.TRADE_COLUMNS) + "\n1704067200.5,AUSDT,Sell,1e-3,10.5,Z,7,0,0,0,0\nbroken,line\n")
    (a / "2.csv").write_text("timestamp,price,size\n1704067201000,11,2\n")
    (b / "1.csv").write_text("timestamp,symbol,side,size,price\n1704067202,BUSDT,Buy,3,12\n")
    (b / "junk.csv").write_text("\x00\x01nothing here\n")
    out = tr.read_trade_csv(spark, [str(a), str(b)]).orderBy("ts").collect()
    got = [(r["symbol"], str(r["ts"]), r["price"], r["size"], r["side"], r["seq"]) for r in out]
    assert got == [
        ("AUSDT", "2024-01-01 00:00:00.500000", 10.5, 0.001, "Sell", 7),
        ("AUSDT", "2024-01-01 00:00:01", 11.0, 2.0, "Buy", None),
        ("BUSDT", "2024-01-01 00:00:02", 12.0, 3.0, "Buy", None),
    ]
    store = str(tmp_path / "store")
    tr.write_trades(tr.read_trade_csv(spark, [str(a), str(b)]), store)
    one = spark.read.parquet(store).filter("symbol = 'AUSDT' and dt = '2024-01-01'")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(symbol" in one._jdf.queryExecution().executedPlan().toString()


def test_symbols_from_paths(spark):
    paths = ["/d/BTCUSDT/Trade/a.csv", "/d/BTCUSDT_Binance/Trade/a.csv", "/d/OTHER/Trade/a.csv", "/d/ETHUSDT/Orderbook/x.data"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r["symbol"] for r in tr.discover_symbols(df).collect()) == ["BTCUSDT", "ETHUSDT"]
    assert df.select(tr.symbol_of_path(F.col("path")).alias("s")).collect()[1]["s"] == "BTCUSDT"


def test_book_files(spark, tmp_path):
    msg = lambda kind, **data: json.dumps({"topic": "t", "type": kind, "ts": 1704067200123, "data": data, "u": 1, "seq": 5, "cts": 9})
    (tmp_path / "a.data").write_text("\n".join([
        msg("snapshot", s="X", b=[["1.0", "2"]], a=[["1.1", "3"]]), msg("delta", s="X", b=[["1.0", "0"]], a=[]),
        '{"type": "delta"', json.dumps({"type": "delta", "ts": 1, "data": None}), "plain text",
    ]))
    out = sb.read_book_lines(spark, str(tmp_path)).collect()
    assert [r["type"] for r in out] == ["snapshot", "delta"]
    assert out[0]["b"] == [["1.0", "2"]] and str(out[0]["ts"]) == "2024-01-01 00:00:00.123000"
    assert out[0]["file"].endswith("a.data")


def values(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "value string")


def test_venue_payloads(spark):
    p = {"symbol": "X", "side": "Buy", "size": "0.5", "avgPrice": "10", "unrealisedPnl": "-1.5", "positionIdx": 1}
    got = vn.normalise_positions(values(spark, {"result": {"list": [p, {**p, "size": "0"}]}})).collect()
    assert len(got) == 1 and got[0]["entry_price"] == 10.0 and got[0]["unrealized_pnl"] == -1.5
    info = {"symbol": "X", "priceFilter": {"tickSize": "0.01"}, "lotSizeFilter": {"qtyStep": "0.1", "minOrderQty": "0.2"}}
    assert tuple(vn.normalise_instruments(values(spark, info)).first()) == ("X", 0.01, 0.1, 0.2, 0.0)
    book = vn.normalise_book_payload(values(spark, {"s": "X", "ts": 5, "b": [["1", "2"]], "a": []})).first()
    assert book["bids"] == [[1.0, 2.0]] and book["asks"] == []
    prices = vn.last_prices(values(spark, {"list": [{"symbol": "X", "lastPrice": "7.5"}]}, {"list": []})).collect()
    assert [r["price"] for r in prices] == [7.5, 0.0]


def test_wallet_takes_first_account_with_coin(spark):
    coin = lambda c, v: json.dumps({"coin": [{"coin": c, "walletBalance": v}]})
    df = spark.createDataFrame(
        [("a", 0, coin("BTC", "1")), ("a", 1, coin("USDT", "50")), ("b", 0, coin("USDT", "7")), ("b", 1, coin("USDT", "9")), ("c", 0, coin("BTC", "1"))],
        "account string, rank int, value string",
    )
    assert dict(vn.wallet_balance(df).collect()) == {"a": 50.0, "b": 7.0, "c": 0.0}


def test_open_orders_union(spark):
    a = spark.createDataFrame([(1, "Limit")], "order_id long, kind string")
    b = spark.createDataFrame([(2, 9.5)], "order_id long, trigger_price double")
    assert vn.open_orders(a, b).count() == 2


def test_params_override_key_by_key(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"symbol": "X", "limit_offset_atr": 0.5, "max_depth": 3}, indent=2))
    r = st.read_params(spark, str(tmp_path)).first()
    assert r["base_limit_offset_atr"] == 0.5 and r["max_depth"] == 3
    assert r["take_profit_atr"] == st.PARAM_DEFAULTS["take_profit_atr"] and r["symbol"] == "X"


def test_position_save_keeps_other_symbols(spark):
    cols = "symbol string, status string, trade_id int"
    stored = spark.createDataFrame([("A", "open", 1), ("A", "closed", 2), ("B", "open", 3)], cols)
    cur = spark.createDataFrame([("A", "open", 4)], cols)
    assert sorted(r["trade_id"] for r in st.save_positions(stored, cur).collect()) == [2, 3, 4]
    # the last open trade of a managed symbol was closed: its old row goes
    managed = spark.createDataFrame([("A",), ("B",)], "symbol string")
    kept = st.save_positions(stored, cur, managed)
    assert sorted(r["trade_id"] for r in kept.collect()) == [2, 4]


def test_manifest(spark):
    files = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "path string, mtime long")
    done = spark.createDataFrame(
        [("a", "5m", 50, 11), ("b", "5m", 50, 9), ("c", "5m", 150, 20), ("c", "1h", 50, 20)],
        "path string, timeframe string, levels int, built_at long",
    )
    assert sorted(r["path"] for r in st.stale_files(files, done, "5m", 50).collect()) == ["b", "c"]


def test_only_present_partitions_are_replaced(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "file string, x int")
    st.write_partitions(rows, out, ["file"])
    st.write_partitions(rows.filter("file = 'b'").withColumn("x", F.lit(2)), out, ["file"])
    assert sorted((r["file"], r["x"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2)]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "h")
    st.save_version(spark.range(3), root)
    time.sleep(0.01)
    st.save_version(spark.range(5), root)
    assert st.load_version(spark, root).count() == 5
    drift = st.with_columns_or_zero(spark.range(1), ["a", "id"]).first()
    assert drift["a"] == 0.0 and drift["id"] == 0


def test_file_listing(spark, tmp_path):
    (tmp_path / "x.data").write_text("1")
    row = st.file_listing(spark, str(tmp_path)).first()
    assert row["path"].endswith("x.data") and row["mtime"] is not None


def test_timeframes():
    assert [timeframe_seconds(t) for t in ("1m", "4h", "1d")] == [60, 14400, 86400]
    for bad in ("", "5x", "m", "0m"):
        with pytest.raises(ValueError):
            timeframe_seconds(bad)


def test_ticks_round_half_to_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (2.4,)], "p double")
    assert [r[0] for r in df.select(num.to_tick(F.col("p"), F.lit(1.0))).collect()] == [2.0, 4.0, 2.0]
    assert df.select(num.to_step(F.col("p"), F.lit(1.0), F.lit(3.0)).alias("q")).first()["q"] == 0.0


def test_level_cleaning(spark):
    df = spark.createDataFrame([([["1.0", "0"], ["2.0", "1.5"], ["-1", "3"], ["4", "-2"]],)], "l array<array<string>>")
    strict, loose = df.select(sb.sanitise_levels(F.col("l"), False), sb.sanitise_levels(F.col("l"), True)).first()
    assert strict == [["2.0", "1.5"]] and loose == [["1.0", "0"], ["2.0", "1.5"]]
