"""Venue payloads: klines, positions, orders, balances, instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeutil import epoch_number_to_ntz


def _first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the lowest ``order`` per key, combined map side."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return first.select(*keys, "_r.*")


def normalise_klines(payloads: DataFrame) -> DataFrame:
    """Nested string arrays (newest first) to typed bars.

    ``payloads`` has ``symbol``, ``batch`` and ``list``, an array of
    ``[start, open, high, low, close, volume, turnover]``.  Batches may
    overlap: the lowest batch number wins.
    """
    rows = payloads.select("symbol", "batch", F.explode("list").alias("k")).select(
        "symbol",
        "batch",
        F.col("k")[0].try_cast("long").alias("timestamp"),
        *[
            F.element_at("k", i + 2).try_cast("double").alias(name)
            for i, name in enumerate(["open", "high", "low", "close", "volume"])
        ],
    )
    return (
        _first_by(rows.filter("timestamp is not null"), ["symbol", "timestamp"], "batch")
        .drop("batch")
        .withColumn("bar", epoch_number_to_ntz(F.col("timestamp").cast("double")))
    )


_POSITION = (
    "symbol string, side string, size string, avgPrice string,"
    " unrealisedPnl string, positionIdx int"
)


def normalise_positions(payloads: DataFrame) -> DataFrame:
    """Position-list JSON (column ``value``) to typed rows with size above 0."""
    keep = [c for c in payloads.columns if c != "value"]
    schema = f"struct<result:struct<list:array<struct<{_colon(_POSITION)}>>>>"
    return (
        payloads.select(
            *keep, F.explode(F.from_json("value", schema)["result"]["list"]).alias("p")
        )
        .select(
            *keep,
            "p.symbol",
            "p.side",
            F.col("p.size").try_cast("double").alias("size"),
            F.col("p.avgPrice").try_cast("double").alias("entry_price"),
            F.col("p.unrealisedPnl").try_cast("double").alias("unrealized_pnl"),
            F.col("p.positionIdx").alias("position_idx"),
        )
        .filter(F.col("size") > 0)
    )


def _colon(ddl: str) -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in ddl.split(","))


def normalise_instruments(payloads: DataFrame) -> DataFrame:
    """Instrument JSON to tick size, quantity step and minimums."""
    schema = (
        "struct<symbol:string,priceFilter:struct<tickSize:string>,"
        "lotSizeFilter:struct<qtyStep:string,minOrderQty:string,minNotionalValue:string>>"
    )
    m = F.col("m")
    lot = m["lotSizeFilter"]
    return payloads.select(F.from_json("value", schema).alias("m")).select(
        m["symbol"].alias("symbol"),
        m["priceFilter"]["tickSize"].try_cast("double").alias("tick_size"),
        lot["qtyStep"].try_cast("double").alias("qty_step"),
        lot["minOrderQty"].try_cast("double").alias("min_qty"),
        F.coalesce(lot["minNotionalValue"].try_cast("double"), F.lit(0.0)).alias("min_notional"),
    )


def normalise_book_payload(payloads: DataFrame) -> DataFrame:
    """Full-book JSON to numeric level arrays."""
    schema = "struct<s:string,ts:long,b:array<array<string>>,a:array<array<string>>>"
    m = F.col("m")
    pair = lambda x: F.array(x[0].try_cast("double"), x[1].try_cast("double"))
    return payloads.select(F.from_json("value", schema).alias("m")).select(
        m["s"].alias("symbol"),
        F.transform(m["b"], pair).alias("bids"),
        F.transform(m["a"], pair).alias("asks"),
        m["ts"].alias("timestamp"),
    )


def last_prices(payloads: DataFrame) -> DataFrame:
    """Ticker JSON to the last price, 0 where the list is empty."""
    schema = "struct<list:array<struct<symbol:string,lastPrice:string>>>"
    first = F.get(F.from_json("value", schema)["list"], F.lit(0))
    keep = [c for c in payloads.columns if c != "value"]
    return payloads.select(
        *keep, F.coalesce(first["lastPrice"].try_cast("double"), F.lit(0.0)).alias("price")
    )


def wallet_balance(payloads: DataFrame, coin: str = "USDT") -> DataFrame:
    """Balance of ``coin`` from the first account type that holds it, else 0.

    ``payloads``: ``account``, ``rank`` (order in which account types are
    asked) and ``value``, a JSON list of coins.
    """
    schema = "struct<coin:array<struct<coin:string,walletBalance:string>>>"
    held = F.filter(F.from_json("value", schema)["coin"], lambda c: c["coin"] == coin)
    amount = F.get(held, F.lit(0))["walletBalance"].try_cast("double")
    return (
        payloads.withColumn("_a", amount)
        .groupBy("account")
        .agg(
            F.coalesce(
                F.min_by("_a", F.when(F.col("_a").isNotNull(), F.col("rank"))), F.lit(0.0)
            ).alias("balance")
        )
    )


def open_orders(active: DataFrame, conditional: DataFrame) -> DataFrame:
    """Active and conditional orders in one table."""
    return active.unionByName(conditional, allowMissingColumns=True)


def admit_bars(klines: DataFrame, now_ms: Column, last_processed: DataFrame | None = None) -> DataFrame:
    """Closed bars that may be processed.

    All fields present, start at most an hour ahead of ``now_ms``, start after
    the symbol's last processed bar; of repeated starts the first arrival.
    """
    required = ["start", "open", "high", "low", "close", "volume"]
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    rows = klines.filter(complete & F.col("confirm") & (F.col("start") <= now_ms + 3_600_000))
    if last_processed is not None:
        rows = (
            rows.join(last_processed, "symbol", "left")
            .filter(F.col("last_start").isNull() | (F.col("start") > F.col("last_start")))
            .drop("last_start")
        )
    return _first_by(rows, ["symbol", "start"], "arrival")
