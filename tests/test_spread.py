"""Work per task that does not grow with the input."""

from pyspark.sql import functions as F

from marketframe.functions.joins import spread
from marketframe.functions.scan import running_peak


def test_spread_bounds_rows_of_a_task(spark):
    rows = spark.range(4000).withColumn("k", F.col("id") % 1000)
    dealt = spread(rows, ["k"], 4000, task_rows=100)
    assert dealt.rdd.getNumPartitions() == 40
    assert max(dealt.rdd.glom().map(len).collect()) < 400
    assert sorted(r[0] for r in dealt.select("id").collect()) == list(range(4000))
    few = spread(rows, ["k"], 4000, task_rows=4000)
    assert few.rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_sums_hash_the_summaries(spark):
    """The rows of a chunk are not sorted a second time to meet the chunk's summary."""
    rows = spark.range(100).selectExpr("id % 3 AS k", "id", "id AS v")
    out = running_peak(rows, ["k"], F.floor(F.col("id") / 10), ["id"], {"s": F.col("v")}, "s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r.id, r.s) for r in out.filter("k = 0").collect()} == {
        (i, sum(range(0, i + 1, 3))) for i in range(0, 100, 3)
    }


def test_only_large_keys_are_cut_by_price(spark, monkeypatch):
    from marketframe.operators import ledger as lg

    cut = []
    chunks = lg.running
    monkeypatch.setattr(lg, "running", lambda rows, *a: cut.append(rows.count()) or chunks(rows, *a))
    few, many = [("few", i) for i in range(4)], [(None, i) for i in range(4, 34)]
    rows = spark.createDataFrame(few + many, "account string, n long").selectExpr(
        "account", "'x' AS symbol", "'Sell' AS side", "1.0D AS qty", "100.0D + n AS trigger_price", "n",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS entry_time",
    )
    stops = rows.withColumnRenamed("n", "trade_id").withColumn("type", F.lit("sl"))
    orders = rows.withColumnRenamed("n", "order_id").drop("entry_time")
    found = lg.match_stops(stops, orders, chunk_rows=20).collect()
    assert sorted((r.account or "", r.trade_id, r.order_id) for r in found) == sorted(
        (a or "", n, n) for a, n in few + many
    )
    assert cut == [60]


def test_fifo_deals_cuts_lots_and_trades(spark, monkeypatch):
    from marketframe.operators import ledger as lg

    t = spark.range(400).selectExpr(
        "'x' AS symbol", "'Buy' AS side", "id AS trade_id", "2 + id % 3 AS size", "'open' AS status",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS entry_time",
    )
    e = spark.range(300).selectExpr(
        "'x' AS symbol", "'Sell' AS side", "id AS exec_id", "1 + id % 4 AS qty",
        "TIMESTAMP_NTZ '2024-01-01 00:00:30' + make_dt_interval(0, 0, id) AS ts",
    )
    plain = lg.fifo_reduce(t, e, chunk_rows=10)
    left = lg.apply_reductions(t, plain)
    monkeypatch.setattr(lg, "spread", lambda df, on, rows: spread(df, on, rows, task_rows=20))
    lots = lg.fifo_reduce(t, e, chunk_rows=10)
    after = lg.apply_reductions(t, lots)
    assert max(lots.rdd.glom().map(len).collect()) < 100
    assert max(after.rdd.glom().map(len).collect()) < 100
    assert sorted(lots.collect()) == sorted(plain.collect())
    assert sorted(after.select("trade_id", "size").collect()) == sorted(left.select("trade_id", "size").collect())


def test_fifo_chunks_go_by_rows_not_by_ids(spark, tmp_path):
    """Ids far apart do not make more chunks, whose summaries meet in one task per key."""
    from marketframe.plans import catalog_ledger as cl, views as v
    from tests.conftest import SF

    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = v.table(spark, SF, name)
        rows.withColumn(key, F.col(key) * 100_000).write.parquet(f"{tmp_path}/{name}.parquet")
    last = spark.read.parquet(f"{tmp_path}/orders.parquet").agg(F.max("o_orderkey")).first()[0]
    assert last > 100_000_000 and cl._ids_a_part(spark, str(tmp_path)) > last
