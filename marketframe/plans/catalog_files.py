"""Registered queries that write the given tables as files and read them back.

The files lie in the shared folder and are deleted with the process.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.schema import context_columns, select_features
from ..functions.storage import materialise, new_folder
from ..functions.timeutil import ntz_micros
from ..operators import book as bk
from ..operators.signals import last_rows
from ..sources import book as sb, state as st, trades as tr
from . import frames, sqltext as q, views as v
from .catalog_feeds import book_text
from .catalog_labels import BARS_ATR
from .registry import query
from .rounding import rnd, sql_rnd as R

SAMPLE_LINES = 7


def _uuid(number):
    """An id in the form of a UUID made from a number."""
    h = F.md5(number.cast("string"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def write_trade_files(spark, d) -> list[str]:
    """Trade files of two kinds: usual columns, and another order with UUID ids."""
    t = v.trades(spark, d)
    us = ntz_micros(F.col("ts"))
    price = F.when(F.col("size") == 14, "bad").otherwise(F.col("price").cast("string"))
    usual = t.filter("symbol <> 'view'").select(
        (us / 1_000_000).alias("timestamp"), "symbol", "side", "size", price.alias("price"),
        F.lit("ZeroPlusTick").alias("tickDirection"), F.col("seq").alias("trdMatchID"),
    )
    other = t.filter("symbol = 'view'").select(
        _uuid(F.col("seq")).alias("trdMatchID"), price.alias("price"), "symbol", "size",
        (us / 1000).alias("timestamp"),
    )
    paths = []
    for name, rows in (("usual", usual), ("other", other)):
        paths.append(new_folder(spark, f"trade-files-{name}"))
        rows.write.option("header", True).csv(paths[-1])
    return paths


@query(
    "trade_files",
    f"""WITH {q.TRADES} SELECT symbol, ts, CASE WHEN symbol = 'view' THEN NULL ELSE seq END AS seq,
    CASE WHEN symbol = 'view' THEN 36 ELSE length(CAST(seq AS VARCHAR)) END AS id_chars, price, size,
    CASE WHEN symbol = 'view' THEN 'Buy' ELSE side END AS side FROM trades WHERE size <> 14""",
)
def trade_files(spark, d):
    out = tr.read_trade_csv(spark, write_trade_files(spark, d))
    return out.select(
        "symbol", "ts", "seq", F.length("trade_id").alias("id_chars"), "price", "size", "side"
    )


@query(
    "trade_store",
    f"""WITH {q.TRADES} SELECT symbol, CAST(ts AS DATE) AS dt, count(*) AS trades, {R('sum(size)')} AS size
    FROM trades WHERE size <> 14 AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2""",
)
def trade_store(spark, d):
    """The columnar store, read by day partition."""
    path = new_folder(spark, "trade-store")
    tr.write_trades(tr.read_trade_csv(spark, write_trade_files(spark, d)), path)
    days = spark.read.parquet(path).filter("dt >= date'2024-01-10'")
    return days.groupBy("symbol", "dt").agg(
        F.count(F.lit(1)).alias("trades"), rnd(F.sum("size")).alias("size")
    )


def write_book_files(spark, d) -> str:
    """Files of book messages per symbol and 1,000 numbers, cut and empty lines included."""
    path = new_folder(spark, "book-files")
    texts = v.book_msgs(spark, d).select(
        "symbol", F.floor(F.col("seq") / FILE_SEQS).alias("part"), "seq", book_text().alias("value")
    )
    texts.repartition("symbol", "part").sortWithinPartitions("symbol", "part", "seq").select(
        "value", "symbol", "part"
    ).write.partitionBy("symbol", "part").text(path)
    return path


FILE_SEQS = 1000


@query(
    "book_files",
    f"""WITH {q.LEVELS}, n AS (SELECT symbol, seq, ts,
      row_number() OVER (PARTITION BY symbol, seq // {FILE_SEQS} ORDER BY seq) AS line FROM msgs),
    l AS (SELECT symbol, seq, count(*) AS levels, count(*) FILTER (side = 'b') AS bids,
      sum(price) AS prices, {R('sum(size)', 3)} AS sizes FROM levels GROUP BY 1, 2)
    SELECT symbol, line, seq, date_trunc('millisecond', ts) AS ts, levels, bids, CAST(prices AS DOUBLE) AS prices, sizes FROM n JOIN l USING (symbol, seq)
    WHERE seq % 11 <> 5 AND seq % 7 <> 3""",
)
def book_files(spark, d):
    """All messages of the files with their lines and what their levels add up to."""
    msgs = sb.read_book_lines(spark, write_book_files(spark, d))
    levels = F.concat("b", "a")
    total = lambda i: F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + x[i].cast("double"))
    return msgs.select(
        "symbol", "line", "seq", "ts", F.size(levels).cast("long").alias("levels"),
        F.size("b").cast("long").alias("bids"), total(0).alias("prices"), rnd(total(1), 3).alias("sizes"),
    )


@query(
    "book_file_samples",
    f"""WITH {q.LEVELS}, n AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol, seq // {FILE_SEQS} ORDER BY seq) AS line FROM msgs)
    SELECT symbol, line, seq FROM n WHERE seq % 11 <> 5 AND seq % 7 <> 3 AND line % {SAMPLE_LINES} = 0""",
)
def book_file_samples(spark, d):
    """Messages on every seventh line of their file; lines that do not parse count."""
    msgs = materialise(sb.read_book_lines(spark, write_book_files(spark, d)), "book-messages")
    samples = bk.count_samples(msgs, SAMPLE_LINES)
    return samples.join(msgs.select("symbol", "seq", "line"), ["symbol", "seq"]).select(
        "symbol", "line", "seq"
    )


@query(
    "symbols",
    """SELECT DISTINCT upper(event_type) || 'USDT' AS symbol FROM events""",
)
def symbols(spark, d):
    """Symbols found in a file listing; mirror folders and other coins are no symbols."""
    folder = F.concat(F.upper("event_type"), F.element_at(
        F.array(F.lit("USDT"), F.lit("USDT_Binance"), F.lit("EUR")), (F.col("event_id") % 3 + 1).cast("int")
    ))
    files = v.table(spark, d, "events").select(
        F.concat(F.lit("/data/"), folder, F.lit("/Trade/"), F.col("event_id").cast("string"), F.lit(".csv")).alias("path")
    )
    return tr.discover_symbols(files)


@query(
    "stale_files",
    """WITH f AS (SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS mtime FROM orders),
    m AS (SELECT id, mtime + CASE WHEN id % 3 = 0 THEN -INTERVAL '1 day' ELSE INTERVAL '1 day' END AS built FROM f
      WHERE id % 5 > 0 AND id % 7 > 0)
    SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = f.id AND m.built > f.mtime)""",
)
def stale_files(spark, d):
    """One build of all stale files with its manifest rows; what is left is fresh."""
    orders = v.table(spark, d, "orders")
    files = orders.select(
        F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").cast("timestamp_ntz").alias("mtime")
    )
    number = F.col("path").cast("long")
    day = F.expr("interval 1 day")
    manifest = files.filter((number % 5 > 0)).select(
        "path",
        F.when(number % 7 == 0, "1h").otherwise("5m").alias("timeframe"),
        F.lit(50).alias("levels"),
        F.when(number % 3 == 0, F.col("mtime") - day).otherwise(F.col("mtime") + day).alias("built_at"),
    )
    stale = materialise(st.stale_files(files, manifest, "5m", 50), "stale")
    built = manifest.unionByName(
        st.manifest_rows(stale, "5m", 50, F.lit("2100-01-01").cast("timestamp_ntz"))
    )
    again = st.stale_files(files, built, "5m", 50)
    return stale.join(again.select("path"), "path", "left_anti").select(number.alias("id"))


@query(
    "build_stale",
    f"""WITH {q.TRADES}, r AS (SELECT symbol || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS path,
      count(*) AS trades FROM trades GROUP BY 1)
    SELECT path, trades, 1 + CASE WHEN ascii(path) % 2 = 0 THEN 1 ELSE 0 END AS builds FROM r""",
)
def build_stale(spark, d):
    """Three builds of a day's trades per file: one that breaks off, one that mends, one idle.

    The first writes all results but records only the files it got to; the second builds
    the others again, the third finds nothing to do.
    """
    root = new_folder(spark, "stale-build")
    path = F.concat_ws("/", "symbol", F.col("ts").cast("date").cast("string"))
    trades = materialise(v.trades(spark, d).withColumn("path", path), "file-trades")
    files = trades.groupBy("path").agg(F.lit("2024-06-01").cast("timestamp").alias("mtime"))
    done = F.ascii("path") % 2 == 1
    runs = []

    def compute(stale):
        runs.append(stale)
        return trades.join(stale.select("path"), "path").groupBy("path").agg(F.count("*").alias("trades"))

    st.write_partitions(compute(files), f"{root}/results", ["path"])
    reached = files.filter(done)
    rows = st.manifest_rows(reached, "5m", 50, F.current_timestamp())
    rows.write.mode("append").parquet(f"{root}/manifest")
    for _ in range(2):
        st.build_stale(files, st.load_manifest(spark, root), "5m", 50, compute, root)
    every = runs[0].select("path")
    for again in runs[1:]:
        every = every.unionByName(again.select("path"))
    counts = every.groupBy("path").agg(F.count("*").cast("int").alias("builds"))
    results = spark.read.schema("trades long, path string").parquet(f"{root}/results")
    return results.join(counts, "path").select("path", "trades", "builds")


@query(
    "history_version",
    f"""WITH {q.TRADES} SELECT symbol, count(*) + 1 AS rows FROM trades GROUP BY 1""",
)
def history_version(spark, d):
    """The newest of two published versions of a table."""
    root = new_folder(spark, "history")
    t = v.trades(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    st.save_version(t, root)
    st.save_version(st.load_version(spark, root).withColumn("rows", F.col("rows") + 1), root)
    return st.load_version(spark, root)


@query(
    "last_bars",
    f"""WITH {BARS_ATR} SELECT symbol, bar, {R('close')} AS close FROM
    (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar DESC) AS r FROM fa) WHERE r <= 100""",
)
def last_bars(spark, d):
    return last_rows(frames.bars_with_atr(spark, d), 100).select("symbol", "bar", rnd("close").alias("close"))


@query(
    "context_columns",
    f"""WITH {BARS_ATR} SELECT 'natr' AS name, count(*) AS rows FROM fa
    UNION ALL SELECT 'rsi', count(*) FROM fa UNION ALL SELECT 'ema_9_slope', count(*) FROM fa
    UNION ALL SELECT 'ema_21_slope', count(*) FROM fa UNION ALL SELECT 'ema_50_slope', count(*) FROM fa""",
)
def context(spark, d):
    """Context columns among the trend features, with their rows."""
    rows = frames.features(spark, d, ("trend",))
    names = context_columns(select_features(rows.columns))
    counts = rows.agg(*[F.count(F.coalesce(c, F.lit(0.0))).alias(c) for c in names])
    return counts.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("name", "rows"))
