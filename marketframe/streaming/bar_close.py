"""Bar close: append to history, recompute features, score, raise alerts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.joins import small_side_join
from ..functions.num import zero_fill_live
from ..functions.scan import with_row_index
from ..functions.timeutil import ntz_micros, timeframe_seconds
from ..functions.windows import HALO
from ..operators.features import add_features
from ..operators.history import MAX_LAG_MS, MIN_UPDATES, continuity

#: Bars behind the first new bar: as many as the batch operator looks back, so beyond the
#: reach of every rolling window and of what an exponential mean can remember.
LIVE_WINDOW = HALO + 1
#: Batches of a day that are rewritten as one.
COMPACT_PARTS = 32


@dataclass
class BarClose:
    """``foreachBatch`` target for closed bars.

    The history is partitioned by day ``dt`` and, inside a day, by the ``part`` that a
    batch wrote.  A batch replaces its own parts, so a retry writes the same files.
    Features of the new bars come from the ``window`` bars before the first of them, with
    the batch operator; only the days that hold these are read.  Days with many parts
    become one part; if that breaks off, a bar is stored twice and counts once.
    """

    root: str
    timeframe: str
    score: Callable[[DataFrame], DataFrame] | None = None
    window: int = LIVE_WINDOW
    groups: tuple[str, ...] = field(default=("trend", "flow", "book", "regime"))
    compact_parts: int = COMPACT_PARTS

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def _store(self, bars: DataFrame, part: str) -> None:
        rows = bars.withColumns({"dt": F.col("bar").cast("date"), "part": F.lit(part)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "dt", "part"
        ).parquet(f"{self.root}/history")

    def _folders(self, spark: SparkSession, path: str) -> list[str]:
        """Names of the folders in ``path``: days, or the parts of a day."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()]
        return sorted(n.split("=", 1)[1] for n in names if "=" in n)

    def history(self, bars: DataFrame, since: date | None = None) -> DataFrame:
        """Stored bars from day ``since`` on, with the columns of ``bars``.

        Of repeated bars the one from the earliest batch counts.
        """
        columns = bars.withColumn("batch", F.lit(0).cast("long")).schema
        schema = columns.add("dt", "date").add("part", "string")
        stored = bars.sparkSession.read.schema(schema).parquet(f"{self.root}/history")
        if since is not None:
            stored = stored.filter(F.col("dt") >= F.lit(since))
        w = Window.partitionBy("symbol", "bar").orderBy("batch")
        return stored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop(
            "_rn", "dt", "part"
        )

    def recent(self, new: DataFrame) -> DataFrame:
        """Rows of the symbols of ``new``, at least ``window`` before their first new bar.

        Starts with the days that ``window`` bars without gaps take, and doubles the span
        while a symbol with older bars has too few in it.
        """
        spark = new.sparkSession
        firsts = new.groupBy("symbol").agg(F.min("bar").alias("first_new")).cache()
        try:
            start = firsts.agg(F.min(F.col("first_new").cast("date"))).first()[0]
            oldest = date.fromisoformat(self._folders(spark, f"{self.root}/history")[0])
            # the day on which a symbol began tells whether there is more to read of it
            began = spark.read.parquet(f"{self.root}/symbols").groupBy("symbol").agg(
                F.min("began").alias("began")
            )
            span = timedelta(seconds=self.window * timeframe_seconds(self.timeframe)) + timedelta(days=1)
            while True:
                since = start - span
                past = small_side_join(self.history(new, since), firsts, ["symbol"])
                if since <= oldest:
                    return past.drop("first_new")
                before = past.filter(F.col("bar") < F.col("first_new")).groupBy("symbol").agg(
                    F.count("*").alias("n")
                )
                short = (
                    firsts.join(before, "symbol", "left")
                    .filter(F.coalesce("n", F.lit(0)) < self.window)
                    .join(began, "symbol")
                    .filter(F.col("began") < F.lit(since))
                )
                if short.isEmpty():
                    return past.drop("first_new")
                span *= 2
        finally:
            firsts.unpersist()

    def __call__(self, closed: DataFrame, batch_id: int) -> None:
        if closed.isEmpty():
            return
        spark = closed.sparkSession
        stored = closed.withColumn("batch", F.lit(batch_id).cast("long"))
        self._store(stored, f"b{batch_id}")
        days = [r[0] for r in closed.select(F.col("bar").cast("date")).distinct().collect()]
        schema = stored.schema.add("dt", "date").add("part", "string")
        new = (
            spark.read.schema(schema)
            .parquet(f"{self.root}/history")
            .filter(F.col("dt").isin(days) & (F.col("part") == f"b{batch_id}"))
            .select(*closed.columns)
        )
        self._write(
            new.groupBy("symbol").agg(F.min(F.col("bar").cast("date")).alias("began")), "symbols", batch_id
        )
        past = self.recent(new).drop("batch")
        rows = with_row_index(past, "bar")
        first = rows.join(new.select("symbol", "bar"), ["symbol", "bar"], "left_semi").groupBy("symbol")
        cut = first.agg(F.greatest(F.min("idx") - self.window, F.lit(0)).alias("_cut"))
        shifted = (
            small_side_join(rows, cut, ["symbol"])
            .filter(F.col("idx") >= F.col("_cut"))
            .withColumns({"idx": F.col("idx") - F.col("_cut"), "n": F.col("n") - F.col("_cut")})
            .drop("_cut")
        )
        features = add_features(shifted, self.groups)
        made = [c for c in features.columns if c not in past.columns]
        clean = features.withColumns({c: zero_fill_live(F.col(c)) for c in made if c not in ("idx", "n")})
        latest = clean.join(new.select("symbol", "bar"), ["symbol", "bar"], "left_semi")
        self._write(self.score(latest) if self.score else latest, "features", batch_id)
        self._write(live_alerts(past, new, self.timeframe), "alerts", batch_id)
        for day in days:
            self._compact(new, day, batch_id)

    def _compact(self, bars: DataFrame, day: date, batch_id: int) -> None:
        """Rewrite a day of many parts as one, then delete the parts it was made of."""
        spark, folder = bars.sparkSession, f"{self.root}/history/dt={day.isoformat()}"
        parts = self._folders(spark, folder)
        if len(parts) <= self.compact_parts:
            return
        whole = self.history(bars, day).filter(F.col("bar").cast("date") == F.lit(day))
        self._store(whole, f"c{batch_id}")
        jvm = spark.sparkContext._jvm
        for part in parts:
            where = jvm.org.apache.hadoop.fs.Path(f"{folder}/part={part}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def live_alerts(history: DataFrame, new: DataFrame, timeframe: str) -> DataFrame:
    """One row per problem of the new bars: gap, latency, stale or frozen book.

    Latency needs ``processed_at``; the book checks need the book columns.
    """
    rows = continuity(history.select("symbol", "bar"), timeframe).join(
        new, ["symbol", "bar"], "inner"
    )
    end = ntz_micros(F.col("bar")) + timeframe_seconds(timeframe) * 1_000_000
    found = [F.when(F.col("continuity") == "gap", F.lit("gap"))]
    if "processed_at" in new.columns:
        lag_ms = (ntz_micros(F.col("processed_at")) - end) / 1000
        found.append(F.when(lag_ms > MAX_LAG_MS, F.lit("latency")))
    if "ob_spread_mean" in new.columns:
        spread = F.coalesce("ob_spread_mean", F.lit(0.0))
        found.append(F.when(spread <= 0, F.lit("stale_spread")))
        if "ob_update_count" in new.columns:
            few = F.coalesce("ob_update_count", F.lit(0)) < MIN_UPDATES
            found.append(F.when((spread > 0) & few, F.lit("frozen_book")))
    return (
        rows.select("symbol", "bar", F.explode(F.array_compact(F.array(*found))).alias("alert"))
    )
