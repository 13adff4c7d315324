"""Structured Streaming: live bars, frames, and the last value of every quote field."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finscan.functions.fields import WIDTHS, checked


def tick_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Ticks (symbol, ts timestamp, seq, price, qty) from Parquet files as they arrive."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("qty"))


def live_bars(ticks: DataFrame, timeframe: str, late: str = "10 minutes") -> DataFrame:
    """Bars per symbol and window; ticks later than ``late`` are dropped and closed windows leave the state."""
    checked(timeframe, WIDTHS, "timeframe")
    key = F.struct("ts", "seq")
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", WIDTHS[timeframe]))
    found = rows.agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("n"))
    return found.select("symbol", F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "volume", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Trading sessions per symbol, ended by a gap without ticks."""
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap))
    return rows.agg(F.count("*").alias("n")).select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def sliding(ticks: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Range and volume per symbol in windows that begin at every step."""
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, step))
    found = rows.agg(F.max("price").alias("high"), F.min("price").alias("low"), F.sum("qty").alias("volume"))
    return found.select("symbol", F.col("window.start").alias("start"), "high", "low", "volume")


#: Buckets that a span of time is cut into.
SLICES = 4


def _wall_seconds(at: Column) -> Column:
    """Seconds of a time without zone, as the clock shows it."""
    return F.unix_date(F.to_date(at)) * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def matched(trades: DataFrame, quotes: DataFrame, within: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Each trade with the quotes (symbol, quoted_at, quote) of its symbol in the time before it, ``within`` at most.

    Two streams, or two tables: the bound on time lets old rows leave the state. A trade goes to all
    buckets of time that its quotes can lie in, a quote to its own, so few pairs are met in vain and
    a symbol's rows are dealt to many tasks.
    """
    wall = {dict(trades.dtypes)["ts"], dict(quotes.dtypes)["quoted_at"]} == {"timestamp_ntz"}
    width = f"greatest(1, (unix_seconds(timestamp_seconds(0) + interval {within}) - unix_seconds(timestamp_seconds(0))) div {SLICES})"
    bucket = lambda at: F.floor((_wall_seconds(at) if wall else F.unix_seconds(at.cast("timestamp"))) / F.expr(width))
    first, last = bucket(F.col("ts") - F.expr(f"interval {within}")), bucket(F.col("ts"))
    dealt = trades.withColumn("__bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    left, right = dealt.withWatermark("ts", late).alias("t"), quotes.withColumn("__bucket", bucket(F.col("quoted_at"))).withWatermark("quoted_at", late).alias("q")
    on = F.expr(f"t.symbol = q.symbol AND t.__bucket = q.__bucket AND q.quoted_at <= t.ts AND q.quoted_at >= t.ts - interval {within}")
    return left.join(right, on).select("t.symbol", "t.ts", "t.seq", "t.price", "q.quoted_at", "q.quote")


def distinct_ticks(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Ticks without repeats of a sequence number within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "seq"])


def live_quotes(deltas: DataFrame) -> DataFrame:
    """(symbol, seq, fields): after each trigger the merged quote of each symbol that changed.

    deltas: symbol, seq, field, value. State is one map a symbol.
    """

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names, values, seqs, last = state.get if state.exists else ([], [], [], -1)
        known = {n: (s, v) for n, v, s in zip(names, values, seqs, strict=True)}
        for batch in batches:
            last = max(last, int(batch["seq"].max()))
            # The latest value of each field first; few fields are left to merge.
            newest = batch[batch["value"].notna()].sort_values("seq", kind="stable").drop_duplicates("field", keep="last")
            for field, seq, value in zip(newest["field"], newest["seq"], newest["value"], strict=True):
                if field not in known or known[field][0] <= seq:
                    known[field] = (int(seq), value)
        names = sorted(known)
        state.update((names, [known[n][1] for n in names], [known[n][0] for n in names], last))
        yield pd.DataFrame({"symbol": [key[0]], "seq": [last], "fields": [{n: known[n][1] for n in names}]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return deltas.groupBy("symbol").applyInPandasWithState(merge, "symbol string, seq long, fields map<string,string>", "names array<string>, values array<string>, seqs array<long>, last long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Everything that has arrived, through the stream, as a table in memory (tests and small results)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), or a temporary one where all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="finscan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def run_to_table(stream: DataFrame, folder: str, mode: str = "update") -> None:
    """Take all that has arrived into the table below folder, from where the last run ended.

    Each batch is written under its number, over what a failed attempt left there, so a restart
    neither loses nor repeats one.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()


def current(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The newest version of each key in a table of updates."""
    rows = spark.read.parquet(f"{folder}/table")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row")).select(*keys, "__row.*")
