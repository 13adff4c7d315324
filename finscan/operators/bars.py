"""OHLCV bars from trades or ticks, at ten timeframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finscan.functions.fields import TIMEFRAMES, WIDTHS, checked


def bar_start(ts: str, timeframe: str) -> Column:
    """Start of a moment's bar; weeks begin on Monday, months on the first."""
    checked(timeframe, TIMEFRAMES, "timeframe")
    if timeframe in ("1w", "1M"):
        return F.date_trunc("week" if timeframe == "1w" else "month", F.col(ts)).cast("timestamp_ntz")
    return F.window(ts, WIDTHS[timeframe])["start"].cast("timestamp_ntz")


def bars(trades: DataFrame, timeframe: str) -> DataFrame:
    """(symbol, bar_start, open, high, low, close, volume, n); first and last by (ts, seq).

    One partial aggregation and one shuffle of bars, not of trades.
    """
    key = F.struct("ts", "seq")
    rows = trades.withColumn("bar_start", bar_start("ts", timeframe))
    return rows.groupBy("symbol", "bar_start").agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("qty").alias("volume"),
        F.count("*").alias("n"),
    )


def last_bars(bars_: DataFrame, n: int) -> DataFrame:
    """The n latest bars of each symbol, with their index from the oldest (0) on."""
    order = Window.partitionBy("symbol").orderBy(F.desc("bar_start"))
    kept = bars_.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    index = F.row_number().over(Window.partitionBy("symbol").orderBy("bar_start")) - 1
    return kept.withColumn("index", index).drop("place")


def gap_filled(bars_: DataFrame, timeframe: str) -> DataFrame:
    """Bars without gaps between each symbol's first and last: missing ones repeat the close before, with no volume."""
    step = {"1w": "1 week", "1M": "1 month"}.get(timeframe) or WIDTHS[timeframe]
    ends = bars_.groupBy("symbol").agg(F.min("bar_start").alias("a"), F.max("bar_start").alias("b"))
    grid = ends.select("symbol", F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("bar_start"))
    rows = grid.join(bars_, ["symbol", "bar_start"], "left")
    before = Window.partitionBy("symbol").orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    close = F.last("close", ignorenulls=True).over(before)
    price = lambda c: F.coalesce(c, close).alias(c)
    return rows.select("symbol", "bar_start", price("open"), price("high"), price("low"), close.alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def join_indicator(bars_: DataFrame, indicator: DataFrame) -> DataFrame:
    """Bars side by side with an indicator's points."""
    return bars_.join(indicator, ["symbol", "bar_start"])


def as_of(left: DataFrame, quotes: DataFrame, *, by: str = "symbol", at: str = "ts", value: str = "price", bucket: str = "1 day") -> DataFrame:
    """left with the last quote at or before each row.

    Rows and quotes are dealt by key and bucket of time, so that one key is spread over many tasks; a
    running last value is taken inside a bucket, and what a bucket begins with is the last quote of
    the ones before it: one row a bucket, for all keys together far fewer than quotes.
    """
    rows = left.withColumns({"__q": F.lit(None).cast(quotes.schema[value].dataType), "__side": F.lit(1)})
    right = quotes.select(*[F.col(c) if c in (by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("__q"), F.lit(0).alias("__side"))
    start = lambda df: df.withColumn("__bucket", F.window(at, bucket)["start"])
    both = start(rows.unionByName(right).where(F.col(at).isNotNull()))
    inside = Window.partitionBy(by, "__bucket").orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(by, "__bucket").agg(F.max_by("__q", F.when(F.col("__side") == 0, F.col(at))).alias("__end"))
    carried = ends.select(F.col(by).alias("__by"), F.col("__bucket").alias("__in"), F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    found = both.withColumn("__own", F.last("__q", ignorenulls=True).over(inside)).where("__side = 1")
    found = found.join(carried, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__bucket") == F.col("__in")), "left")
    timeless = rows.where(F.col(at).isNull()).select(*left.columns, F.col("__q").alias("as_of_" + value))
    return found.select(*left.columns, F.coalesce("__own", "__carried").alias("as_of_" + value)).unionByName(timeless)
