"""Technical indicators on bars (symbol, bar_start, open, high, low, close, volume).

Finite windows, lags, pivots and votes are window functions that share one shuffle and sort by
symbol. Recursive averages (class "exponential") run in one grouped map over Arrow batches per
symbol: a symbol's bars are bounded by time, not by trades. Values are null until a window is full.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finscan.functions.fields import INDICATORS, TIMEFRAMES, checked, q, symbol_of, unsupported
from finscan.operators.bars import bars as bars_of


def _by():
    """Each symbol's bars in order. A function: windows need a running session."""
    return Window.partitionBy("symbol").orderBy("bar_start")


def _last(n: int):
    return _by().rowsBetween(-n + 1, 0)


def full(value: Column, n: int) -> Column:
    """value where n bars are there."""
    return F.when(F.count(F.lit(1)).over(_last(n)) == n, value)


def sma(c: str | Column, n: int) -> Column:
    c = q(c) if isinstance(c, str) else c
    return full(F.avg(c).over(_last(n)), n)


def wma(c: Column, n: int) -> Column:
    """Linearly weighted average, the latest bar with weight n."""
    return reduce(add, (F.lag(c, i).over(_by()) * float(n - i) for i in range(n))) / float(n * (n + 1) // 2)


def highest(n: int) -> Column:
    return full(F.max("high").over(_last(n)), n)


def lowest(n: int) -> Column:
    return full(F.min("low").over(_last(n)), n)


def lagged(name: str, n: int) -> Column:
    return F.lag(q(name), n).over(_by())


def averages(bars: DataFrame, lengths=(10, 20, 30, 50, 100, 200)) -> DataFrame:
    return bars.withColumns({f"SMA{n}": sma("close", n) for n in lengths})


def stochastic(bars: DataFrame) -> DataFrame:
    span = highest(14) - lowest(14)
    raw = bars.withColumn("__k", F.when(span != 0, 100 * (F.col("close") - lowest(14)) / span))
    k = raw.withColumn("Stoch.K", F.when(F.count("__k").over(_last(3)) == 3, F.avg("__k").over(_last(3))))
    d = k.withColumn("Stoch.D", F.when(F.count("`Stoch.K`").over(_last(3)) == 3, F.avg("`Stoch.K`").over(_last(3))))
    return d.withColumns({"Stoch.K[1]": lagged("Stoch.K", 1), "Stoch.D[1]": lagged("Stoch.D", 1)}).drop("__k")


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    rows = bars.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    rows = rows.withColumns({"__m": sma("__tp", n), "__l": F.collect_list("__tp").over(_last(n))})
    deviation = F.aggregate("__l", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("__m"))) / float(n)
    rows = rows.withColumn(f"CCI{n}", F.when(deviation != 0, (F.col("__tp") - F.col("__m")) / (0.015 * deviation)))
    return rows.withColumn(f"CCI{n}[1]", lagged(f"CCI{n}", 1)).drop("__tp", "__m", "__l")


def awesome(bars: DataFrame) -> DataFrame:
    rows = bars.withColumn("__mid", (F.col("high") + F.col("low")) / 2.0)
    rows = rows.withColumn("AO", sma("__mid", 5) - sma("__mid", 34))
    return rows.withColumns({"AO[1]": lagged("AO", 1), "AO[2]": lagged("AO", 2)}).drop("__mid")


def momentum(bars: DataFrame, n: int = 10) -> DataFrame:
    rows = bars.withColumn("Mom", F.col("close") - lagged("close", n))
    return rows.withColumn("Mom[1]", lagged("Mom", 1))


def williams(bars: DataFrame, n: int = 14) -> DataFrame:
    span = highest(n) - lowest(n)
    return bars.withColumn("W.R", F.when(span != 0, 100 * (F.col("close") - highest(n)) / span))


def ultimate(bars: DataFrame) -> DataFrame:
    """Buying pressure over true range in 7, 14 and 28 bars, weighted 4:2:1."""
    before = lagged("close", 1)
    rows = bars.withColumns({"__bp": F.col("close") - F.least("low", before), "__tr": F.greatest("high", before) - F.least("low", before), "__n": F.row_number().over(_by())})
    ratio = lambda n: F.sum("__bp").over(_last(n)) / F.nullif(F.sum("__tr").over(_last(n)), F.lit(0.0))
    value = 100 * (4 * ratio(7) + 2 * ratio(14) + ratio(28)) / 7.0
    return rows.withColumn("UO", F.when(F.col("__n") > 28, value)).drop("__bp", "__tr", "__n")


def ichimoku(bars: DataFrame) -> DataFrame:
    return bars.withColumn("Ichimoku.BLine", (highest(26) + lowest(26)) / 2.0)


def volume_weighted(bars: DataFrame, n: int = 20) -> DataFrame:
    traded = F.sum(F.col("close") * F.col("volume")).over(_last(n)) / F.nullif(F.sum("volume").over(_last(n)), F.lit(0.0))
    return bars.withColumn("VWMA", full(traded, n))


def hull(bars: DataFrame) -> DataFrame:
    rows = bars.withColumn("__h", 2.0 * wma(F.col("close"), 4) - wma(F.col("close"), 9))
    return rows.withColumn("HullMA9", wma(F.col("__h"), 3)).drop("__h")


def volume_average(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn(f"VolumeMA{n}", sma("volume", n))


EXPONENTIAL = [*(f"EMA{n}" for n in (10, 20, 30, 50, 100, 200)), "RSI", "MACD.macd", "MACD.signal", "ADX", "ADX+DI", "ADX-DI", "ATR", "BBPower"]


def _recursive(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bar_start", ignore_index=True)
    close, high, low = pdf["close"], pdf["high"], pdf["low"]
    place = pd.Series(range(1, len(pdf) + 1))
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    wilder = lambda s: s.ewm(alpha=1 / 14, adjust=False, ignore_na=True).mean()
    out = pdf.copy()
    for n in (10, 20, 30, 50, 100, 200):
        out[f"EMA{n}"] = ema(close, n)
    move = close.diff()
    gain, loss = wilder(move.clip(lower=0)), wilder((-move).clip(lower=0))
    out["RSI"] = (100 * gain / (gain + loss).where(gain + loss != 0)).where(place >= 15)
    macd = ema(close, 12) - ema(close, 26)
    out["MACD.macd"], out["MACD.signal"] = macd, ema(macd, 9)
    before = close.shift(1)
    true_range = pd.concat([high - low, (high - before).abs(), (low - before).abs()], axis=1).max(axis=1).where(before.notna())
    up, down = high.diff(), -low.diff()
    plus = up.where((up > down) & (up > 0), 0.0).where(before.notna())
    minus = down.where((down > up) & (down > 0), 0.0).where(before.notna())
    atr = wilder(true_range)
    safe = atr.where(atr != 0)
    plus_di, minus_di = 100 * wilder(plus) / safe, 100 * wilder(minus) / safe
    both = plus_di + minus_di
    dx = (100 * (plus_di - minus_di).abs() / both.where(both != 0)).where(both != 0, both * 0)
    out["ADX"] = wilder(dx).where(place >= 28)
    out["ADX+DI"], out["ADX-DI"], out["ATR"] = (x.where(place >= 15) for x in (plus_di, minus_di, atr))
    out["BBPower"] = (high - ema(close, 13)) + (low - ema(close, 13))
    return out


def with_exponential(bars: DataFrame) -> DataFrame:
    """bars with all recursive indicators: one grouped map, whose result the windows go on with, so bars are made once."""
    schema = T.StructType([*bars.schema.fields, *(T.StructField(n, T.DoubleType()) for n in EXPONENTIAL)])
    return bars.groupBy("symbol").applyInPandas(_recursive, schema)


def exponential(bars: DataFrame) -> DataFrame:
    """(symbol, bar_start) with all recursive indicators."""
    names = ["symbol", "bar_start"]
    return with_exponential(bars.select(*names, "high", "low", "close")).select(*names, *map(q, EXPONENTIAL))


def stochastic_rsi(recursive: DataFrame) -> DataFrame:
    """RSI's place in its own range of 14 bars, averaged over 3."""
    top, bottom = F.max("RSI").over(_last(14)), F.min("RSI").over(_last(14))
    rows = recursive.withColumn("__s", F.when((F.count("RSI").over(_last(14)) == 14) & (top != bottom), 100 * (F.col("RSI") - bottom) / (top - bottom)))
    return rows.withColumn("Stoch.RSI.K", F.when(F.count("__s").over(_last(3)) == 3, F.avg("__s").over(_last(3)))).drop("__s")


def pivots(months: DataFrame, kind: str) -> DataFrame:
    """Pivot levels of each month from the month before; months are 1M bars."""
    o, h, l, c = (F.lag(x).over(_by()) for x in ("open", "high", "low", "close"))
    span = h - l
    p = (h + l + c) / 3.0
    if kind == "Classic":
        levels = {"S3": p - 2 * span, "S2": p - span, "S1": 2 * p - h, "Middle": p, "R1": 2 * p - l, "R2": p + span, "R3": p + 2 * span}
    elif kind == "Fibonacci":
        levels = {"S3": p - span, "S2": p - 0.618 * span, "S1": p - 0.382 * span, "Middle": p, "R1": p + 0.382 * span, "R2": p + 0.618 * span, "R3": p + span}
    elif kind == "Camarilla":
        step = lambda n: 1.1 * span / float(n)
        levels = {"S3": c - step(4), "S2": c - step(6), "S1": c - step(12), "Middle": p, "R1": c + step(12), "R2": c + step(6), "R3": c + step(4)}
    elif kind == "Woodie":
        p = (h + l + 2 * c) / 4.0
        levels = {"S3": l - 2 * (h - p), "S2": p - span, "S1": 2 * p - h, "Middle": p, "R1": 2 * p - l, "R2": p + span, "R3": h + 2 * (p - l)}
    elif kind == "Demark":
        x = F.when(c < o, h + 2 * l + c).when(c > o, 2 * h + l + c).otherwise(h + l + 2 * c)
        levels = {"S1": x / 2.0 - h, "Middle": x / 4.0, "R1": x / 2.0 - l}
    else:
        raise ValueError(f"unknown pivots {kind!r}")
    return months.select("symbol", "bar_start", *(v.alias(f"Pivot.M.{kind}.{k}") for k, v in levels.items()))


def vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).when(good.isNotNull() & bad.isNotNull(), 0)


def mean_vote(votes: list[Column]) -> Column:
    """Mean of the votes that are there."""
    n = reduce(add, (F.when(v.isNotNull(), 1).otherwise(0) for v in votes))
    return reduce(add, (F.coalesce(v, F.lit(0)) for v in votes)) / F.nullif(n.cast("double"), F.lit(0.0))


def all_indicators(bars: DataFrame) -> DataFrame:
    """Every indicator of the catalogue but the monthly pivots, for every bar."""
    rows = with_exponential(bars)
    for step in (averages, stochastic, cci, awesome, momentum, williams, ultimate, ichimoku, volume_weighted, hull, stochastic_rsi):
        rows = step(rows)
    return ratings(rows.withColumns({f"{n}[1]": lagged(n, 1) for n in ("RSI", "ADX+DI", "ADX-DI")}))


def ratings(rows: DataFrame) -> DataFrame:
    """Votes of -1, 0 and 1 and their means: averages, oscillators, all."""
    close = F.col("close")
    above = lambda name: vote(close > q(name), close < q(name))
    rows = rows.withColumns(
        {
            "Rec.Ichimoku": above("Ichimoku.BLine"),
            "Rec.VWMA": above("VWMA"),
            "Rec.HullMA9": above("HullMA9"),
            "Rec.Stoch.RSI": vote(q("Stoch.RSI.K") < 20, q("Stoch.RSI.K") > 80),
            "Rec.WR": vote(q("W.R") < -80, q("W.R") > -20),
            "Rec.BBPower": vote(q("BBPower") > 0, q("BBPower") < 0),
            "Rec.UO": vote(q("UO") > 70, q("UO") < 30),
        }
    )
    trend = [above(f"{k}{n}") for n in (10, 20, 30, 50, 100, 200) for k in ("EMA", "SMA")] + [q(n) for n in ("Rec.Ichimoku", "Rec.VWMA", "Rec.HullMA9")]
    other = [
        vote((q("RSI") < 30) & (q("RSI") > q("RSI[1]")), (q("RSI") > 70) & (q("RSI") < q("RSI[1]"))),
        vote((q("Stoch.K") < 20) & (q("Stoch.K") > q("Stoch.D")), (q("Stoch.K") > 80) & (q("Stoch.K") < q("Stoch.D"))),
        vote((q("CCI20") < -100) & (q("CCI20") > q("CCI20[1]")), (q("CCI20") > 100) & (q("CCI20") < q("CCI20[1]"))),
        vote((q("ADX") > 20) & (q("ADX+DI") > q("ADX-DI")), (q("ADX") > 20) & (q("ADX+DI") < q("ADX-DI"))),
        vote((q("AO") > 0) & (q("AO") > q("AO[1]")), (q("AO") < 0) & (q("AO") < q("AO[1]"))),
        vote(q("Mom") > q("Mom[1]"), q("Mom") < q("Mom[1]")),
        vote(q("MACD.macd") > q("MACD.signal"), q("MACD.macd") < q("MACD.signal")),
        *(q(n) for n in ("Rec.Stoch.RSI", "Rec.WR", "Rec.BBPower", "Rec.UO")),
    ]
    rows = rows.withColumns({"Recommend.MA": mean_vote(trend), "Recommend.Other": mean_vote(other)})
    return rows.withColumn("Recommend.All", (F.col("`Recommend.MA`") + F.col("`Recommend.Other`")) / 2.0)


def latest(rows: DataFrame) -> DataFrame:
    """The last bar of each symbol."""
    order = Window.partitionBy("symbol").orderBy(F.desc("bar_start"))
    return rows.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


#: Days before a bar from whose close its performance is measured.
HORIZONS = {"Perf.W": 7, "Perf.1M": 30, "Perf.3M": 91, "Perf.6M": 182, "Perf.Y": 365}


def performance(days: DataFrame, *, least_beta: int = 20) -> DataFrame:
    """Change, 52-week range, performance, volatility and beta of daily bars, for each bar.

    Perf.YTD counts from the last close of an earlier year. beta_1_year is the covariance of the
    changes with the mean change of all symbols on a day, over its variance, within 365 days.
    """
    rows = days.withColumns({"__day": F.unix_date(F.col("bar_start").cast("date")), "__year": F.year("bar_start")})
    span = lambda a, b, by="__day": Window.partitionBy("symbol").orderBy(by).rangeBetween(a, b)
    before = F.lag("close").over(_by())
    rows = rows.withColumns({"change_abs": F.col("close") - before, "change": 100 * (F.col("close") - before) / before, "change_from_open": 100 * (F.col("close") - F.col("open")) / F.col("open"), "Value.Traded": F.col("close") * F.col("volume")})
    rows = rows.withColumn("__all", F.when(F.col("change").isNotNull(), F.avg("change").over(Window.partitionBy("bar_start"))))
    first = Window.unboundedPreceding
    anchors = {f"__{name}": F.last("close").over(span(first, -n)) for name, n in HORIZONS.items()}
    anchors["__Perf.YTD"] = F.max_by("close", "__day").over(span(first, -1, "__year"))
    rows = rows.withColumns(anchors | {"price_52_week_high": F.max("high").over(span(-364, 0)), "price_52_week_low": F.min("low").over(span(-364, 0))})
    perf = {name[2:]: 100 * (F.col("close") - q(name)) / q(name) for name in anchors}
    vol = {name: F.when(F.count("change").over(_last(n)) == n, F.stddev_samp("change").over(_last(n))) for name, n in (("Volatility.W", 5), ("Volatility.M", 21))}
    year = span(-364, 0)
    beta = F.when(F.count("change").over(year) >= least_beta, F.covar_samp("change", "__all").over(year) / F.nullif(F.var_samp("__all").over(year), F.lit(0.0)))
    spread = 100 * (F.col("high") - F.col("low")) / F.col("low")
    return rows.withColumns(perf | vol | {"Volatility.D": spread, "beta_1_year": beta}).drop("__day", "__year", "__all", *anchors)


def wire_fields(names: list[str], timeframe: str) -> list[str]:
    """Names as a request sends them: with the timeframe's code, if it has one."""
    code = TIMEFRAMES[checked(timeframe, TIMEFRAMES, "timeframe")]
    return [f"{n}|{code}" if code else n for n in names]


def stripped(reply: DataFrame) -> DataFrame:
    """A reply's columns without the timeframe's code."""
    return reply.withColumnsRenamed({c: re.sub(r"\|.*", "", c) for c in reply.columns})


def stripped_keys(reply: str) -> Column:
    """A reply that came as a map, its keys without the timeframe's code."""
    return F.transform_keys(reply, lambda k, _: F.regexp_replace(k, r"\|.*", ""))


def snapshot(trades: DataFrame, exchange: str, symbol: str, timeframe: str = "1d", names: list[str] | None = None, *, all_names: bool = False, exchanges=None, wire: bool = False) -> DataFrame:
    """One row: the indicators of a symbol (EXCHANGE:SYMBOL) at its latest bar of a timeframe; monthly pivots from its 1M bars.

    trades: symbol, ts, seq, price, qty; the symbol is filtered before anything is aggregated. exchanges
    limits what may be asked for. With wire the columns keep the names of the request (stripped() undoes it).
    """
    checked(timeframe, TIMEFRAMES, "timeframe")
    if exchanges is not None:
        checked(exchange, exchanges, "exchange")
    if all_names:
        names = INDICATORS
    elif not names:
        raise ValueError("names of indicators are needed, or all_names")
    if unknown := unsupported(names, INDICATORS):
        raise ValueError(f"unsupported indicators: {', '.join(unknown)}")
    mine = trades.where(F.col("symbol") == symbol_of(f"{exchange}:{symbol}"))
    asked = list(dict.fromkeys(names))
    found = latest(all_indicators(bars_of(mine, timeframe)))
    if any(n.startswith("Pivot.") for n in asked):
        months = bars_of(mine, "1M")
        for kind in ("Classic", "Fibonacci", "Camarilla", "Woodie", "Demark"):
            if any(n.startswith(f"Pivot.M.{kind}.") for n in asked):
                found = found.join(latest(pivots(months, kind)).drop("bar_start"), "symbol", "left")
    out = wire_fields(asked, timeframe) if wire else asked
    return found.select("symbol", *(q(n).alias(o) for n, o in zip(asked, out, strict=True)))


#: Indicators by script id and version, with their default inputs.
REGISTRY: dict[str, tuple[str, Callable[..., DataFrame], dict]] = {}


def register(script: str, version: str, fn: Callable[..., DataFrame], **defaults) -> None:
    """fn(bars, **inputs) -> DataFrame answers requests for the script."""
    REGISTRY[script] = (version, fn, defaults)


def request(bars: DataFrame, script: str, version: str | None = None, **inputs) -> DataFrame | None:
    """The indicator's DataFrame, or None (as the caller skips it) for an unknown script or version."""
    known = REGISTRY.get(script)
    if known is None or version is not None and known[0] != version:
        return None
    return known[1](bars, **{**known[2], **inputs})


register("STD;RSI", "37.0", lambda bars: exponential(bars).select("symbol", "bar_start", "RSI"))
register("STD;MACD", "31.0", lambda bars: exponential(bars).select("symbol", "bar_start", "`MACD.macd`", "`MACD.signal`"))
register("STD;CCI", "37.0", lambda bars, n: cci(bars, n), n=20)
