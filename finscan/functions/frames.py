"""The wire frames of the streaming protocol: ~m~<length>~m~<payload>, several to a message."""

from __future__ import annotations

import json
import secrets
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finscan.functions.fields import QUOTE_FIELDS, TIMEFRAMES, checked, symbol_of

# Fixed values of the protocol.
HEARTBEAT = r"^~m~\d+~m~~h~\d+$"
SPLIT = r"~m~\d+~m~"


def frame(payload: Column) -> Column:
    return F.concat(F.lit("~m~"), F.length(payload).cast("string"), F.lit("~m~"), payload)


def message(method: str, parameters: list) -> str:
    """One framed call, encoded on the driver."""
    body = json.dumps({"m": method, "p": parameters}, separators=(",", ":"))
    return f"~m~{len(body)}~m~{body}"


def session_id(prefix: str) -> str:
    return prefix + "_" + "".join(secrets.choice(string.ascii_lowercase) for _ in range(12))


def opening(quote_session: str, chart_session: str, token: str = "unauthorized_user_token", locale: tuple[str, str] = ("en", "US")) -> list[str]:
    """The framed calls that open a quote session and a chart session."""
    calls = [("set_auth_token", [token]), ("set_locale", list(locale)), ("chart_create_session", [chart_session, ""]), ("quote_create_session", [quote_session])]
    calls += [("quote_set_fields", [quote_session, *QUOTE_FIELDS]), ("quote_hibernate_all", [quote_session])]
    return [message(m, p) for m, p in calls]


def subscription(quote_session: str, chart_session: str, symbol: str, timeframe: str = "1m", candles_wanted: int = 10, studies_: tuple[dict, ...] = ()) -> list[str]:
    """The framed calls that ask for a symbol's quotes, its last candles, and studies (metadata() of each)."""
    code = TIMEFRAMES[checked(timeframe, TIMEFRAMES, "timeframe")] or "1D"
    name = symbol_of(symbol)
    resolved = "=" + json.dumps({"adjustment": "splits", "symbol": name})
    calls = [("quote_add_symbols", [quote_session, resolved]), ("resolve_symbol", [chart_session, "sds_sym_1", resolved])]
    calls += [("create_series", [chart_session, "sds_1", "s1", "sds_sym_1", code, candles_wanted, ""]), ("quote_fast_symbols", [quote_session, name])]
    calls += [(s["m"], s["p"]) for s in studies_]
    return [message(m, p) for m, p in [*calls, ("quote_hibernate_all", [quote_session])]]


def metadata(script: str, info: dict, chart_session: str, study: str = "st9") -> dict:
    """The call that creates a study, from a script's description: its text, version, and default inputs (ids in_...)."""
    inputs = info.get("inputs", [])
    fixed = lambda value, kind: {"v": value, "f": True, "t": kind}
    body = {"text": inputs[0]["defval"] if inputs else "", "pineId": script, "pineVersion": info.get("pine", {}).get("version", "1.0")}
    body |= {"pineFeatures": fixed('{"indicator":1,"plot":1,"ta":1}', "text"), "__profile": fixed(False, "bool")}
    body |= {i["id"]: fixed(i["defval"], i["type"]) for i in inputs if i["id"].startswith("in_")}
    return {"m": "create_study", "p": [chart_session, study, "st1", "sds_1", "Script@tv-scripting-101!", body]}


def decode(messages: DataFrame, text: str = "message", order: str = "seq") -> DataFrame:
    """(seq, part, m, p): the packets of all messages; heartbeats go, damaged packets keep null m.

    Stateless, so it serves batch and streaming alike. A heartbeat that shares a message with data
    does not take the data with it.
    """
    rows = messages.where(~F.col(text).rlike(HEARTBEAT))
    parts = rows.select(order, F.posexplode(F.split(text, SPLIT)).alias("part", "payload"))
    parts = parts.where((F.col("payload") != "") & ~F.col("payload").rlike(r"^~h~\d+$"))
    packet = F.from_json("payload", "m string, p array<string>")
    return parts.select(order, "part", packet["m"].alias("m"), packet["p"].alias("p"))


def candles(packets: DataFrame, order: str = "seq") -> DataFrame:
    """(seq, index, timestamp, open, high, low, close, volume) of chart packets; volume may be missing."""
    rows = packets.where(F.col("m").isin("timescale_update", "du"))
    series = F.from_json(F.get("p", F.lit(1)), "map<string, struct<s: array<struct<i: int, v: array<double>>>>>")
    points = rows.select(order, "m", F.inline(F.element_at(series, "sds_1")["s"]))
    value = lambda i: F.get("v", F.lit(i))
    names = ("timestamp", "open", "high", "low", "close", "volume")
    return points.select(order, "m", F.col("i").alias("index"), *(value(j).alias(n) for j, n in enumerate(names)))


def studies(packets: DataFrame, names: DataFrame, order: str = "seq", least: int = 10) -> DataFrame:
    """(seq, indicator, index, timestamp, plots) of study packets with more than ``least`` points and a known name.

    names: (study, indicator), one row a subscribed study.
    """
    rows = packets.where(F.col("m") == "du")
    series = F.from_json(F.get("p", F.lit(1)), "map<string, struct<st: array<struct<i: int, v: array<double>>>>>")
    found = rows.select(order, F.explode(series).alias("study", "data")).where(F.size("data.st") > least).join(names, "study")
    points = found.select(order, "indicator", F.inline("data.st"))
    return points.select(order, "indicator", F.col("i").alias("index"), F.get("v", F.lit(0)).alias("timestamp"), F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))).alias("plots"))


def snapshot(candles_: DataFrame, order: str = "seq") -> DataFrame:
    """The latest version of each bar: last write wins."""
    return candles_.groupBy("index").agg(F.max_by(F.struct("timestamp", "open", "high", "low", "close", "volume"), order).alias("bar")).select("index", "bar.*")


def quotes(packets: DataFrame, order: str = "seq") -> DataFrame:
    """(seq, symbol, field, value): one row for each field that a quote packet carries."""
    rows = packets.where(F.col("m") == "qsd")
    body = F.from_json(F.get("p", F.lit(1)), "n string, s string, v map<string, string>")
    return rows.select(order, body["n"].alias("symbol"), F.explode(body["v"]).alias("field", "value"))


def quote_state(deltas: DataFrame, order: str = "seq") -> DataFrame:
    """(symbol, field, value): the last value that is not null."""
    return deltas.where(F.col("value").isNotNull()).groupBy("symbol", "field").agg(F.max_by("value", order).alias("value"))


def positional(replies: DataFrame, columns: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Scan replies (s string, d string: a JSON array) as named columns.

    Missing tail values are null, surplus ones go, rows without values go.
    """
    values = F.from_json("d", "array<string>")
    rows = replies.withColumn("__d", values).where(F.size("__d") > 0)
    get = lambda i, c: F.get("__d", F.lit(i)).try_cast((kinds or {}).get(c, "string")).alias(c)
    return rows.select(F.col("s").alias("symbol"), *(get(i, c) for i, c in enumerate(columns)))


def bounded(packets: DataFrame, candles_wanted: int, most: int = 17, order: str = "seq") -> DataFrame:
    """The first packets up to the one that completes the wanted number of candles, ``most`` packets at most."""
    head = packets.orderBy(order, "part").limit(most)
    series = F.from_json(F.get("p", F.lit(1)), "map<string, struct<s: array<struct<i: int>>>>")
    complete = (F.col("m") == "timescale_update") & (F.size(F.element_at(series, "sds_1")["s"]) >= candles_wanted)
    place = F.struct(order, "part")
    # All rows of head, no more than most, share one window.
    cut = F.min(F.when(complete, place)).over(Window.partitionBy(F.lit(0)))
    return head.withColumn("__cut", cut).where(F.col("__cut").isNull() | (place <= F.col("__cut"))).drop("__cut")


def merged(deltas: DataFrame, order: str = "seq") -> DataFrame:
    """(symbol, fields): the quote of each symbol as one map, later values over earlier ones."""
    return quote_state(deltas, order).groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def missing_studies(requested: DataFrame, received: DataFrame) -> DataFrame:
    """Requested indicators (column indicator) of which nothing has come."""
    return requested.join(received.select("indicator").distinct(), "indicator", "left_anti")
