import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from finscan.operators import bars as B
from finscan.operators import events_calendar
from finscan.operators import indicators as I
from finscan.streaming import live

T0 = datetime(2024, 1, 1)


def test_bars_take_first_and_last_by_time_then_sequence(spark):
    rows = [("S", T0 + timedelta(minutes=m), i, p, 1.0) for i, (m, p) in enumerate([(5, 3.0), (5, 4.0), (1, 9.0), (59, 2.0), (61, 7.0)])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, price double, qty double")
    got = [tuple(r)[2:] for r in B.bars(df, "1h").orderBy("bar_start").collect()]
    assert got == [(9.0, 9.0, 2.0, 2.0, 4.0, 4), (7.0, 7.0, 7.0, 7.0, 1.0, 1)]
    with pytest.raises(ValueError):
        B.bars(df, "7h")


@pytest.fixture(scope="module")
def series(spark):
    rows = [("S", T0 + timedelta(hours=4 * i), 10.0 + i % 5, 12.0 + i % 5, 9.0 + i % 3, 10.5 + i % 7, float(i % 4)) for i in range(60)]
    rows += [("flat", T0 + timedelta(hours=4 * i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(40)] + [("short", T0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "symbol string, bar_start timestamp_ntz, open double, high double, low double, close double, volume double")


def test_windows_wait_until_they_are_full(series):
    got = I.averages(series, (10,)).orderBy("symbol", "bar_start").collect()
    mine = [r["SMA10"] for r in got if r.symbol == "S"]
    closes = [r["close"] for r in got if r.symbol == "S"]
    assert mine[:9] == [None] * 9 and mine[9] == pytest.approx(sum(closes[:10]) / 10)
    assert [r["SMA10"] for r in got if r.symbol == "short"] == [None]


def test_no_range_and_no_volume_give_nulls(series):
    rows = I.latest(I.all_indicators(series)).where("symbol = 'flat'").collect()[0]
    assert rows["Stoch.K"] is None and rows["VWMA"] is None and rows["CCI20"] is None and rows["W.R"] is None and rows["RSI"] is None
    assert rows["EMA10"] == 5.0 and rows["Recommend.MA"] == 0.0
    short = I.latest(I.all_indicators(series)).where("symbol = 'short'").collect()[0]
    assert short["RSI"] is None and short["EMA200"] == 1.0


def test_recursion_is_that_of_the_definition(series):
    got = I.exponential(series).where("symbol = 'S'").orderBy("bar_start").collect()
    closes = [r["close"] for r in series.where("symbol = 'S'").orderBy("bar_start").collect()]
    ema = closes[0]
    for c, r in zip(closes, got, strict=True):
        ema = ema + 2 / 11 * (c - ema) if r is not got[0] else ema
        assert r["EMA10"] == pytest.approx(ema)


def test_registry(series):
    assert I.request(series, "STD;RSI", "37.0").columns == ["symbol", "bar_start", "RSI"]
    assert I.request(series, "STD;Nothing") is None and I.request(series, "STD;RSI", "1.0") is None
    assert "CCI5" in I.request(series, "STD;CCI", n=5).columns


def test_gaps_last_bars_and_as_of(spark, series):
    some = series.where("symbol = 'S' and hour(bar_start) <> 8")
    filled = B.gap_filled(some, "4h").orderBy("bar_start").collect()
    assert len(filled) == 60 and filled[2]["volume"] == 0 and filled[2]["open"] == filled[1]["close"]
    last = B.last_bars(series, 3).where("symbol = 'S'").orderBy("index").collect()
    assert [r["index"] for r in last] == [0, 1, 2] and last[-1]["bar_start"] == T0 + timedelta(hours=4 * 59)
    quotes = spark.createDataFrame([("S", T0, 1.0), ("S", T0 + timedelta(hours=5), 2.0)], "symbol string, ts timestamp_ntz, price double")
    left = spark.createDataFrame([("S", T0 - timedelta(hours=1)), ("S", T0), ("S", T0 + timedelta(hours=6))], "symbol string, ts timestamp_ntz")
    assert [r["as_of_price"] for r in B.as_of(left, quotes).orderBy("ts").collect()] == [None, 1.0, 2.0]


def test_pivots_use_the_month_before(spark):
    rows = [("S", datetime(2024, m, 1), 1.0, 9.0, 3.0, 6.0, 1.0) for m in (1, 2)]
    months = spark.createDataFrame(rows, "symbol string, bar_start timestamp_ntz, open double, high double, low double, close double, volume double")
    for kind, middle in (("Classic", 6.0), ("Woodie", 6.0), ("Demark", 27.0 / 4 if False else (2 * 9 + 3 + 6) / 4)):
        got = I.pivots(months, kind).orderBy("bar_start").collect()
        assert got[0][f"Pivot.M.{kind}.Middle"] is None and got[1][f"Pivot.M.{kind}.Middle"] == pytest.approx(middle)
    with pytest.raises(ValueError):
        I.pivots(months, "Other")


def test_calendar_window_and_falsy_values(spark):
    now = datetime(2025, 1, 10, 15, 30, tzinfo=UTC)
    low, high = events_calendar.default_window(now)
    assert (low, high) == (1736208000, 1736812799)
    rows = [("A:A", low, None, 0.0, ""), ("A:B", None, high, 1.0, "b"), ("A:C", low - 1, high + 1, 1.0, "c"), ("", low, low, 1.0, "d"), (None, low, low, 1.0, "e")]
    df = spark.createDataFrame(rows, "full_symbol string, dividend_ex_date_recent long, dividend_ex_date_upcoming long, dividends_yield double, name string")
    got = {r.full_symbol: r for r in events_calendar.calendar(df, "dividends", now=now).collect()}
    assert set(got) == {"A:A", "A:B"} and got["A:A"]["dividends_yield"] == 0.0 and len(got["A:A"]) == 13
    dropped = {r.full_symbol: r for r in events_calendar.calendar(df, "dividends", now=now, compat_drop_falsy=True).collect()}
    assert dropped["A:A"]["dividends_yield"] is None and dropped["A:A"]["name"] is None
    with pytest.raises(ValueError):
        events_calendar.calendar(df, "dividends", values=["nonsense"])
    with pytest.raises(ValueError):
        events_calendar.calendar(df, "splits")


def test_stream_equals_batch(spark):
    ticks = live.tick_stream(spark, "/root/testdata/sf0.001")
    got = live.run_once(live.live_bars(ticks, "4h"), "bars_test").count()
    from finscan.sources import views

    assert got == B.bars(views.ticks(spark, "/root/testdata/sf0.001"), "4h").count()


def test_live_quotes_merge_sparse_deltas(spark, tmp_path):
    spark.createDataFrame([("A", 1, "lp", "10"), ("A", 3, "lp", "12"), ("A", 2, "ch", "x"), ("A", 4, "ch", None), ("B", 1, "lp", "7")], "symbol string, seq long, field string, value string").coalesce(1).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("symbol string, seq long, field string, value string").parquet(str(tmp_path / "q"))
    got = {r.symbol: (r.seq, r.fields) for r in live.run_once(live.live_quotes(stream), "quotes_test", "update").collect()}
    assert got == {"A": (4, {"ch": "x", "lp": "12"}), "B": (1, {"lp": "7"})}


def test_stream_sessions_and_repeats(spark):
    ticks = live.tick_stream(spark, "/root/testdata/sf0.001")
    assert live.run_once(live.distinct_ticks(ticks).groupBy("symbol").agg(F.count("*").alias("n")), "distinct_test").agg(F.sum("n")).collect()[0][0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_requests_of_indicators(spark):
    ticks = spark.createDataFrame([("EX:A", T0 + timedelta(hours=i), i, 10.0 + i % 7, 1.0) for i in range(900)], "symbol string, ts timestamp_ntz, seq long, price double, qty double")
    ask = lambda *names, **k: I.snapshot(ticks, "ex", "a", "1h", list(names), **k)
    row = ask("RSI", "SMA10", "Pivot.M.Classic.Middle", "RSI").collect()
    assert len(row) == 1 and row[0].asDict().keys() == {"symbol", "RSI", "SMA10", "Pivot.M.Classic.Middle"} and None not in row[0]
    wire = ask("RSI", "SMA10", wire=True)
    assert wire.columns == ["symbol", "RSI|60", "SMA10|60"] and I.stripped(wire).columns == ["symbol", "RSI", "SMA10"]
    assert I.wire_fields(["RSI"], "1d") == ["RSI"] and I.wire_fields(["RSI", "close"], "1w") == ["RSI|1W", "close|1W"]
    assert len(ask(all_names=True).columns) == 82 and I.snapshot(ticks, "EX", "none", "1h", ["RSI"]).count() == 0
    for bad in (lambda: ask(), lambda: ask("RSI", "Nothing"), lambda: I.snapshot(ticks, "EX", "A", "7h", ["RSI"]), lambda: ask("RSI", exchanges=["NYSE"])):
        with pytest.raises(ValueError):
            bad()


def test_beta_and_year_to_date(spark):
    rng = random.Random(2)
    days = [datetime(2023, 11, 1) + timedelta(days=i) for i in range(120)]
    moves = {s: [rng.gauss(0, 1) for _ in days] for s in "AB"}
    rows = []
    for s, ms in moves.items():
        price = 100.0
        for day, m in zip(days, ms, strict=True):
            price *= 1 + m / 100
            rows.append((s, day, price, price, price, price, 1.0))
    bars = spark.createDataFrame(rows, "symbol string, bar_start timestamp_ntz, open double, high double, low double, close double, volume double")
    got = I.performance(bars).where("symbol = 'A'").orderBy("bar_start").collect()
    market = [(a + b) / 2 for a, b in zip(moves["A"], moves["B"], strict=True)][1:]
    mean = sum(market) / len(market)
    own = sum(moves["A"][1:]) / len(market)
    cov = sum((x - own) * (y - mean) for x, y in zip(moves["A"][1:], market, strict=True))
    assert got[-1]["beta_1_year"] == pytest.approx(cov / sum((y - mean) ** 2 for y in market)) and got[19]["beta_1_year"] is None and got[20]["beta_1_year"] is not None
    december = max(i for i, d in enumerate(days) if d.year == 2023)
    closes = [r["close"] for r in got]
    assert got[december]["Perf.YTD"] is None and got[-1]["Perf.YTD"] == pytest.approx(100 * (closes[-1] - closes[december]) / closes[december])


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """What a first run has taken is neither lost nor taken again by the next one."""
    put = lambda n, rows: spark.createDataFrame(rows, "event_type string, ts timestamp, event_id long, value double").coalesce(1).write.parquet(str(tmp_path / f"in/events-{n}.parquet"))
    at = lambda m: datetime(2024, 1, 1, 0, m)
    put(1, [("A", at(1), 1, 1.0), ("A", at(2), 2, 3.0), ("A", at(20), 3, 2.0)])
    schema = "event_type string, ts timestamp, event_id long, value double"

    def run():
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*.parquet"))
        ticks = rows.selectExpr("event_type symbol", "ts", "event_id seq", "value price", "1.0D qty")
        live.run_to_table(live.live_bars(ticks, "15m", late="2 hours"), f"file://{tmp_path}/out")
        return {(r.symbol, r.bar_start.minute): (r.open, r.high, r["close"], r.n) for r in live.current(spark, f"file://{tmp_path}/out", ["symbol", "bar_start"]).collect()}

    assert run() == {("A", 0): (1.0, 3.0, 3.0, 2), ("A", 15): (2.0, 2.0, 2.0, 1)}
    assert run() == {("A", 0): (1.0, 3.0, 3.0, 2), ("A", 15): (2.0, 2.0, 2.0, 1)}
    put(2, [("A", at(3), 4, 9.0), ("B", at(40), 5, 5.0)])
    assert run() == {("A", 0): (1.0, 9.0, 9.0, 3), ("A", 15): (2.0, 2.0, 2.0, 1), ("B", 30): (5.0, 5.0, 5.0, 1)}


def test_as_of_over_many_buckets(spark):
    """A quote may lie many buckets back; rows without a time or a key's quotes have none."""
    rng = random.Random(5)
    quotes = sorted((rng.choice("ABC"), T0 + timedelta(minutes=rng.randrange(60 * 24 * 40))) for _ in range(60))
    quotes = [(s, t, float(i)) for i, (s, t) in enumerate(dict.fromkeys(quotes))]
    left = [(rng.choice("ABCD"), T0 + timedelta(minutes=rng.randrange(60 * 24 * 45)), i) for i in range(200)] + [("A", None, 999)]
    got = B.as_of(spark.createDataFrame(left, "symbol string, ts timestamp_ntz, n int"), spark.createDataFrame(quotes, "symbol string, ts timestamp_ntz, price double"))
    want = {n: max(((t, p) for q, t, p in quotes if at is not None and q == s and t <= at), default=(None, None))[1] for s, at, n in left}
    assert {r.n: r.as_of_price for r in got.collect()} == want and got.count() == len(left)


def test_a_log_of_frames_is_a_stream(spark, tmp_path):
    """Files are taken once each, by a stream that is restarted, and give the packets that a batch read gives."""
    from finscan.functions import frames
    from finscan.streaming import source

    source.register(spark)
    log = tmp_path / "log"
    log.mkdir()
    put = lambda n, *messages: (log / f"{n}.log").write_text("\n".join(messages) + "\n" * (n % 2))
    put(1, frames.message("a", [1]) + frames.message("b", [2]), "~m~4~m~~h~1")
    read = lambda: spark.readStream.format("finscan_frames").option("path", f"file://{log}").load()

    def run():
        live.run_to_table(frames.decode(read()), f"file://{tmp_path}/out", "append")
        return sorted((r.seq, r.part, r.m) for r in spark.read.parquet(f"file://{tmp_path}/out/table").collect())

    assert run() == [(0, 1, "a"), (0, 2, "b")]
    put(2, frames.message("c", []), frames.message("é", []))
    (log / "_hidden").write_text("x")
    assert run() == [(0, 1, "a"), (0, 2, "b"), (1 << 32, 1, "c"), ((1 << 32) + 1, 1, "é")]
    assert run() == sorted((r.seq, r.part, r.m) for r in frames.decode(spark.read.format("finscan_frames").option("path", f"file://{log}").load()).collect())


def test_two_streams_meet(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([("A", at(5), 1, 1.0), ("A", at(30), 2, 2.0), ("B", at(5), 3, 3.0)], "symbol string, ts timestamp, seq long, price double").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("A", at(4), 9.0), ("A", at(2), 8.0), ("A", at(6), 7.0)], "symbol string, quoted_at timestamp, quote double").write.parquet(str(tmp_path / "q"))
    stream = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    found = live.matched(stream("t", "symbol string, ts timestamp, seq long, price double"), stream("q", "symbol string, quoted_at timestamp, quote double"), "2 minutes")
    live.run_to_table(found, f"file://{tmp_path}/out", "append")
    assert [(r.symbol, r.seq, r.quote) for r in spark.read.parquet(f"file://{tmp_path}/out/table").collect()] == [("A", 1, 9.0)]


def test_matched_rows_meet_by_time(spark):
    """The bound on time is part of the join's key: any span, rows on its edges and before 1970, times with and without zone; rows without a time meet none."""
    rng = random.Random(3)
    start = datetime(1969, 12, 31, 20)
    times = [start + timedelta(seconds=rng.randrange(8 * 3600)) for _ in range(150)] + [start + timedelta(minutes=90), start, None]
    trades = [(rng.choice("AB"), t, i, float(i)) for i, t in enumerate(times)]
    quotes = [(rng.choice("AB"), t, float(i)) for i, t in enumerate(times)] + [("A", start, -1.0), ("B", start, -2.0)]
    for kind in ("timestamp", "timestamp_ntz"):
        left, right = spark.createDataFrame(trades, f"symbol string, ts {kind}, seq long, price double"), spark.createDataFrame(quotes, f"symbol string, quoted_at {kind}, quote double")
        for within, span in (("90 minutes", timedelta(minutes=90)), ("0 seconds", timedelta()), ("3 seconds", timedelta(seconds=3)), ("2 days", timedelta(days=2))):
            found = live.matched(left, right, within)
            want = sorted((n, q) for s, t, n, _ in trades for z, u, q in quotes if s == z and t and u and t - span <= u <= t)
            assert sorted((r.seq, r.quote) for r in found.collect()) == want
    assert "__bucket" in found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner", 1)[1].split("\n")[0]
