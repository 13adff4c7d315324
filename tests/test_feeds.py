import json
import re
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finscan import catalogue
from finscan.functions import fields, frames, stories
from finscan.functions.fields import q
from finscan.operators import feeds
from finscan.sources import export

DATA = "/root/testdata/sf0.001"


def test_posts_keep_wall_clock_text(spark):
    raw = [("1", "t", "u", ("bob", "/u/bob", None), c, {"a": "NASDAQ:A"} if i else None, None, 2, None, True) for i, c in enumerate(["2025-01-02T03:04:05Z", "2025-01-02T03:04:05+02:00", "garbage", ""])]
    df = spark.createDataFrame(raw, "uid string, text string, url string, author struct<username:string,uri:string,is_broker:boolean>, created string, symbols map<string,string>, total_likes int, total_comments int, modified boolean, hidden boolean")
    got = feeds.reshaped(df).collect()
    assert [r.created for r in got] == ["2025-01-02 03:04:05", "2025-01-02 03:04:05", "garbage", ""]
    assert got[1].created_at == datetime(2025, 1, 2, 1, 4, 5) and got[2].created_at is None
    assert got[0].symbols == [] and got[1].symbols == ["NASDAQ:A"] and got[0].total_likes == 0 and got[0].author.is_broker is False


def posts(spark):
    return spark.createDataFrame([(f"u{i}", "NASDAQ:A" if i % 2 else "NASDAQ:B", i % 5, i % 3, 1000 + i) for i in range(40)], "uid string, symbol string, total_likes int, total_comments int, created int")


def test_cursor_pages_add_up(spark):
    p = posts(spark)
    whole = [r.uid for r in feeds.all_minds(p, sort="popular", max_results=40).collect()]
    walked, after = [], None
    while page := feeds.minds(p, sort="popular", limit=7, after=after).collect():
        walked += [r.uid for r in page]
        after = (page[-1].sort_key, page[-1].uid)
    assert walked == whole and feeds.pages_of(40, 7) == 6
    assert feeds.minds(p, "nasdaq:a", limit=99).count() == 20
    assert feeds.minds(p, sort="trending", now=5000).first().sort_key > 0
    assert [r.uid for r in feeds.ideas(p, start=1, end=2, sort="recent", size=3).collect()] == ["u39", "u38", "u37", "u36", "u35", "u34"]
    for bad in (lambda: feeds.minds(p, sort="x"), lambda: feeds.ideas(p, sort="x"), lambda: feeds.headlines(p, sort="x")):
        with pytest.raises(ValueError):
            bad()


@given(st.lists(st.text(alphabet=st.characters(blacklist_characters="~", blacklist_categories=("Cs",)), max_size=20), max_size=4))
def test_frames_round_trip(texts):
    import re

    whole = "".join(frames.message("m", [t]) for t in texts)
    assert [json.loads(x)["p"] for x in re.split(frames.SPLIT, whole) if x] == [[t] for t in texts]


def chart(method, points):
    return frames.message(method, ["cs", {"sds_1": {"s": [{"i": i, "v": v} for i, v in points]}}]).replace('["cs",{', '["cs",{')


def packet(method, body):
    return frames.message(method, ["cs", json.dumps(body)])


def test_decoding(spark):
    bars = {"sds_1": {"s": [{"i": 0, "v": [1.0, 2.0, 3.0, 1.0, 2.5, 7.0]}, {"i": 1, "v": [2.0, 2.0, 3.0, 1.0, 2.5]}]}}
    again = {"sds_1": {"s": [{"i": 1, "v": [2.0, 2.0, 4.0, 1.0, 3.5, 9.0]}]}}
    study = {"st9": {"st": [{"i": i, "v": [float(i), 1.0, 2.0]} for i in range(11)]}, "st10": {"st": [{"i": 0, "v": [0.0, 1.0]}]}}
    rows = [(1, packet("timescale_update", bars)), (2, "~m~4~m~~h~1"), (3, packet("du", again) + "~m~4~m~~h~2" + packet("du", study)), (4, '~m~9~m~{"m": "du'), (5, frames.message("other", []))]
    packets = frames.decode(spark.createDataFrame(rows, "seq long, message string"))
    assert sorted((r.seq, r.m) for r in packets.collect() if r.m) == [(1, "timescale_update"), (3, "du"), (3, "du"), (5, "other")]
    assert [r.seq for r in packets.collect() if r.m is None] == [4]
    found = frames.candles(packets)
    assert found.where("volume is null").count() == 1
    assert {r["index"]: r.close for r in frames.snapshot(found).collect()} == {0: 2.5, 1: 3.5}
    names = spark.createDataFrame([("st9", "RSI"), ("st10", "CCI")], "study string, indicator string")
    got = frames.studies(packets, names).collect()
    assert len(got) == 11 and got[0].indicator == "RSI" and got[0].plots == [1.0, 2.0]


def test_quote_deltas(spark):
    rows = [(i, packet("qsd", {"n": "A:A", "s": "ok", "v": v})) for i, v in enumerate([{"lp": "1", "ch": "2"}, {"lp": "3"}, {"volume": None}])]
    state = frames.quote_state(frames.quotes(frames.decode(spark.createDataFrame(rows, "seq long, message string"))))
    assert {r.field: r.value for r in state.collect()} == {"lp": "3", "ch": "2"}


def test_positional_replies(spark):
    rows = [("A", '["x", 1.5, 2]'), ("B", '["y"]'), ("C", "[]"), ("D", '["z", 1, 2, 3, 4]')]
    got = {r.symbol: (r.name, r.close) for r in frames.positional(spark.createDataFrame(rows, "s string, d string"), ["name", "close"], {"close": "double"}).collect()}
    assert got == {"A": ("x", 1.5), "B": ("y", None), "D": ("z", 1.0)}


def test_stories():
    html = '<html><body><nav class="breadcrumbs"><a>News</a><a>Stocks</a></nav><article><h1>Title</h1><time datetime="Mon, 1 Jan 2024"></time><p>One <b>bold</b><p>Two &amp; three<img src="a.png" alt="A"></article><div class="tags"><a>t1</a></div></body></html>'
    s = stories.story(html)
    assert s["title"] == "Title" and s["breadcrumbs"] == "News > Stocks" and s["tags"] == ["t1"] and s["published"] == "Mon, 1 Jan 2024"
    assert [b["content"] for b in s["body"] if b["type"] == "text"] == ["One bold", "Two & three"] and [b["src"] for b in s["body"] if b["type"] == "image"] == ["a.png"]
    assert stories.story(None)["title"] is None


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("é", [1, 2], None)], "name string, list array<int>, nothing string")
    export.export(df, str(tmp_path / "j"))
    export.export(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["list"] == "[1,2]"
    assert json.loads("".join(f.read_text() for f in (tmp_path / "j").glob("part*"))) == {"name": "é", "list": [1, 2], "nothing": None}
    assert "é" in open(export.export_array(df, str(tmp_path / "a.json"))).read()
    assert export.export_name("ohlc", "BTC", "1m", now=datetime(2025, 1, 2, 3, 4, 5)) == "ohlc_btc_1m_20250102-030405"
    with pytest.raises(ValueError):
        export.export(df, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError):
        export.export_array(df.unionAll(df), str(tmp_path / "b.json"), limit=1)


def test_idea_cards(spark):
    html = '<article><a class="title-x1">A title</a><a class="paragraph-y">Some text</a><picture><img src="p.png"></picture><span class="card-author-z">by someone</span><span class="ellipsisContainer-q">12</span><button class="boostButton-a" aria-label="7 boosts"></button><time class="publication-date-b" datetime="2025-01-02">Jan 2</time><span class="idea-strategy-icon-c" title="Long"></span></article>'
    df = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    one, none = (r.card for r in stories.cards(df).orderBy("id").collect())
    assert tuple(one) == ("A title", "Some text", "p.png", "someone", 12, 7, "2025-01-02", True, "Long")
    assert tuple(none) == (None, None, None, None, 0, 0, None, False, None)


def test_requests_and_snapshots(spark):
    assert feeds.check_request(exchange="NASDAQ", area="asia")["area"] == "ASI"
    for bad in ({}, {"symbol": "A"}, {"exchange": "X", "exchanges": ["Y"]}, {"exchange": "X", "provider": "p"}, {"exchange": "X", "area": "moon"}, {"exchange": "X", "section": "s"}, {"exchange": "X", "sort": "s"}, {"exchange": "X", "language": "xx"}):
        with pytest.raises(ValueError):
            feeds.check_request(**bad)
    points = lambda n: {"sds_1": {"s": [{"i": i, "v": [1.0] * 6} for i in range(n)]}}
    rows = [(i, packet("timescale_update", points(i))) for i in range(1, 30)]
    packets = frames.decode(spark.createDataFrame(rows, "seq long, message string"))
    assert frames.bounded(packets, 5).count() == 5 and frames.bounded(packets, 99).count() == 17
    asked = spark.createDataFrame([("RSI",), ("CCI",)], "indicator string")
    assert [r.indicator for r in frames.missing_studies(asked, asked.where("indicator = 'RSI'")).collect()] == ["CCI"]


@pytest.mark.parametrize("sort", ["latest", "oldest", "most_urgent", "least_urgent"])
def test_whole_headlines(spark, sort):
    """All rows and whole titles, in the order of the feed."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = catalogue.queries()[f"headlines_{sort}"](spark, DATA).collect()
    key, down = feeds.NEWS_SORTS[sort]
    assert len(got) == len(docs) > 100 and all(r.title == docs[r.id].text for r in got)
    assert [r.id for r in got] == [r.id for r in sorted(got, key=lambda r: (-r[key] if down else r[key], r.id))]


@pytest.mark.parametrize("name", sorted(n for n in catalogue.queries() if n.startswith(("overview_", "fundamentals_")) and not n.endswith(("_one", "_long", "_pivot"))))
def test_whole_snapshots(spark, name):
    """All symbols, and values in the fields that accounts have."""
    found = catalogue.queries()[name](spark, DATA)
    assert found.count() == spark.read.parquet(f"{DATA}/customer.parquet").count()
    own = [c for c in found.columns if c in catalogue.OWN]
    counts = found.agg(*(F.count(q(c)).alias(c) for c in own)).first()
    assert len(own) >= 1 and all(counts), counts


def test_filters_of_a_request_are_applied(spark):
    news = spark.createDataFrame([(1, "NASDAQ:A", "esg"), (2, "NASDAQ:B", "esg"), (3, "NYSE:A", "general")], "id int, symbol string, section string").withColumn("published", F.col("id"))
    ids = lambda **k: [r.id for r in feeds.headlines(news, sort="oldest", **k).collect()]
    assert ids(symbol="a", exchange="nasdaq") == [1] and ids(symbol="NYSE:A") == [3] and ids(exchange="NASDAQ") == [1, 2]
    assert ids(section="esg", exchange="NASDAQ") == [1, 2] and ids(section="all") == [1, 2, 3] and ids(section="press_release") == []
    with pytest.raises(ValueError):
        ids(section="sports")


def test_links_are_part_of_their_paragraph():
    body = lambda html: [b["content"] for b in stories.story(f"<article>{html}</article>")["body"] if b["type"] == "text"]
    assert body("<p>see <a>the link</a> now</p>") == ["see the link now"]
    assert body("<p>one<br>two <b>three <a>four</a></b> five<p>six") == ["one two three four five", "six"]
    assert body("<ul><li>a <p>b</p> c</li><li><a>d</a></li></ul><a>alone</a>") == ["a", "b", "c", "d", "alone"]
    assert body("<blockquote><p>x</p><p>y <a>z</a></p></blockquote><nav><a>no</a></nav>") == ["x", "y z"]
    s = stories.story('<article><nav class="breadcrumb"><a>News</a> <a>More <b>still</b></a></nav><div class="symbolsContainer"><a>AAA</a></div><p>t<img src="i">u</p></article>')
    assert s["breadcrumbs"] == "News > More still" and s["related"] == ["AAA"]
    assert [(b["type"], b["content"] or b["src"]) for b in s["body"]] == [("text", "t"), ("image", "i"), ("text", "u")]


def test_bounded_counts_packets(spark):
    """Sparse sequence numbers, and several packets in one message."""
    points = lambda n: {"sds_1": {"s": [{"i": i, "v": [1.0] * 6} for i in range(n)]}}
    rows = [(i * 10, packet("du", points(1))) for i in range(30)]
    assert frames.bounded(frames.decode(spark.createDataFrame(rows, "seq long, message string")), 5).count() == 17
    rows = [(i, packet("du", points(9)) + packet("timescale_update", points(i))) for i in range(30)]
    packets = frames.decode(spark.createDataFrame(rows, "seq long, message string"))
    assert frames.bounded(packets, 3).count() == 8 and frames.bounded(packets, 99).count() == 17 and frames.bounded(packets, 99, 5).count() == 5


def test_protocol_messages():
    calls = [json.loads(re.split(frames.SPLIT, m)[1]) for m in frames.opening("qs_1", "cs_1")]
    assert [c["m"] for c in calls] == ["set_auth_token", "set_locale", "chart_create_session", "quote_create_session", "quote_set_fields", "quote_hibernate_all"]
    assert calls[4]["p"] == ["qs_1", *fields.QUOTE_FIELDS]
    info = {"inputs": [{"id": "text", "defval": "abc", "type": "text"}, {"id": "in_0", "defval": 14, "type": "integer"}], "pine": {"version": "37.0"}}
    study = frames.metadata("STD;RSI", info, "cs_1")
    body = study["p"][-1]
    assert study["m"] == "create_study" and study["p"][:4] == ["cs_1", "st9", "st1", "sds_1"]
    assert (body["text"], body["pineId"], body["pineVersion"], body["in_0"]) == ("abc", "STD;RSI", "37.0", {"v": 14, "f": True, "t": "integer"})
    calls = [json.loads(re.split(frames.SPLIT, m)[1]) for m in frames.subscription("qs_1", "cs_1", "nasdaq:a", "1h", 5, (study,))]
    assert [c["m"] for c in calls] == ["quote_add_symbols", "resolve_symbol", "create_series", "quote_fast_symbols", "create_study", "quote_hibernate_all"]
    assert calls[2]["p"][4:6] == ["60", 5] and json.loads(calls[0]["p"][1][1:])["symbol"] == "NASDAQ:A"
    with pytest.raises(ValueError):
        frames.subscription("q", "c", "A:B", "7h")


def test_small_parts(spark):
    assert export.news_category(symbol="A", provider="p") == "news_symbol" and export.news_category(provider="p") == "news_provider" and export.news_category() == "news_area"
    df = spark.createDataFrame([("A:A", 1.0), ("B:B", None)], "symbol string, close double")
    assert export.wrapped(df) == {"A:A": {"close": 1.0}, "B:B": {"close": None}}
    with pytest.raises(ValueError):
        export.wrapped(df, limit=1)
    assert [feeds.page_size(120, n) for n in (0, 50, 100, 120, 130)] == [50, 50, 20, 0, 0]
    urls = spark.createDataFrame([("https://x/?c=ab1&lang=en",), ("https://x/?lang=en",), ("",), (None,)], "url string")
    assert [r.c for r in urls.select(feeds.cursor_of("url").alias("c")).collect()] == ["ab1", None, None, None]
    parts = spark.createDataFrame([(" nasdaq:a ",), ("nasdaq",), (None,), ("a:b:c",)], "s string").select(fields.symbol_parts("s").alias("p")).collect()
    assert [tuple(r.p) for r in parts] == [("NASDAQ", "A"), (None, None), (None, None), (None, None)]
    assert fields.unsupported(["RSI", "x", "y", "x"], fields.INDICATORS) == ["x", "y"]


def test_references_without_a_semicolon_in_stories_and_their_sql(spark, tmp_path):
    """A title that was cut inside a reference is text up to its end in SQL; by HTML's own rule it is the character."""
    import duckdb

    page = "<article><h1>{}</h1><p>a &lt; b &amp;lt c &nosuch; &ampx;</p></article>"
    rows = [(i, page.format(t)) for i, t in enumerate(["The &amp;&amp", "The &am", "The &", "R&amp;D &quot", "&middot; &lt;b&gt; &quot;x&quot;"])]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in catalogue.queries()["story_extract"](spark, str(tmp_path)).orderBy("page_id").collect()]
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == con.sql(f"select * from ({catalogue.oracle_sql()['story_extract']}) order by page_id").fetchall()
    assert got[0][1] == "The &&amp" and stories.story(rows[0][1])["title"] == "The &&"
