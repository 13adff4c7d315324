"""Domain views over the star-schema tables: issuers, instruments, trades, ticks, calendar and feeds.

Sums of prices are taken over exact decimals, so their value does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finscan.functions.fields import q


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def issuers(spark: SparkSession, folder: str, symbols: list[str] | None = None) -> DataFrame:
    """One row a customer: a scannable instrument with prices from its orders.

    Orders are summed by customer before they are joined; nation and region are of fixed size. With
    symbols only those are read: their keys reach the scans of customers and orders.
    """
    customer, orders = read(spark, folder, "customer"), read(spark, folder, "orders")
    if symbols is not None:
        keys = _keys(symbols)
        customer, orders = customer.where(F.col("c_custkey").isin(keys)), orders.where(F.col("o_custkey").isin(keys))
    place = read(spark, folder, "nation").join(F.broadcast(read(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    price = F.col("o_totalprice")
    bars = orders.groupBy("o_custkey").agg(
        F.count("*").alias("volume"),
        F.sum(price.cast("decimal(18,2)")).alias("cap"),
        F.min_by(price, "o_orderkey").alias("open"),
        F.max_by(price, "o_orderkey").alias("last"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
    )
    rows = customer.join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).join(bars, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.select(
        F.concat_ws(":", "n_name", F.col("c_custkey").cast("string")).alias("symbol"),
        F.col("c_name").alias("name"),
        F.concat_ws(" ", "c_name", "n_name").alias("description"),
        F.lit("stock").alias("type"),
        F.col("n_name").alias("exchange"),
        F.col("n_name").alias("country"),
        F.lower("r_name").alias("market"),
        F.col("c_mktsegment").alias("sector"),
        F.col("c_acctbal").alias("close"),
        F.col("open"),
        F.col("high"),
        F.col("low"),
        F.coalesce("volume", F.lit(0)).alias("volume"),
        F.col("cap").cast("double").alias("market_cap_basic"),
        F.round(F.col("last") - F.col("open"), 4).alias("change_abs"),
        F.round(100 * (F.col("last") - F.col("open")) / F.col("open"), 4).alias("change"),
        F.round(100 * (F.col("high") - F.col("low")) / F.col("low"), 4).alias("Volatility.D"),
        F.col("cap").cast("double").alias("total_revenue"),
        F.col("last").alias("net_income"),
    )
    return rows if symbols is None else rows.where(F.col("symbol").isin(symbols))


def _keys(symbols: list[str]) -> list[int]:
    return [int(k) for k in (s.rpartition(":")[2] for s in symbols) if k.isdigit()]


ISSUERS_SQL = """issuers AS (
  SELECT n_name || ':' || CAST(c_custkey AS VARCHAR) AS symbol, c_name AS name, c_name || ' ' || n_name AS description, 'stock' AS type,
         n_name AS exchange, n_name AS country, lower(r_name) AS market, c_mktsegment AS sector, c_acctbal AS "close", "open", high, low,
         coalesce(volume, 0) AS volume, CAST(cap AS DOUBLE) AS market_cap_basic, round("last" - "open", 4) AS change_abs,
         round(100 * ("last" - "open") / "open", 4) AS change, round(100 * (high - low) / low, 4) AS "Volatility.D",
         CAST(cap AS DOUBLE) AS total_revenue, "last" AS net_income
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, count(*) AS volume, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS cap, arg_min(o_totalprice, o_orderkey) AS "open",
                    arg_max(o_totalprice, o_orderkey) AS "last", max(o_totalprice) AS high, min(o_totalprice) AS low
             FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


#: Orders of this year make the fields of a fiscal year.
FISCAL_YEAR = 1997
#: Days before an issuer's last order whose price its performance is measured from.
HORIZONS = {"Perf.W": 7, "Perf.1M": 30, "Perf.3M": 91, "Perf.6M": 182, "Perf.Y": 365}
_LINES = {"gross": "l_extendedprice", "disc": "l_extendedprice * l_discount", "tax": "l_extendedprice * l_tax"}
_NET, _EQUITY, _DEBT, _FREE = "(gross - disc - ret - tax)", "(cap + gross - disc - ret)", "(disc + ret)", "(gross - disc - tax - ret)"
_FY = lambda e: " ".join(f"{w}_fy" if w in ("cap", "gross", "disc", "tax", "ret") else w for w in e.replace("(", "( ").replace(")", " )").split())
#: Fields of an issuer's accounts as plain SQL over its orders (cap), line items (gross, disc, tax, ret: returned, qty, items) and balance (px).
ACCOUNTS = {
    "subtype": "'common'",
    "industry": "lower(segment)",
    "change_from_open": "100 * (lst - opn) / opn",
    "market_cap_calc": "cap",
    "market_cap_diluted_calc": "cap + gross",
    "shares_outstanding": "qty",
    "shares_float": "qty - items",
    "shares_diluted": "qty + items",
    "employees": "items",
    "price_earnings_ttm": f"px * qty / nullif({_NET}, 0)",
    "price_book_fq": f"px * qty / nullif({_EQUITY}, 0)",
    "price_sales_ttm": "cap / nullif(gross, 0)",
    "price_free_cash_flow_ttm": f"cap / nullif({_FREE}, 0)",
    "enterprise_value_fq": "cap + disc + ret - px",
    "earnings_per_share_basic_ttm": f"{_NET} / nullif(qty, 0)",
    "earnings_per_share_diluted_ttm": f"{_NET} / nullif(qty + items, 0)",
    "basic_eps_net_income": "lst / nullif(qty, 0)",
    "book_value_per_share_fq": f"{_EQUITY} / nullif(qty, 0)",
    "dividends_yield": "100 * tax / nullif(cap, 0)",
    "dividends_per_share_fq": "tax / nullif(qty, 0)",
    "dividend_payout_ratio_ttm": "100 * tax / nullif(gross - disc - ret, 0)",
    "revenue_per_share_ttm": "cap / nullif(qty, 0)",
    "total_revenue_fy": "cap_fy",
    "gross_profit": "gross - disc",
    "operating_income": "gross - disc - ret",
    "net_income_fy": _FY(_NET),
    "EBITDA": "gross - disc - ret + tax",
    "total_assets": "cap + gross",
    "cash_n_short_term_invest": "px + tax",
    "total_debt": _DEBT,
    "stockholders_equity": _EQUITY,
    "cash_f_operating_activities": "gross - disc - tax",
    "cash_f_investing_activities": "px - ret",
    "cash_f_financing_activities": "disc - tax",
    "free_cash_flow": _FREE,
    "gross_margin": "100 * (gross - disc) / nullif(gross, 0)",
    "operating_margin": "100 * (gross - disc - ret) / nullif(gross, 0)",
    "pretax_margin_percent_ttm": "100 * (gross - disc - ret) / nullif(cap, 0)",
    "net_margin": f"100 * {_NET} / nullif(gross, 0)",
    "EBITDA_margin": "100 * (gross - disc - ret + tax) / nullif(gross, 0)",
    "return_on_equity": f"100 * {_NET} / nullif({_EQUITY}, 0)",
    "return_on_assets": f"100 * {_NET} / nullif(cap + gross, 0)",
    "return_on_investment_ttm": f"100 * {_NET} / nullif(cap, 0)",
    "current_ratio": f"(px + tax + gross) / nullif({_DEBT}, 0)",
    "quick_ratio": f"(px + tax) / nullif({_DEBT}, 0)",
    "debt_to_equity": f"{_DEBT} / nullif({_EQUITY}, 0)",
    "debt_to_assets": f"{_DEBT} / nullif(cap + gross, 0)",
}
_OF_YEAR = ("gross_profit", "operating_income", "total_assets", "cash_n_short_term_invest", "total_debt", "stockholders_equity", "cash_f_operating_activities", "cash_f_investing_activities", "cash_f_financing_activities")
ACCOUNTS |= {f"{k}_fy": _FY(ACCOUNTS[k]) for k in _OF_YEAR}
ACCOUNTS |= {f"{k}_fq": ACCOUNTS[k] for k in ("return_on_equity", "return_on_assets", "current_ratio", "quick_ratio", "debt_to_equity")}
ACCOUNTS |= {"gross_margin_percent_ttm": ACCOUNTS["gross_margin"], "operating_margin_ttm": ACCOUNTS["operating_margin"], "net_margin_percent_ttm": ACCOUNTS["net_margin"]}


def accounts(spark: SparkSession, folder: str, symbols: list[str] | None = None) -> DataFrame:
    """Issuers with the fields of their accounts, and their performance from the prices of their orders.

    Line items are summed by order, and orders by customer, before anything is joined; dates and
    prices of a customer's orders are judged in the one shuffle that sums them.
    """
    base, orders, lines = issuers(spark, folder, symbols), read(spark, folder, "orders"), read(spark, folder, "lineitem")
    if symbols is not None:
        orders = orders.where(F.col("o_custkey").isin(_keys(symbols)))
        lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    money = lambda c, kind="decimal(18,2)": F.col(c).cast(kind)
    price = money("l_extendedprice")
    sums = lines.groupBy("l_orderkey").agg(
        F.sum(price).alias("gross"),
        F.sum(price * money("l_discount", "decimal(4,2)")).alias("disc"),
        F.sum(price * money("l_tax", "decimal(4,2)")).alias("tax"),
        F.sum(F.when(F.col("l_returnflag") == "R", price).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("ret"),
        F.sum("l_quantity").alias("qty"),
        F.count("*").alias("items"),
    )
    rows = orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("day", F.col("o_orderdate").cast("date"))
    rows = rows.withColumn("last_day", F.max("day").over(Window.partitionBy("o_custkey")))
    year, total = F.year("day") == FISCAL_YEAR, F.col("o_totalprice")
    exact = {"cap": total.cast("decimal(18,2)"), **{c: F.col(c) for c in ("gross", "disc", "tax", "ret")}}
    latest = lambda when: F.max_by(F.when(when, total), F.when(when, F.struct("day", "o_orderkey")))
    before = {k: F.col("day") <= F.date_sub("last_day", n) for k, n in HORIZONS.items()} | {"Perf.YTD": F.col("day") < F.trunc("last_day", "year")}
    within = F.col("day") >= F.date_sub("last_day", 364)
    found = rows.groupBy("o_custkey").agg(
        *(F.sum(c).cast("double").alias(k) for k, c in exact.items()),
        *(F.sum(F.when(year, c)).cast("double").alias(f"{k}_fy") for k, c in exact.items()),
        F.sum("qty").alias("qty"),
        F.sum("items").alias("items"),
        F.min_by(total, "o_orderkey").alias("opn"),
        F.max_by(total, "o_orderkey").alias("lst"),
        latest(F.col("day").isNotNull()).alias("now"),
        *(latest(w).alias(f"at_{k}") for k, w in before.items()),
        F.max(F.when(within, total)).alias("price_52_week_high"),
        F.min(F.when(within, total)).alias("price_52_week_low"),
    )
    perf = [(100 * (F.col("now") - q(f"at_{k}")) / F.nullif(q(f"at_{k}"), F.lit(0.0))).alias(k) for k in before]
    rows = base.withColumns({"px": F.col("close"), "segment": F.col("sector"), "o_custkey": F.split_part("symbol", F.lit(":"), F.lit(2)).cast("long")}).join(found, "o_custkey", "left")
    return rows.select(*map(q, base.columns), *(F.expr(e).alias(k) for k, e in ACCOUNTS.items()), "price_52_week_high", "price_52_week_low", *perf)


_EXACT = {"cap": "CAST(o_totalprice AS DECIMAL(18, 2))", **{c: c for c in ("gross", "disc", "tax", "ret")}}
_BEFORE = {k: f"day <= last_day - {n}" for k, n in HORIZONS.items()} | {"Perf.YTD": "day < date_trunc('year', last_day)"}
_ACCOUNT_COLUMNS = ", ".join(f'{e} AS "{k}"' for k, e in ACCOUNTS.items())
_PERF_COLUMNS = ", ".join(f'100 * (now - "at_{k}") / nullif("at_{k}", 0) AS "{k}"' for k in _BEFORE)
ACCOUNTS_SQL = f"""sums AS (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS gross, sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_discount AS DECIMAL(4, 2))) AS disc,
         sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_tax AS DECIMAL(4, 2))) AS tax, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE 0 END) AS ret,
         sum(l_quantity) AS qty, count(*) AS items FROM lineitem GROUP BY 1),
days AS (SELECT *, CAST(o_orderdate AS DATE) AS day, max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS last_day FROM orders LEFT JOIN sums ON o_orderkey = l_orderkey),
found AS (
  SELECT o_custkey, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {k}, CAST(sum({c}) FILTER (year(day) = {FISCAL_YEAR}) AS DOUBLE) AS {k}_fy' for k, c in _EXACT.items())},
         sum(qty) AS qty, CAST(sum(items) AS BIGINT) AS items, arg_min(o_totalprice, o_orderkey) AS opn, arg_max(o_totalprice, o_orderkey) AS lst, last(o_totalprice ORDER BY day, o_orderkey) AS now,
         {', '.join(f'last(o_totalprice ORDER BY day, o_orderkey) FILTER ({w}) AS "at_{k}"' for k, w in _BEFORE.items())},
         max(o_totalprice) FILTER (day >= last_day - 364) AS price_52_week_high, min(o_totalprice) FILTER (day >= last_day - 364) AS price_52_week_low
  FROM days GROUP BY 1),
accounts AS (
  SELECT i.*, {_ACCOUNT_COLUMNS}, price_52_week_high, price_52_week_low, {_PERF_COLUMNS}
  FROM (SELECT *, "close" AS px, sector AS segment, CAST(split_part(symbol, ':', 2) AS BIGINT) AS custkey FROM issuers) i LEFT JOIN found ON custkey = o_custkey)"""


def instruments(spark: SparkSession, folder: str) -> DataFrame:
    """One row a part: names repeat over exchanges."""
    part = read(spark, folder, "part")
    return part.select(
        F.concat_ws(":", "p_brand", F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("type"),
        F.col("p_brand").alias("exchange"),
        F.col("p_retailprice").alias("close"),
        F.lit("global").alias("market"),
        F.lit("USD").alias("currency"),
    )


INSTRUMENTS_SQL = """instruments AS (
  SELECT p_brand || ':' || CAST(p_partkey AS VARCHAR) AS symbol, p_name AS name, p_type AS type, p_brand AS exchange, p_retailprice AS "close", 'USD' AS currency FROM part)"""


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, ts, seq, price, qty): line items by brand. seq orders trades of one moment."""
    lines, part = read(spark, folder, "lineitem"), read(spark, folder, "part").select("p_partkey", "p_brand")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("ts"), seq.alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"))


TRADES_SQL = """trades AS (
  SELECT p_brand AS symbol, l_shipdate AS ts, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_extendedprice / l_quantity AS price, l_quantity AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, ts, seq, price, qty): events by type, one unit each."""
    return read(spark, folder, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("qty"))


TICKS_SQL = """ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, 1.0::DOUBLE AS qty FROM events)"""


def calendar_events(spark: SparkSession, folder: str) -> DataFrame:
    """One row an order: a recent and an upcoming date, an amount, a yield."""
    orders, lines = read(spark, folder, "orders"), read(spark, folder, "lineitem")
    ships = lines.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"), F.max("l_discount").alias("discount"))
    rows = orders.join(ships, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    epoch = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return rows.select(
        F.concat_ws(":", F.lit("ORD"), F.col("o_orderkey").cast("string")).alias("full_symbol"),
        epoch("o_orderdate").alias("dividend_ex_date_recent"),
        epoch("ship").alias("dividend_ex_date_upcoming"),
        F.col("o_totalprice").alias("dividend_amount_recent"),
        F.col("discount").alias("dividends_yield"),
        epoch("o_orderdate").alias("earnings_release_date"),
        epoch("ship").alias("earnings_release_next_date"),
        F.col("o_totalprice").alias("revenue_fq"),
        F.lower("o_orderstatus").alias("market"),
        F.col("o_orderpriority").alias("name"),
    )


CALENDAR_SQL = """calendar AS (
  SELECT 'ORD:' || CAST(o_orderkey AS VARCHAR) AS full_symbol, CAST(epoch(o_orderdate) AS BIGINT) AS recent, CAST(epoch(ship) AS BIGINT) AS upcoming,
         o_totalprice AS amount, discount AS yield, lower(o_orderstatus) AS market, o_orderpriority AS name
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS ship, max(l_discount) AS discount FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def headlines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as news: provider, language, section, symbol, urgency by length, a publication time by id; the title is the whole text."""
    d = read(spark, folder, "documents")
    section = F.element_at(F.array(*map(F.lit, NEWS_SECTIONS)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("title"),
        F.col("source").alias("provider"),
        F.col("lang").alias("language"),
        F.pmod("doc_id", F.lit(7)).alias("area_no"),
        section.alias("section"),
        F.concat(F.lit("NASDAQ:C"), F.pmod("doc_id", F.lit(20)).cast("string")).alias("symbol"),
        (F.col("doc_id") * 7919 % 100003).alias("published"),
        (F.col("n_chars") % 5).alias("urgency"),
    )


NEWS_SECTIONS = ("general", "esg", "financial_statement", "press_release")
HEADLINES_SQL = """headlines AS (SELECT doc_id AS id, text AS title, source AS provider, lang AS language, doc_id % 7 AS area_no,
  CASE doc_id % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'esg' WHEN 2 THEN 'financial_statement' ELSE 'press_release' END AS section, 'NASDAQ:C' || CAST(doc_id % 20 AS VARCHAR) AS symbol,
  doc_id * 7919 % 100003 AS published, n_chars % 5 AS urgency FROM documents)"""


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as community posts."""
    c = read(spark, folder, "conversations")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uid"),
        F.col("text"),
        F.col("role").alias("username"),
        F.concat(F.lit("NASDAQ:C"), (F.col("conv_id") % 20).cast("string")).alias("symbol"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("created"),
        (F.length("text") % 50).cast("long").alias("total_likes"),
        (F.length("text") % 7).cast("long").alias("total_comments"),
    )


POSTS_SQL = """posts AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS uid, text, role AS username, 'NASDAQ:C' || CAST(conv_id % 20 AS VARCHAR) AS symbol,
         conv_id * 1000 + turn AS created, length(text) % 50 AS total_likes, length(text) % 7 AS total_comments FROM conversations)"""

__all__ = ["read", "issuers", "accounts", "instruments", "trades", "ticks", "calendar_events", "headlines", "posts", "q"]
