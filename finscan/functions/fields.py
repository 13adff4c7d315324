"""Field catalogue: markets, field groups, timeframes and other enumerations of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markets, defaults and field groups of the scan model.
MARKETS = "america australia canada germany india israel italy luxembourg mexico spain turkey uk crypto forex cfd futures bonds global".split()
MOVER_MARKETS = {"stocks-usa": "america", "stocks-uk": "uk", "stocks-india": "india", "stocks-australia": "australia", "stocks-canada": "canada", "crypto": None, "forex": None, "bonds": None, "futures": None}
TOP_MARKETS = "america australia canada germany india uk crypto forex global".split()
SYMBOL_SCANNERS = "global america crypto forex cfd".split()
OPERATIONS = "greater less egreater eless equal nequal in_range not_in_range above below crosses crosses_above crosses_below has has_none_of match nempty".split()
SORT_ALIASES = {"market_cap": "market_cap_basic", "volume": "volume", "change": "change", "price": "close", "volatility": "Volatility.D"}

STOCK_DEFAULT = "name close change change_abs volume Recommend.All market_cap_basic price_earnings_ttm earnings_per_share_basic_ttm".split()
CRYPTO_DEFAULT = "name close change change_abs volume market_cap_calc Recommend.All".split()
FOREX_DEFAULT = "name close change change_abs Recommend.All".split()
MOVERS_DEFAULT = "name close change change_abs volume market_cap_basic price_earnings_ttm earnings_per_share_basic_ttm logoid description".split()
TOP_DEFAULT = [*STOCK_DEFAULT, "sector", "industry"]
SYMBOL_DEFAULT = "name close change change_abs volume exchange type description currency market_cap_basic".split()
COMPARE_DEFAULT = "total_revenue net_income EBITDA market_cap_basic price_earnings_ttm return_on_equity_fq debt_to_equity_fq".split()

OVERVIEW = {
    "profile": "name description type subtype exchange country sector industry".split(),
    "price": "close change change_abs change_from_open high low open volume Value.Traded price_52_week_high price_52_week_low".split(),
    "market": "market_cap_basic market_cap_calc market_cap_diluted_calc shares_outstanding shares_float shares_diluted".split(),
    "valuation": "price_earnings_ttm price_book_fq price_sales_ttm price_free_cash_flow_ttm earnings_per_share_basic_ttm earnings_per_share_diluted_ttm book_value_per_share_fq".split(),
    "dividend": "dividends_yield dividends_per_share_fq dividend_payout_ratio_ttm".split(),
    "financial": "total_revenue revenue_per_share_ttm net_income_fy gross_margin_percent_ttm operating_margin_ttm net_margin_percent_ttm return_on_equity_fq return_on_assets_fq return_on_investment_ttm debt_to_equity_fq current_ratio_fq quick_ratio_fq EBITDA employees".split(),
    "performance": "Perf.W Perf.1M Perf.3M Perf.6M Perf.Y Perf.YTD".split(),
    "volatility": "Volatility.D Volatility.W Volatility.M beta_1_year".split(),
    "technical": "Recommend.All RSI CCI20 ADX MACD.macd Stoch.K ATR".split(),
}
OVERVIEW_ALL = [f for group in OVERVIEW.values() for f in group]
OVERVIEW_VIEWS = {
    "profile": OVERVIEW["profile"],
    "statistics": OVERVIEW["market"] + OVERVIEW["valuation"] + OVERVIEW["dividend"],
    "financials": OVERVIEW["financial"],
    "performance": OVERVIEW["performance"],
    "technicals": OVERVIEW["technical"] + OVERVIEW["volatility"],
}
FUNDAMENTALS = {
    "income_statement": "total_revenue revenue_per_share_ttm total_revenue_fy gross_profit gross_profit_fy operating_income operating_income_fy net_income net_income_fy EBITDA basic_eps_net_income earnings_per_share_basic_ttm earnings_per_share_diluted_ttm".split(),
    "balance_sheet": "total_assets total_assets_fy cash_n_short_term_invest cash_n_short_term_invest_fy total_debt total_debt_fy stockholders_equity stockholders_equity_fy book_value_per_share_fq".split(),
    "cash_flow": "cash_f_operating_activities cash_f_operating_activities_fy cash_f_investing_activities cash_f_investing_activities_fy cash_f_financing_activities cash_f_financing_activities_fy free_cash_flow".split(),
    "margins": "gross_margin gross_margin_percent_ttm operating_margin operating_margin_ttm pretax_margin_percent_ttm net_margin net_margin_percent_ttm EBITDA_margin".split(),
    "profitability": "return_on_equity return_on_equity_fq return_on_assets return_on_assets_fq return_on_investment_ttm".split(),
    "liquidity": "current_ratio current_ratio_fq quick_ratio quick_ratio_fq".split(),
    "leverage": "debt_to_equity debt_to_equity_fq debt_to_assets".split(),
    "valuation": "market_cap_basic market_cap_calc market_cap_diluted_calc enterprise_value_fq price_earnings_ttm price_book_fq price_sales_ttm price_free_cash_flow_ttm".split(),
    "dividends": "dividends_yield dividends_per_share_fq dividend_payout_ratio_ttm".split(),
}
FUNDAMENTALS_ALL = [f for group in FUNDAMENTALS.values() for f in group]
DIVIDEND_CALENDAR = "dividend_ex_date_recent dividend_ex_date_upcoming logoid name description dividends_yield dividend_payment_date_recent dividend_payment_date_upcoming dividend_amount_recent dividend_amount_upcoming fundamental_currency_code market".split()
EARNINGS_CALENDAR = "earnings_release_next_date earnings_release_date logoid name description earnings_per_share_fq earnings_per_share_forecast_next_fq eps_surprise_fq eps_surprise_percent_fq revenue_fq revenue_forecast_next_fq market_cap_basic earnings_release_time earnings_release_next_time earnings_per_share_forecast_fq revenue_forecast_fq fundamental_currency_code market earnings_publication_type_fq earnings_publication_type_next_fq revenue_surprise_fq revenue_surprise_percent_fq".split()
TEXT_FIELDS = frozenset("name description type subtype exchange country sector industry logoid currency fundamental_currency_code market symbol full_symbol".split())
# Timeframes and their wire codes, areas, providers, languages and quote fields.
TIMEFRAMES = {"1m": "1", "5m": "5", "15m": "15", "30m": "30", "1h": "60", "2h": "120", "4h": "240", "1d": "", "1w": "1W", "1M": "1M"}
WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "2h": "2 hours", "4h": "4 hours", "1d": "1 day"}
AREAS = {"world": "WLD", "americas": "AME", "europe": "EUR", "asia": "ASI", "oceania": "OCN", "africa": "AFR"}
# The feed's own house provider comes besides, as a parameter (feeds.check_request(house=...)).
PROVIDERS = "the_block cointelegraph beincrypto newsbtc dow-jones cryptonews coindesk cryptoglobe zycrypto todayq cryptopotato u_today cryptobriefing coindar bitcoin_com".split()
LANGUAGES = "en de fr es it pt ru ja ko ar hi sv tr th vi id fa ch ms el he".split()
QUOTE_FIELDS = "ch chp current_session description local_description language exchange fractional is_tradable lp lp_time minmov minmove2 original_name pricescale pro_name short_name type update_mode volume currency_code rchp rtc".split()


def pivot_names() -> list[str]:
    levels = ("S3", "S2", "S1", "Middle", "R1", "R2", "R3")
    names = [f"Pivot.M.{kind}.{level}" for kind in ("Classic", "Fibonacci", "Camarilla", "Woodie") for level in levels]
    return [*names, "Pivot.M.Demark.S1", "Pivot.M.Demark.Middle", "Pivot.M.Demark.R1"]


def average_names() -> list[str]:
    return [f"{kind}{n}" for n in (10, 20, 30, 50, 100, 200) for kind in ("EMA", "SMA")]


# Names of indicators.
OSCILLATORS = "RSI RSI[1] Stoch.K Stoch.D Stoch.K[1] Stoch.D[1] CCI20 CCI20[1] ADX ADX+DI ADX-DI ADX+DI[1] ADX-DI[1] AO AO[1] AO[2] Mom Mom[1] MACD.macd MACD.signal Rec.Stoch.RSI Stoch.RSI.K Rec.WR W.R Rec.BBPower BBPower Rec.UO UO".split()
RATINGS = "Recommend.Other Recommend.All Recommend.MA".split()
MORE_AVERAGES = "Rec.Ichimoku Ichimoku.BLine Rec.VWMA VWMA Rec.HullMA9 HullMA9".split()
INDICATORS = [*RATINGS, *OSCILLATORS, average_names()[0], "close", *average_names()[1:], *MORE_AVERAGES, *pivot_names()]


def q(name: str) -> Column:
    """A column by its literal name: field names hold dots, brackets and signs."""
    return F.col("`" + name.replace("`", "``") + "`")


def known_fields() -> frozenset[str]:
    lists = (OVERVIEW_ALL, FUNDAMENTALS_ALL, STOCK_DEFAULT, CRYPTO_DEFAULT, FOREX_DEFAULT, MOVERS_DEFAULT, TOP_DEFAULT, SYMBOL_DEFAULT, DIVIDEND_CALENDAR, EARNINGS_CALENDAR, INDICATORS)
    return frozenset(f for names in lists for f in names) | {"symbol", "full_symbol", "market"}


def default_columns(market: str) -> list[str]:
    return {"crypto": CRYPTO_DEFAULT, "forex": FOREX_DEFAULT}.get(market, STOCK_DEFAULT)


def symbol_of(text: str) -> str:
    """EXCHANGE:SYMBOL, trimmed and in upper case."""
    symbol = (text or "").strip().upper()
    if symbol.count(":") != 1 or symbol.startswith(":") or symbol.endswith(":"):
        raise ValueError(f"symbol {text!r} is not of the form EXCHANGE:SYMBOL")
    return symbol


def symbol_parts(symbol: str | Column) -> Column:
    """EXCHANGE:SYMBOL as a struct of exchange and name; nulls where it is not of that form."""
    c = F.col(symbol) if isinstance(symbol, str) else symbol
    parts = F.split(F.upper(F.trim(c)), ":")
    good = F.size(parts) == 2
    return F.struct(F.when(good, parts[0]).alias("exchange"), F.when(good, F.get(parts, F.lit(1))).alias("name"))


def unsupported(names: list[str], allowed) -> list[str]:
    """The names that are not allowed, in their order."""
    known = set(allowed)
    return [n for n in dict.fromkeys(names) if n not in known]


def checked(name: str, allowed, what: str) -> str:
    if name not in allowed:
        raise ValueError(f"unsupported {what} {name!r}; one of {', '.join(map(str, allowed))}")
    return name


def all_known(names: list[str] | None, allowed) -> bool:
    """Whether names is a list with members, all of them allowed."""
    return bool(names) and set(names) <= set(allowed)
