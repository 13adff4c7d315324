"""Text feeds: news headlines, ideas and community posts, with pages and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finscan.functions import fields as C

NEWS_SORTS = {"latest": ("published", True), "oldest": ("published", False), "most_urgent": ("urgency", True), "least_urgent": ("urgency", False)}
POST_SORTS = ("recent", "popular", "trending")
IDEA_SORTS = ("popular", "recent")


NEWS_SECTIONS = ("all", "esg", "financial_statement", "press_release")


def check_request(*, symbol: str | None = None, exchange: str | None = None, provider: str | None = None, area: str | None = None, section: str = "all", sort: str = "latest", language: str = "en", exchanges=None, house: str | None = None) -> dict:
    """A news request whose parts are all supported; exchanges are those of the instrument table, if given; house names the feed's own provider."""
    if not exchange:
        raise ValueError("an exchange is needed, with or without a symbol")
    if exchanges is not None:
        C.checked(exchange, exchanges, "exchange")
    if provider:
        C.checked(provider, [*C.PROVIDERS, house], "provider")
    if area:
        C.checked(area, C.AREAS, "area")
    C.checked(section, NEWS_SECTIONS, "section")
    C.checked(sort, NEWS_SORTS, "sort")
    C.checked(language, C.LANGUAGES, "language")
    return {"symbol": symbol, "exchange": exchange, "provider": provider, "area": C.AREAS.get(area), "section": section, "sort": sort, "language": language}


def headlines(news: DataFrame, *, sort: str = "latest", provider: str | None = None, language: str | None = None, area: int | None = None, section: str | None = None, symbol: str | None = None, exchange: str | None = None, ordinal: str = "id") -> DataFrame:
    """Headlines of a provider, language, area, section, and symbol (EXCHANGE:SYMBOL, or a symbol of an exchange), sorted; ties keep the feed's order."""
    key, down = NEWS_SORTS[C.checked(sort, NEWS_SORTS, "sort")]
    rows = news
    if provider not in (None, "all"):
        rows = rows.where(F.col("provider") == provider.replace(".", "_"))
    if language not in (None, "all"):
        rows = rows.where(F.col("language") == language)
    if area is not None:
        rows = rows.where(F.col("area_no") == area)
    if section not in (None, "all"):
        rows = rows.where(F.col("section") == C.checked(section, NEWS_SECTIONS, "section"))
    if symbol is not None:
        rows = rows.where(F.col("symbol") == C.symbol_of(symbol if exchange is None else f"{exchange}:{symbol}"))
    elif exchange is not None:
        rows = rows.where(F.col("symbol").startswith(exchange.upper() + ":"))
    return rows.orderBy(F.desc(key) if down else F.asc(key), F.asc(ordinal))


def ideas(feed: DataFrame, *, start: int = 1, end: int = 1, sort: str = "popular", size: int = 20) -> DataFrame:
    """Pages start to end (from 1, inclusive) in one query. feed: uid, total_likes (boosts), created."""
    C.checked(sort, IDEA_SORTS, "sort")
    order = [F.desc("total_likes")] if sort == "popular" else [F.desc("created")]
    return feed.orderBy(*order, "uid").offset((start - 1) * size).limit((end - start + 1) * size)


def _key(sort: str, decay: float, now: int | None):
    popular = F.col("total_likes") + F.col("total_comments")
    if sort == "recent":
        return F.col("created")
    if sort == "popular":
        return popular
    age = F.lit(now) - F.col("created") if now is not None else F.lit(0)
    return popular / F.pow(1 + age / 3600.0, F.lit(decay))


def minds(posts: DataFrame, symbol: str | None = None, *, sort: str = "recent", limit: int = 50, after: tuple | None = None, decay: float = 1.5, now: int | None = None) -> DataFrame:
    """Posts (of a symbol) in order; after = (key, uid) of the last post of the page before.

    trending: likes and comments over (1 + age in hours) ** decay.
    """
    C.checked(sort, POST_SORTS, "sort")
    rows = posts if symbol is None else posts.where(F.col("symbol") == C.symbol_of(symbol))
    rows = rows.withColumn("sort_key", _key(sort, decay, now))
    if after is not None:
        key, uid = after
        rows = rows.where((F.col("sort_key") < key) | (F.col("sort_key") == key) & (F.col("uid") > uid))
    return rows.orderBy(F.desc("sort_key"), "uid").limit(limit)


def all_minds(posts: DataFrame, symbol: str | None = None, *, sort: str = "recent", max_results: int = 200) -> DataFrame:
    """What walking all pages gives, in one query."""
    return minds(posts, symbol, sort=sort, limit=max_results)


def pages_of(rows: int, page: int = 50) -> int:
    return -(-rows // page)


def page_size(wanted: int, had: int, page: int = 50) -> int:
    """How many rows the next page asks for."""
    return max(0, min(page, wanted - had))


def cursor_of(url: str | Column) -> Column:
    """The cursor in the address of the next page; null where there is none."""
    found = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"\?c=([^&]*)", 1)
    return F.nullif(found, F.lit(""))


def of_symbols(feed: DataFrame, symbol: str = "symbol") -> DataFrame:
    """The feed's rows that belong to a symbol, without it."""
    return feed.where(F.col(symbol).isNotNull()).drop(symbol)


def reshaped(raw: DataFrame) -> DataFrame:
    """Posts as the feed sends them (nested, ragged) in the shape of the data model.

    created keeps its wall-clock text where it parses, else the raw text; created_at is the instant.
    """
    created = F.col("created")
    naive = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(created, "(Z|[+-][0-9]{2}:?[0-9]{2})$", ""), "T", " "))
    author = F.struct(
        F.col("author.username").alias("username"),
        F.concat(F.lit("https://www.example.com"), F.coalesce(F.col("author.uri"), F.lit(""))).alias("profile_url"),
        F.coalesce(F.col("author.is_broker"), F.lit(False)).alias("is_broker"),
    )
    return raw.select(
        "uid",
        "text",
        "url",
        author.alias("author"),
        F.coalesce(F.date_format(naive, "yyyy-MM-dd HH:mm:ss"), created).alias("created"),
        F.try_to_timestamp(created).alias("created_at"),
        F.coalesce(F.map_values("symbols"), F.array().cast("array<string>")).alias("symbols"),
        *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total_likes", "total_comments")),
        *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("modified", "hidden")),
    )


def with_symbol_info(posts: DataFrame, info: DataFrame) -> DataFrame:
    """posts with the catalogue's entry for their symbol, if there is one."""
    return posts.join(info, "symbol", "left")


def search_indicators(registry: DataFrame, query: str) -> DataFrame:
    """Scripts whose name or author holds the text."""
    wanted = query.lower()
    return registry.where(F.lower("name").contains(wanted) | F.lower("author").contains(wanted))
