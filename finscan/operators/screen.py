"""Scans over a table of instruments: screener, movers, top lists, symbol search, snapshots, comparison.

Everything is one lazy DataFrame: filters and columns reach the Parquet scan, sort and range become
a top-k per task and a merge. Rows are ordered by the sort field, nulls last, then by symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscan.functions import fields as C
from finscan.functions.fields import q
from finscan.functions.predicates import apply_filters
from finscan.plans.spec import Filter, ScanQuery, SortKey, filter_of

PRESETS = {"penny-stocks": Filter("close", "less", 5)} | {f"{s}gainers": Filter("change", "greater", 0) for s in ("", "pre-market-", "after-hours-")} | {f"{s}losers": Filter("change", "less", 0) for s in ("", "pre-market-", "after-hours-")}
CATEGORIES = [*PRESETS, "most-active"]


@dataclass(frozen=True)
class Result:
    """A scan's rows, and on demand how many there are and how many there were before the range."""

    rows: DataFrame
    unlimited: DataFrame

    def total(self) -> int:
        return self.rows.count()

    def total_count(self) -> int:
        return self.unlimited.count()

    def envelope(self, *, empty_fails: bool = False, limit: int = 10_000) -> dict:
        """Driver-side reply for small results; more than ``limit`` rows are refused."""
        data = [r.asDict(True) for r in self.rows.limit(limit + 1).collect()]
        if len(data) > limit:
            raise ValueError(f"more than {limit} rows; use rows")
        if not data and empty_fails:
            return {"status": "failed", "error": "no data found"}
        return {"status": "success", "data": data, "total": len(data), "totalCount": self.total_count()}


class ScanEngine:
    """Scans over a table of instruments; markets names those that the table has besides the catalogue's."""

    def __init__(self, instruments: DataFrame, markets: tuple[str, ...] = ()):
        self.table, self.markets = instruments, tuple(markets)

    def _column(self, name: str):
        if name in self.table.columns:
            return q(name)
        if name not in C.known_fields():
            raise ValueError(f"unknown field {name!r}")
        return F.lit(None).cast("string" if name in C.TEXT_FIELDS else "double").alias(name)

    def _projected(self, df: DataFrame, columns) -> DataFrame:
        names = [c for c in dict.fromkeys(columns) if c != "symbol"]
        return df.select("symbol", *(self._column(c).alias(c) for c in names))

    def run(self, query: ScanQuery) -> Result:
        df = self.table
        if query.markets:
            df = df.where(q("market").isin(list(query.markets)))
        df = apply_filters(df, query.filters)
        sort = query.sort
        order = [F.col("symbol").asc_nulls_last()]
        if sort:
            key = self._column(sort.field)
            order.insert(0, key.desc_nulls_last() if sort.order == "desc" else key.asc_nulls_last())
        rows = df.orderBy(*order)
        if query.start:
            rows = rows.offset(query.start)
        if query.end is not None:
            rows = rows.limit(query.end - query.start)
        return Result(self._projected(rows, query.columns), df)

    def screen(self, market: str = "america", filters=(), columns=None, sort_by: str | None = None, sort_order: str = "desc", limit: int = 50, start: int = 0) -> Result:
        C.checked(market, [*C.MARKETS, *self.markets], "market")
        scope = () if market == "global" else (market,)
        sort = SortKey(sort_by, sort_order) if sort_by else None
        return self.run(ScanQuery(tuple(columns or C.default_columns(market)), tuple(map(filter_of, filters or ())), sort, start, start + limit, scope))

    def movers(self, market: str = "stocks-usa", category: str = "gainers", fields=None, limit: int = 50) -> Result:
        C.checked(market, list(C.MOVER_MARKETS), "market")
        if market.startswith("stocks"):
            C.checked(category, CATEGORIES, "category")
        scope = C.MOVER_MARKETS[market]
        preset = PRESETS.get(category)
        by = SortKey("volume") if category in ("most-active", "penny-stocks") else SortKey("change", "asc" if category.endswith("losers") else "desc")
        return self.run(ScanQuery(tuple(fields or C.MOVERS_DEFAULT), (preset,) if preset else (), by, 0, limit, (scope,) if scope else ()))

    def top_stocks(self, market: str = "america", by: str = "market_cap", columns=None, limit: int = 50) -> Result:
        C.checked(market, [*C.TOP_MARKETS, *self.markets], "market")
        field = C.SORT_ALIASES.get(by, by)
        C.checked(field, C.SORT_ALIASES.values(), "sort")
        scope = () if market == "global" else (market,)
        fixed = (Filter("type", "equal", "stock"), Filter("market_cap_basic", "nempty"))
        return self.run(ScanQuery(tuple(columns or C.TOP_DEFAULT), fixed, SortKey(field), 0, limit, scope))

    def symbol_markets(self, symbol: str, columns=None, scanner: str = "global", limit: int = 150) -> Result:
        C.checked(scanner, C.SYMBOL_SCANNERS, "scanner")
        scope = () if scanner == "global" else (scanner,)
        return self.run(ScanQuery(tuple(columns or C.SYMBOL_DEFAULT), (Filter("name", "match", symbol),), None, 0, limit, scope))

    def snapshot(self, symbol: str, fields=None) -> DataFrame:
        """One row of the fields of a symbol."""
        return self.snapshots(fields).where(q("symbol") == C.symbol_of(symbol))

    def snapshots(self, fields=None) -> DataFrame:
        """One row of the fields of every symbol."""
        return self._projected(self.table, fields or C.OVERVIEW_ALL)

    def overview(self, symbol: str, view: str) -> DataFrame:
        return self.snapshot(symbol, C.OVERVIEW_VIEWS[C.checked(view, C.OVERVIEW_VIEWS, "view")])

    def fundamentals(self, symbol: str, group: str | None = None) -> DataFrame:
        return self.snapshot(symbol, C.FUNDAMENTALS_ALL if group is None else C.FUNDAMENTALS[C.checked(group, C.FUNDAMENTALS, "group")])

    def compare(self, symbols: list[str], fields=None) -> DataFrame:
        """Long form (field, symbol, value) of numeric fields; unknown symbols have no rows."""
        names = [f for f in dict.fromkeys(fields or C.COMPARE_DEFAULT) if f not in C.TEXT_FIELDS]
        wanted = list(dict.fromkeys(map(C.symbol_of, symbols)))
        rows = self._projected(self.table.where(q("symbol").isin(wanted)), names)
        rows = rows.select("symbol", *(q(n).cast("double").alias(n) for n in names))
        return rows.unpivot(["symbol"], [q(n).alias(n) for n in names], "field", "value").select("field", "symbol", "value")

    def compare_wide(self, symbols: list[str], fields=None) -> DataFrame:
        """One row a field, one column a symbol."""
        wanted = list(dict.fromkeys(map(C.symbol_of, symbols)))
        return self.compare(symbols, fields).groupBy("field").pivot("symbol", wanted).agg(F.max("value"))

    def exchanges(self) -> DataFrame:
        """The exchanges that the table has."""
        return self.table.where(q("exchange").isNotNull()).select("exchange").distinct()

    def existing(self, symbols: DataFrame) -> DataFrame:
        """The symbols (column symbol) that the table has."""
        return symbols.withColumn("symbol", F.upper(F.trim("symbol"))).join(self.table.select("symbol"), "symbol", "left_semi")

    def missing(self, symbols: DataFrame) -> DataFrame:
        return symbols.withColumn("symbol", F.upper(F.trim("symbol"))).join(self.table.select("symbol"), "symbol", "left_anti")
