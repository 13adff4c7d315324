"""Sinks: JSON Lines and CSV folders, and one pretty JSON array for small results."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finscan.functions.fields import checked, q


def export_name(category: str, symbol: str | None = None, timeframe: str | None = None, *, now: datetime | None = None) -> str:
    parts = [category, symbol.lower() if symbol else None, timeframe, (now or datetime.now()).strftime("%Y%m%d-%H%M%S")]
    return "_".join(p for p in parts if p)


def news_category(*, symbol: str | None = None, provider: str | None = None) -> str:
    """What an export of news is filed under: the symbol asked for, else the provider, else the area."""
    return "news_symbol" if symbol else "news_provider" if provider else "news_area"


def wrapped(df: DataFrame, key: str = "symbol", limit: int = 1000) -> dict:
    """A comparison as one object: each symbol with its fields (driver-side, at most ``limit`` rows)."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; use export()")
    return {r[key]: {k: v for k, v in r.asDict(True).items() if k != key} for r in rows}


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which CSV can hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(q(f.name)).alias(f.name) if isinstance(f.dataType, nested) else q(f.name) for f in df.schema.fields))


def export(df: DataFrame, folder: str, kind: str = "json", *, mode: str = "errorifexists") -> str:
    checked(kind, ("json", "csv"), "export type")
    if kind == "csv":
        flat(df).write.mode(mode).option("header", True).csv(folder)
    else:
        df.write.mode(mode).option("ignoreNullFields", False).json(folder)
    return folder


def export_array(df: DataFrame, path: str, limit: int = 100_000) -> str:
    """One indented JSON array on the driver; more than ``limit`` rows are refused."""
    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; use export()")
    Path(path).write_text(json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False), encoding="utf-8")
    return path
