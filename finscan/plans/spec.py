"""Query specifications: filters, sort keys and scans, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from finscan.functions.fields import OPERATIONS, checked


@dataclass(frozen=True)
class Filter:
    """left (a field, or several for in_range: any of them) compared with right (literal, list, or a field as {"field": name})."""

    left: str | tuple[str, ...]
    operation: str
    right: Any = None

    def __post_init__(self):
        checked(self.operation, OPERATIONS, "operation")
        if isinstance(self.left, str) and "," in self.left:
            object.__setattr__(self, "left", tuple(x.strip() for x in self.left.split(",")))
        if self.operation in ("in_range", "not_in_range") and (not isinstance(self.right, list | tuple) or not self.right):
            raise ValueError(f"{self.operation} needs a list of values")

    @property
    def fields(self) -> tuple[str, ...]:
        left = self.left if isinstance(self.left, tuple) else (self.left,)
        return (*left, self.right["field"]) if isinstance(self.right, dict) else left


@dataclass(frozen=True)
class SortKey:
    field: str
    order: str = "desc"

    def __post_init__(self):
        checked(self.order, ("asc", "desc"), "sort order")


@dataclass(frozen=True)
class ScanQuery:
    """Columns of the rows that pass all filters, in order, from start to end (exclusive)."""

    columns: tuple[str, ...]
    filters: tuple[Filter, ...] = ()
    sort: SortKey | None = None
    start: int = 0
    end: int | None = 50
    markets: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.start < 0 or self.end is not None and self.end < self.start:
            raise ValueError("the range must be 0 <= start <= end")


def filter_of(node: dict | Filter) -> Filter:
    return node if isinstance(node, Filter) else Filter(node["left"], node["operation"], node.get("right"))
