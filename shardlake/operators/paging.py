"""Pages by offset and by key."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import ShardQuery


@dataclass(frozen=True)
class Page:
    items: DataFrame
    total: int
    per_page: int
    page: int
    path: str = ""
    page_name: str = "page"

    @property
    def last_page(self) -> int:
        return max(1, -(-self.total // self.per_page))

    @property
    def has_more(self) -> bool:
        return self.page < self.last_page


def page_frame(query: ShardQuery, page: int, per_page: int = 15, *columns: str) -> DataFrame:
    """The rows of a page: one job keeps the best ``page * per_page`` rows of each partition.

    Pages without an order are those of the shards' order, so that each row is on one page.
    """
    query = query if query.orders else query.in_shard_order()
    return replace(query, skipped=(max(page, 1) - 1) * per_page, limited=per_page).get(*columns)


def paginate(query: ShardQuery, page: int = 1, per_page: int = 15, *columns: str, path: str = "", page_name: str = "page") -> Page:
    return Page(page_frame(query, page, per_page, *columns), query.count(), per_page, max(page, 1), path, page_name)


def cursor_frame(query: ShardQuery, per_page: int = 15, column: str = "id", direction: str = "asc", cursor: Any = None, *columns: str) -> DataFrame:
    """Rows strictly past ``cursor``. Rows that tie with it are passed over: use a unique column."""
    up = direction.lower() == "asc"
    if cursor is not None:
        query = query.where(F.col(column) > cursor if up else F.col(column) < cursor)
    return replace(query, orders=(), skipped=0).order_by(column, "asc" if up else "desc").limit(per_page).get(*columns)
