"""A filtered listing as one plan: filters, order, page, categories."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators.intervals import overlaps
from ..operators.search import fulltext_prefix, has_category
from ..operators.windows import placed_within


@dataclass(frozen=True)
class CatalogFilter:
    """What a listing asks for; every part may be left out, and all must hold."""

    text: str | None = None
    place: str | None = None
    kind: str | None = None
    audience: str | None = None
    price: str | None = None
    first: datetime.date | None = None
    last: datetime.date | None = None


#: Price classes; another one gives no rows.
PRICES = ("free", "paid", "unknown")


def filter_catalog(records: DataFrame, bridge: DataFrame, wanted: CatalogFilter) -> DataFrame:
    """The published records that meet every part of the filter, one row each."""
    out = records.filter("status = 'published'")
    if wanted.place is not None:
        out = out.filter(fold(F.col("place"), "slug") == wanted.place)
    if wanted.price is not None:
        out = out.filter(F.coalesce("price_type", F.lit("unknown")) == wanted.price if wanted.price in PRICES else F.lit(False))
    if wanted.first is not None or wanted.last is not None:
        out = out.filter(overlaps(F.lit(wanted.first or datetime.date.min), F.lit(wanted.last or datetime.date.max)))
    for axis in ("kind", "audience"):
        if (value := getattr(wanted, axis)) is not None:
            out = has_category(out, bridge, axis, value)
    if wanted.text is not None:
        out = fulltext_prefix(out, "id", wanted.text, "title", "place")
    return out


def catalog_order(records: DataFrame) -> DataFrame:
    return records.orderBy("start_at", fold(F.col("title")), "id")


def page_slice(records: DataFrame, page: int, size: int = 20) -> DataFrame:
    """The rows of one page with the number of all; a page beyond the ends becomes the nearest one."""
    total = records.count()
    page = min(max(1, page), max(1, -(-total // size)))
    return catalog_order(records).offset((page - 1) * size).limit(size).withColumns({"page": F.lit(page), "total": F.lit(total).cast("long")})


def attach_categories(records: DataFrame, bridge: DataFrame, key: str = "id") -> DataFrame:
    """Each record with its categories in the order of axis and name, as one text a row."""
    lists = bridge.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("axis", "category"))).alias("_c"))
    return records.join(lists, key, "left").withColumn(
        "categories", F.coalesce(F.array_join(F.transform("_c", lambda c: F.concat_ws(":", c["axis"], c["category"])), ","), F.lit(""))
    ).drop("_c")


def week_position(records: DataFrame) -> DataFrame:
    """The place of each record within its week, by start, title and id, from 1.

    Ranges of weeks and order are numbered (``placed_within``), so that no week has to fit one task.
    """
    rows = records.withColumn("_title", fold(F.col("title")))
    return placed_within(rows, "week_start", "start_at", "_title", "id", name="position").drop("_title")
