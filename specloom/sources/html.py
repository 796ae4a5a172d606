"""Links and table rows out of stored HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract_links(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """(key, item): distinct first groups of the pattern in each page, lower-cased, trailing dots cut."""
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    items = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"\.+$", "")))
    return pages.select(key, F.explode(items).alias("item"))


def catalogue(links: DataFrame) -> DataFrame:
    return links.select("item").distinct()


def cell_text(cell: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.regexp_replace(cell, r"<[^>]+>", ""), r"\s+", " "), F.lit("&nbsp;"), F.lit(" ")))


def table_rows(pages: DataFrame, key: str, html: str, min_cells: int = 4) -> DataFrame:
    """(key, row, cells): table rows as arrays of non-empty cell texts; short rows are dropped."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    exploded = pages.select(key, F.posexplode_outer(rows).alias("row", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), cell_text)
    return exploded.select(key, "row", F.filter(cells, lambda c: c != "").alias("cells")).filter(F.size("cells") >= min_cells)


def review_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, number, title, category, superseded_by): data rows of a review table (numbered rows only)."""
    rows = table_rows(pages, key, html).filter(F.regexp_replace(F.get("cells", F.lit(0)), r"\.+$", "").rlike(r"^\d+$"))
    cell = [F.get("cells", F.lit(i)) for i in range(5)]
    nxt = F.coalesce(cell[4], F.lit(""))
    return rows.select(key, "row", cell[1].alias("number"), cell[2].alias("title"), cell[3].alias("category"),
                       F.when(nxt.rlike(r"^[-—\s]*$"), "").otherwise(nxt).alias("superseded_by"))
