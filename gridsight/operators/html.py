"""Saved HTML pages: list items in general, and the two layouts of a master status page.

These expressions read fixed layouts; they are not a general HTML parser.
``pages`` has page_id and html.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class of the summary list, by version; any other version reads as the first.
SUMMARY_CLASS = {"3.0.3": "unstyled", "3.2.0": "list-unstyled"}
ITEM = r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"
TAG = r"<[^>]*>"


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, TAG, ""))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def list_items(pages: DataFrame) -> DataFrame:
    """H4: every list item of every page, with tags removed."""
    return pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ITEM), F.lit(1))).alias("position", "item")
    ).select("page_id", F.col("position").cast("bigint").alias("position"), strip_tags(F.col("item")).alias("item"))


def _last_value(items: Column, titles: list[str], title: str) -> Column:
    """Text of the last item whose title holds ``title`` and none of the titles tried before it."""
    earlier = titles[: titles.index(title)]

    def wanted(item: Column) -> Column:
        head = F.regexp_extract(item, r"(?is)<strong>(.*?)</strong>", 1)
        keep = F.contains(head, F.lit(title))
        for other in earlier:
            keep = keep & ~F.contains(head, F.lit(other))
        return keep

    found = F.try_element_at(F.filter(items, wanted), F.lit(-1))
    return squeeze(F.regexp_extract(found, r"(?is)</strong>([^<]*)", 1))


def master_summary(pages: DataFrame, version: str = "3.0.3") -> DataFrame:
    """H1: address, workers, cores, memory and status from a master page; what a page lacks is null."""
    name = SUMMARY_CLASS.get(version, SUMMARY_CLASS["3.0.3"])
    block = F.regexp_extract("html", rf'(?is)<ul class="{name}">(.*?)</ul>', 1)
    titles = ["URL", "Cores", "Memory", "Workers", "Status"]
    listed = pages.select("page_id", F.regexp_extract_all(block, F.lit(ITEM), F.lit(1)).alias("items")).filter(
        F.size("items") > 0
    )
    text = {title: _last_value(F.col("items"), titles, title) for title in titles}
    fields = listed.select("page_id", *[text[title].alias(title.lower()) for title in titles])

    def part(column: str, index: int, word: str) -> Column:
        return F.trim(F.replace(F.split_part(column, F.lit(","), F.lit(index)), F.lit(word), F.lit("")))

    return fields.select(
        "page_id",
        "url",
        F.col("workers").try_cast("int").alias("alive_workers"),
        part("cores", 2, "Used").try_cast("int").alias("cores_used"),
        part("cores", 1, "Total").try_cast("int").alias("cores_total"),
        part("memory", 2, "Used").alias("memory_used"),
        part("memory", 1, "Total").alias("memory_total"),
        "status",
    )


def worker_rows(pages: DataFrame) -> DataFrame:
    """H2: id, address, state, cores and memory of each worker on a master page."""
    table = F.regexp_extract(
        "html", r'(?is)<div class="aggregated-workers[^"]*">.*?<tbody>(.*?)</tbody>', 1
    )
    rows = pages.select(
        "page_id",
        F.posexplode(F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("position", "row"),
    )
    cells = rows.select(
        "page_id",
        "position",
        F.transform(
            F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda cell: squeeze(strip_tags(cell))
        ).alias("cells"),
    ).filter(F.size("cells") >= 5)

    def maximum(cell: Column) -> Column:
        return F.trim(F.split_part(cell, F.lit("("), F.lit(1)))

    def used(cell: Column) -> Column:
        return F.trim(F.regexp_extract(cell, r"\((.*)Used", 1))

    cell = F.col("cells")
    return cells.select(
        "page_id",
        F.col("position").cast("bigint").alias("position"),
        cell[0].alias("worker_id"),
        cell[1].alias("address"),
        cell[2].alias("status"),
        used(cell[3]).try_cast("int").alias("cores_used"),
        maximum(cell[3]).try_cast("int").alias("cores_total"),
        used(cell[4]).alias("memory_used"),
        maximum(cell[4]).alias("memory_total"),
    )


def app_counts(pages: DataFrame) -> DataFrame:
    """H3: running and completed applications, read from the number in parentheses."""

    def count(marker: str) -> Column:
        title = rf'(?is)class="{marker}[^"]*".*?<a>[^<(]*\((\d+)\)'
        return F.regexp_extract("html", title, 1).try_cast("bigint")

    return pages.select(
        "page_id",
        count("collapse-aggregated-activeApps").alias("running_apps"),
        count("collapse-aggregated-completedApps").alias("completed_apps"),
    ).filter(F.col("running_apps").isNotNull() | F.col("completed_apps").isNotNull())
