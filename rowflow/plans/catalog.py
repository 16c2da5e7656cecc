"""Dataset catalog over tables of listing pages and size lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
STREAM_HREF = r'href="([^"]*\.ss\?property=info)"'
ANY_HREF = r'href="([^"]*)"'
FOLDER_CLASS = "unmountedDirLink"
SCHEMA_ROW = r'<div class="div-table-row">\s*((?:<div class="div-table-col">[^<]*</div>\s*)+)</div>'
SCHEMA_CELL = r'<div class="div-table-col">([^<]*)</div>'
SIZE_UNITS = ["", "K", "M", "G", "T", "P", "E", "Z"]
MAX_FAILURES = 3
INFO_SUFFIX = "?property=info"


def page_links(pages: DataFrame, pattern: str = STREAM_HREF) -> DataFrame:
    """``(page_id, pos, href)`` of every match in the page."""
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "href"))


def anchor_texts(pages: DataFrame, css_class: str | None = FOLDER_CLASS) -> DataFrame:
    """``(page_id, pos, text)`` of anchors of one class (of all anchors when it is None)."""
    inside = rf'[^>]*class="{css_class}"[^>]*' if css_class else r"(?:\s[^>]*)?"
    found = F.regexp_extract_all("html", F.lit(rf"<a{inside}>([^<]*)</a>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("pos", "text"))


def schema_rows(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, name, type)`` from the rows of a schema page."""
    rows = F.regexp_extract_all("html", F.lit(SCHEMA_ROW), F.lit(1))
    each = pages.select("page_id", F.posexplode(rows).alias("pos", "row"))
    cells = F.regexp_extract_all("row", F.lit(SCHEMA_CELL), F.lit(1))
    return each.select("page_id", "pos", cells.alias("c")).select(
        "page_id", "pos", F.get("c", F.lit(0)).alias("name"), F.get("c", F.lit(1)).alias("type")
    )


def size_pretty(text: Column) -> Column:
    """``169,299 Bytes`` -> ``165.3 K``: steps of 1024, one digit, half to even. The unit comes
    from comparisons with exact powers; sizes below 1024 keep an empty unit and its space."""
    size = F.replace(F.substring_index(text, " ", 1), F.lit(",")).cast("double")
    shown = F.format_string("%.1f Yi", F.bround(size / 1024.0 ** len(SIZE_UNITS), 1))
    for step in reversed(range(len(SIZE_UNITS))):
        value = F.format_string(f"%.1f {SIZE_UNITS[step]}", F.bround(size / 1024.0**step, 1))
        shown = F.when(F.abs(size) < 1024.0 ** (step + 1), value).otherwise(shown)
    return shown


def size_cache(log: DataFrame) -> DataFrame:
    """``log(url, key, value, ok, ts)`` -> ``(url, key, value, failures)``. What is found first stays:
    the value of the first success, or ``NA`` if more than three failures come before it; empty
    when there is neither. ``failures`` are those before the first success; of equal times the
    success comes first, and of successes the smallest value."""
    good = F.min(F.when(F.col("ok"), F.struct("ts", F.coalesce("value", F.lit("")).alias("value"))))
    first = log.groupBy("url", "key").agg(good.alias("good"))
    bad = log.filter(~F.col("ok")).alias("b").join(first.alias("f"), ["url", "key"])
    bad = bad.filter(F.col("good").isNull() | (F.col("b.ts") < F.col("good.ts")))
    failed = bad.groupBy("url", "key").agg(F.count(F.lit(1)).alias("failures"))
    failures = F.coalesce("failures", F.lit(0))
    value = F.when(failures > MAX_FAILURES, F.lit("NA")).otherwise(F.coalesce("good.value", F.lit("")))
    return first.join(failed, ["url", "key"], "left").select("url", "key", value.alias("value"), failures.alias("failures"))


def info_url(url: Column) -> Column:
    return F.when(url.endswith(INFO_SUFFIX), url).otherwise(F.concat(url, F.lit(INFO_SUFFIX)))
