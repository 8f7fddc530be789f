"""Listing pages to records by patterns: record slices between markers, their fields, groups and page state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwright.functions.text import squeezed, unescaped_html


def slices(pages: DataFrame, html: str, marker: str, keep: list[str]) -> DataFrame:
    """One row per record: keep, pos, block. A block runs from one marker (a pattern) to the next."""
    parts = F.split(html, f"(?={marker})")
    rows = pages.select(*keep, F.posexplode(parts).alias("pos", "block"))
    return rows.where(F.col("block").rlike(f"^{marker}"))


def inner_text(block: Column, pattern: str) -> Column:
    """Text of the first match of the pattern's group, without tags; null without a match."""
    found = F.nullif(F.regexp_extract(block, f"(?is){pattern}", 1), F.lit(""))
    return squeezed(unescaped_html(F.regexp_replace(found, "<[^>]*>", " ")))


def attribute(block: Column, name: str) -> Column:
    return unescaped_html(F.nullif(F.regexp_extract(block, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")))


def lot_tiles(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Lots of catalogue pages: id, lot number, title, bid, url and group (the last heading before the tile)."""
    marker = r"<(?:div|li|article)\b[^>]*\bdata-lot-id\s*="
    rows = slices(pages, html, marker, keep)
    return rows.select(
        *keep, "pos",
        F.regexp_extract("block", r"data-lot-id\s*=\s*[\"']?(\w+)", 1).alias("id"),
        inner_text(F.col("block"), r"<h\d[^>]*>(.*?)</h\d>").alias("title"),
        attribute(F.col("block"), "href").alias("url"),
        F.replace(F.nullif(F.regexp_extract("block", r"(?i)bid:?\s*\$?\s*([\d,]+(?:\.\d+)?)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double").alias("bid"),
    )


def candidates(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Retail results of a page: key, title, price, sponsored, used; the best row of each key (organic, then cheapest)."""
    rows = slices(pages, html, r"<div\b[^>]*\bdata-key\s*=\s*[\"'][A-Z0-9]{10}[\"']", keep)
    block = F.col("block")
    rows = rows.select(
        *keep, "pos",
        F.upper(attribute(block, "data-key")).alias("key"),
        F.coalesce(attribute(block, "alt"), inner_text(block, r"<h2[^>]*>(.*?)</h2>")).alias("title"),
        F.replace(F.regexp_extract(block, r"(?i)class=[\"'][^\"']*price[^\"']*[\"'][^>]*>\s*\$?\s*([\d,]+(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double").alias("price"),
        block.rlike(r"(?i)\bsponsored\b").alias("sponsored"),
    )
    rows = rows.where("title IS NOT NULL").withColumn("used", F.col("title").rlike(r"(?i)\b(?:used|renewed|refurbished|open[- ]box)\b"))
    order = F.struct("sponsored", F.coalesce("price", F.lit(float("inf"))), "pos")
    best = rows.groupBy(*keep, "key").agg(F.min_by(F.struct("title", "price", "sponsored", "used"), order).alias("r"))
    return best.select(*keep, "key", "r.*")


def page_state(text: Column) -> Column:
    """struct(first, last, total, none) of ``Showing a to b of n lots``."""
    n = lambda k: F.replace(F.regexp_extract(text, r"(?i)showing\s+([\d,]+)\s*(?:-|to)\s*([\d,]+)\s+of\s+([\d,]+)\s+lots?", k), F.lit(","), F.lit("")).try_cast("int")
    return F.struct(n(1).alias("first"), n(2).alias("last"), n(3).alias("total"), F.coalesce(text.rlike(r"(?i)\bno\s+(?:(?:exact\s+)?matches\b|(?:lots|results)\s+found)"), F.lit(False)).alias("none"))


def json_ld(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """The richest product record (most fields) among a page's linked-data scripts."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    rows = pages.select(*keep, F.posexplode(bodies).alias("pos", "body"))
    rows = rows.withColumn("m", F.from_json("body", "map<string,string>")).where("m IS NOT NULL AND m['@type'] = 'Product'")
    best = rows.groupBy(*keep).agg(F.max_by("m", F.struct(F.size("m"), -F.col("pos"))).alias("m"))
    return best.select(*keep, F.col("m")["name"].alias("name"), F.col("m")["sku"].alias("sku"), F.size("m").alias("fields"))
