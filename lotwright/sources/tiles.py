"""Lot tiles and auction groups of catalogue and account pages by their element tree, as table functions for lateral joins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lotwright.functions.money import first_number
from lotwright.functions.text import ascii_words

from .detail import Element, tree

#: The elements that are tiles, titles and group headings, and the kinds of account pages that are read by group.
TILE_TAG, TILE_CLASS, TILE_PREFIX, TILE_ATTRIBUTE = "app-lot-tile", "bid-status-border", "lot-", "data-event-item-id"
GROUP_CLASS, GROUP_TAG, BOX_CLASS, BOX_PART = "listing-box-title", "app-watched-auction-header", "listing-box", "auction-listing"
ONE_GROUP, ALL_GROUPS = ("pastbids", "pastwatchlist"), ("watchlist", "currentbids-winning", "currentbids-outbid")


def _is_tile(e: Element) -> bool:
    return TILE_ATTRIBUTE in e.at or (e.tag == TILE_TAG or e.has(TILE_CLASS)) and e.at.get("id", "").startswith(TILE_PREFIX)


def _link(e: Element, part: str) -> Element | None:
    return e.first(lambda x: x.tag == "a" and part in x.at.get("href", ""))


def _named(e: Element) -> str:
    return re.sub(f"^{TILE_PREFIX}", "", e.at.get("id", ""))


def _ancestors(root: Element) -> dict[int, Element]:
    """The element around each element."""
    return {id(x): e for e in [root, *root.all(lambda _: True)] for x in e.inside if isinstance(x, Element)}


def _groups(root: Element, url: str) -> list[dict]:
    found = []
    for n, block in enumerate(root.all(lambda e: e.has(GROUP_CLASS))):
        link = _link(block, "/catalog/")
        if link is None:
            continue
        catalog = urljoin(url, link.at["href"])
        number = re.search(r"/catalog/(\d+)", catalog, re.I)
        strong, place = block.first(lambda e: e.tag == "strong"), _link(block, "maps.google")
        title, location = (strong.text() if strong is not None else "") or link.text(), place.text() if place is not None else ""
        dated = re.sub(r"^\s*\|\s*", "", block.text().replace(title, "", 1).replace(location, "", 1))
        found.append({"id": number[1] if number else str(n), "title": title, "catalog_url": catalog, "location": location, "dated": dated.strip()})
    return found


def _container(root: Element, group: str, url: str) -> Element | None:
    """What belongs to a group: from its heading element to the next one beside it, else the box around its heading."""
    digits = re.sub(r"\D", "", group)
    for header in root.all(lambda e: e.has(GROUP_CLASS)):
        link = _link(header, "/catalog/")
        href = urljoin(url, link.at["href"]) if link is not None else ""
        if f"/catalog/{digits}/" in href or href.endswith(f"/catalog/{digits}"):
            break
    else:
        return None
    around = _ancestors(root)
    line = [header]
    while id(line[-1]) in around:
        line.append(around[id(line[-1])])
    head = next((e for e in line if e.tag == GROUP_TAG), None)
    if head is not None:
        scope, beside = Element("", {}, False), [x for x in around[id(head)].inside if isinstance(x, Element)]
        at = next(k for k, x in enumerate(beside) if x is head)
        for x in beside[at:]:
            if x is not head and x.tag == GROUP_TAG:
                break
            scope.inside.append(x)
        return scope
    return next((e for e in line if e.has(BOX_CLASS) or BOX_PART in e.at.get("class", "") or e.tag == "section"), line[1])


def _tiles(root: Element, url: str) -> Iterator[tuple]:
    """id, heading, link text, url, images and visible text of each lot, its first tile only."""
    seen = set()
    for tile in root.all(_is_tile):
        link = _link(tile, "/lot/")
        href = urljoin(url, link.at["href"]) if link is not None else ""
        number, inner = re.search(r"/lot/(\d+)", href, re.I), tile.first(lambda e: bool(e.at.get(TILE_ATTRIBUTE)))
        name = _named(tile) or (number[1] if number else "") or (inner.at[TILE_ATTRIBUTE] if inner is not None else "")
        if not name or name in seen:
            continue
        seen.add(name)
        heading = tile.first(lambda e: e.tag in ("h1", "h2", "h3", "h4") or "title" in e.at.get("class", ""))
        images = [x for e in tile.all(lambda e: e.tag == "img") if (x := e.at.get("src") or e.at.get("data-src"))]
        yield name, heading.text() if heading is not None else "", link.text() if link is not None else "", href or urljoin(url, f"/lot/{name}"), images, tile.text(visible=True)


@udtf(returnType="pos int, id string, heading string, link_text string, url string, images array<string>, raw string, auction_id string, auction_title string, location string")
class _AccountTiles:
    """Tiles of one page by its kind: of the chosen group, of every group, or of the whole page."""

    def eval(self, html: str, url: str, kind: str, group: str):
        root, url, out, seen = tree(html), url or "", [], set()
        if kind in ONE_GROUP:
            scope = _container(root, group, url) if group else None
            out = [(*t, None, None, None) for t in _tiles(scope, url)] if scope is not None else []
        else:
            for g in _groups(root, url) if kind in ALL_GROUPS else []:
                scope = _container(root, g["id"], url)
                for t in _tiles(scope, url) if scope is not None else []:
                    if t[0] not in seen:
                        seen.add(t[0])
                        out.append((*t, g["id"], g["title"], g["location"]))
            out = out or [(*t, None, None, None) for t in _tiles(root, url)]
        for pos, t in enumerate(out):
            yield pos, *t


@udtf(returnType="pos int, id string, title string, catalog_url string, location string, dated string, expected int, visible int")
class _Groups:
    """Auction groups of one page, with how many lots each says it has and shows."""

    def eval(self, html: str, url: str):
        root, url = tree(html), url or ""
        for pos, g in enumerate(_groups(root, url)):
            scope = _container(root, g["id"], url)
            said, shown = None, set()
            if scope is not None:
                found = re.search(r"showing\s+(\d+)\s*(?:-|to)\s*(\d+)\s+of\s+(\d+)\s+lots?", scope.text(visible=True), re.I)
                shown = {x for e in scope.all(_is_tile) if (x := _named(e) or e.at.get(TILE_ATTRIBUTE, ""))}
                said = int(found[3]) if found else len(shown)
            yield pos, g["id"], g["title"], g["catalog_url"], g["location"], g["dated"], said, len(shown)


def account_lots(pages: DataFrame, html: str, url: str, kind: str, group: str, keep: list[str]) -> DataFrame:
    """One row per lot tile: keep, pos, id, lot, title, url, images, current_bid, next_bid, bid_count, status, time_left, shipping, auction_id, auction_title, location, raw.

    ``html``, ``url``, ``kind`` (of the page's route) and ``group`` (a chosen group's id) are column names. The id is the tile's own
    without its prefix, else that of its link, else that of an element inside; a tile without one, or a lot's second
    tile, gives no row. Lots of account pages carry their group. A null page has no tiles.
    """
    rows = pages.select(*keep, F.col(html).cast("string").alias("_html"), F.col(url).cast("string").alias("_url"), F.col(kind).cast("string").alias("_kind"), F.col(group).cast("string").alias("_group"))
    rows = rows.lateralJoin(_AccountTiles(*(F.col(c).outer() for c in ("_html", "_url", "_kind", "_group"))))
    or_none = lambda x: F.nullif(x, F.lit(""))
    take = lambda c, pattern, k=0: or_none(F.regexp_extract(c, "(?i)" + ascii_words(pattern), k))
    said = F.coalesce(or_none(F.col("heading")), or_none(F.col("link_text")), F.concat(F.lit("Lot "), F.col("id")))
    rows = rows.withColumn("said", said)
    lot = F.coalesce(take("said", r"\bLot\s*#?\s*([\w.-]+)", 1), take("raw", r"\bLot\s*#?\s*([\w.-]+)", 1), F.col("id"))
    title = F.coalesce(or_none(F.trim(F.regexp_replace("said", "(?i)" + ascii_words(r"^\s*Lot\s*#?\s*[\w.-]+\s*(?:\||-|:)\s*"), ""))), F.col("said"))
    status = F.when(F.col("raw").rlike("(?i)won"), "Won").when(F.col("raw").rlike("(?i)outbid"), "Outbid").when(F.col("raw").rlike("(?i)winning"), "Winning").otherwise("")
    return rows.select(
        *keep, "pos", "id", lot.alias("lot"), title.alias("title"), "url", "images", first_number(take("raw", r"(?:high|current)\s+bid[^\d$]*\$?\s*[\d,.]+")).alias("current_bid"), first_number(take("raw", r"\bbid\s+\$?\s*[\d,.]+")).alias("next_bid"),
        F.nullif(take("raw", r"(\d+)\s+bids?", 1).try_cast("int"), F.lit(0)).alias("bid_count"), status.alias("status"), F.coalesce(take("raw", r"\b(?:\d+d\s*)?(?:\d+h\s*)?\d+m\b"), F.lit("")).alias("time_left"), F.col("raw").rlike("(?i)shipping").alias("shipping"),
        "auction_id", "auction_title", "location", "raw",
    )


def auction_groups(pages: DataFrame, html: str, url: str, keep: list[str]) -> DataFrame:
    """One row per group of a page: keep, pos, id, title, catalog_url, location, dated, expected (what it says, else what it shows) and visible."""
    rows = pages.select(*keep, F.col(html).cast("string").alias("_html"), F.col(url).cast("string").alias("_url"))
    return rows.lateralJoin(_Groups(F.col("_html").outer(), F.col("_url").outer())).drop("_html", "_url")
