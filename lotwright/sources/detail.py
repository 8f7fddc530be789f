"""A lot's own page by its element tree: labelled fields, description, pictures and visible text, then typed columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwright.functions.money import first_number
from lotwright.functions.text import ascii_words

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "template"}
#: Labels that are also read from the visible text where no table has them.
LABELS = ["Lot #", "Lead", "Group - Category", "Condition", "In Packaging?", "Assembly Required?", "Damaged?", "Functional?", "Missing Parts?", "Shelf Location"]


class Element:
    __slots__ = ("tag", "at", "inside", "hidden")

    def __init__(self, tag: str, at: dict[str, str], hidden: bool):
        self.tag, self.at, self.hidden = tag, at, hidden
        self.inside: list[Element | str] = []

    def has(self, name: str) -> bool:
        return name in self.at.get("class", "").split()

    def all(self, fits: Callable[[Element], bool]) -> Iterator[Element]:
        """Elements inside that fit, in page order."""
        todo = [x for x in reversed(self.inside) if isinstance(x, Element)]
        while todo:
            e = todo.pop()
            if fits(e):
                yield e
            todo += [x for x in reversed(e.inside) if isinstance(x, Element)]

    def first(self, fits: Callable[[Element], bool]) -> Element | None:
        return next(self.all(fits), None)

    def text(self, visible: bool = False) -> str:
        parts, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                parts.append(e)
            elif not (visible and e.hidden):
                todo += reversed(e.inside)
        return " ".join((" " if visible else "").join(parts).split())


class _Tree(HTMLParser):
    """Elements with what they hold; one that is not ended ends with the element around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, False)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        hidden = self.open[-1].hidden or tag in UNSEEN or "hidden" in at or at.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I))
        e = Element(tag, at, hidden)
        self.open[-1].inside.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        if any(e.tag == tag for e in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def tree(html: str | None) -> Element:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def _rows(root: Element) -> Iterator[tuple[str, Element | None]]:
    """(label, the element of its value) of each table or list row."""
    for row in root.all(lambda e: e.tag == "tr" or e.has("row") or e.tag == "div" and any(isinstance(x, Element) and x.tag in ("dt", "dd") for x in e.inside)):
        label = row.first(lambda e: e.tag in ("th", "dt", "label") or "label" in e.at.get("class", ""))
        if label is not None:
            yield label.text().rstrip(":").strip(), row.first(lambda e: e.tag in ("td", "dd") or "value" in e.at.get("class", ""))


def _information(root: Element) -> Element | None:
    """The table that says lot number and lead."""

    def tells(e: Element) -> bool:
        if not (e.tag in ("table", "dl", "app-lot-information") or "lot-information" in e.at.get("data-testid", "")):
            return False
        labels = {x.text().rstrip(":").strip().lower() for x in e.all(lambda y: y.tag in ("th", "dt", "label"))}
        return {"lot #", "lead"} <= labels

    return root.first(tells)


def read(html: str | None, url: str | None) -> dict:
    """item, heading, fields, description, images and text of one page."""
    root = tree(html)
    info = _information(root)
    seen = root.text(visible=True)
    fields: dict[str, str] = {}
    described = None
    for label, value in _rows(info or root):
        said = value.text() if value is not None else ""
        if label and said and len(label) < 80:
            fields[label] = said
        if info is not None and label.lower() == "description" and described is None:
            described = value
    for label in LABELS:
        found = re.search(re.escape(label) + r"\s*:?\s*([^\n|]+)", seen if info is None else info.text(visible=True), re.I)
        if found and label not in fields:
            fields[label] = found[1].strip()
    if described is None:
        names = ("lot-description", "description")
        described = root.first(lambda e: e.at.get("itemprop") == "description" or e.tag == "app-lot-description" or e.at.get("data-testid") == names[0] or e.at.get("id") in names or e.has(names[0]))
    shown = root.all(lambda e: e.tag in ("app-lot-images", "app-image-gallery") or e.has("lot-images") or e.has("carousel") or any(x in e.at.get("class", "") for x in ("lot-image", "gallery")))
    images = [e.at.get(k, "") for scope in shown for e in scope.all(lambda x: x.tag == "img") for k in ("src", "data-src", "data-lazy-src")]
    images = [urljoin(url or "", x) for x in images if x]
    images = [x for x in images if x.lower().startswith("https://") and not re.search("spacer|pixel|logo|icon", x, re.I)]
    meta = root.first(lambda e: e.tag == "meta" and e.at.get("property") == "og:image" and bool(e.at.get("content")))
    if meta is not None:
        images.insert(0, urljoin(url or "", meta.at["content"]))
    item = root.first(lambda e: bool(e.at.get("data-event-item-id")))
    heading = root.first(lambda e: e.tag == "h1" or "lot-title" in e.at.get("class", ""))
    return {
        "item": item.at["data-event-item-id"] if item is not None else "", "heading": heading.text() if heading is not None else "", "fields": list(fields.items()),
        "described": described.text() if described is not None else "", "images": list(dict.fromkeys(images)), "seen": seen,
    }


SCHEMA = "item string, heading string, fields map<string,string>, described string, images array<string>, seen string"


def lot_details(pages: DataFrame, html: str, url: str, keep: list[str]) -> DataFrame:
    """One row per page that is a lot's: keep, id, lot, lead, category, description, images, current_bid, next_bid, bid_count, status, time_left, quantity, shipping_offered, auction_id, buyer_premium, fields, raw_text.

    The id is the page's own, else that of its address; pages with neither give no row. A null page has no fields.
    """
    taken = pages.select(*keep, F.col(html).cast("string").alias("_html"), F.col(url).cast("string").alias("_url"))
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("_url", T.StringType()), *T.StructType.fromDDL(SCHEMA).fields])
    kinds = {"item": pa.string(), "heading": pa.string(), "fields": pa.map_(pa.string(), pa.string()), "described": pa.string(), "images": pa.list_(pa.string()), "seen": pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(h, u) for h, u in zip(batch.column("_html").to_pylist(), batch.column("_url").to_pylist())]
            columns = [pa.array([f[n] for f in found], t) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("_url"), *columns], [*keep, "_url", *kinds])

    rows = taken.mapInArrow(work, schema)
    seen = F.col("seen")
    take = lambda pattern, group=0: F.regexp_extract(seen, "(?i)" + ascii_words(pattern), group)
    or_none = lambda x: F.nullif(x, F.lit(""))
    number = F.coalesce(or_none(F.col("item")), or_none(F.regexp_extract("_url", r"(?i)/lot/(\d+)", 1)))
    lot = F.coalesce(F.col("fields")["Lot #"], or_none(take(r"\bLot\s*#?\s*:?\s*([\w-]+)", 1)), number)
    bid = F.coalesce(or_none(take(r"(?:High|Current)\s+Bid\s*:?\s*\$?\s*[\d,.]+")), take(r"Price\s+Realized\s*:?\s*\$?\s*[\d,.]+"))
    status = F.when(seen.rlike("(?i)" + ascii_words(r"\bWon\b")), "Won").when(seen.rlike("(?i)" + ascii_words(r"\bOutbid\b")), "Outbid").when(seen.rlike("(?i)" + ascii_words(r"\bBidding Closed\b")), "Closed").otherwise("")
    out = rows.select(
        *keep, number.alias("id"), lot.alias("lot"), F.coalesce(F.col("fields")["Lead"], or_none(F.col("heading")), F.concat(F.lit("Lot "), lot)).alias("lead"), F.coalesce(F.col("fields")["Group - Category"], F.lit("")).alias("category"),
        F.coalesce(or_none(F.col("described")), F.col("fields")["Description"], F.lit("")).alias("description"), "images", first_number(bid).alias("current_bid"), first_number(take(r"(?:Minimum Next Bid|Bid)\s*:?\s*\$?\s*[\d,.]+")).alias("next_bid"),
        F.nullif(take(r"(\d+)\s+Bids?", 1).try_cast("int"), F.lit(0)).alias("bid_count"), status.alias("status"), take(r"\b(?:\d+d\s*)?(?:\d+h\s*)?\d+m(?:\s*\d+s)?\b").alias("time_left"), F.nullif(F.col("fields")["Quantity"].try_cast("double"), F.lit(0.0)).alias("quantity"),
        seen.rlike("(?i)shipping offered|will ship").alias("shipping_offered"), F.regexp_extract("_url", r"(?i)auction(?:Id)?[=/](\d+)", 1).alias("auction_id"), F.trim(take(r"Buyer's Premium\s*:?\s*([^\n|]+)", 1)).alias("buyer_premium"), "fields", F.left(seen, F.lit(12_000)).alias("raw_text"),
    )
    return out.where("id IS NOT NULL")
