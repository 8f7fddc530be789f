"""A catalogue's raw lot record as one flat, typed lot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .listing import collapsed, description_labels, trimmed
from .urls import resolved

PICTURE = "struct<fullSizeLocation:string,hdThumbnailLocation:string,thumbnailLocation:string,url:string,src:string>"
CATEGORY = "struct<fullCategory:string,categoryName:string,name:string>"
#: The raw record, as from_json reads it; absent fields are null.
RAW_LOT = (
    "eventItemId string, id string, itemId string, lotNumber string, saleOrder string, lead string, title string, name string, description string, estimate string, url string, productUrl string,"
    f" featuredPicture {PICTURE}, pictures array<{PICTURE}>, category array<{CATEGORY}>, categories array<{CATEGORY}>, bidAmount double, bidCount double, timeLeft string, quantity double, shippingOffered boolean, watchNotes string,"
    " lotState struct<highBid:double,priceRealized:double,price:double,minBid:double,nextBid:double,bidCount:double,productUrl:string,status:string,productStatus:string,priceRealizedMessage:string,timeLeft:string,timeLeftTitle:string,watchNotes:string>,"
    " auction struct<id:string,eventName:string,title:string,eventAddress:string,eventCity:string,eventState:string,eventZip:string,buyerPremium:string,buyerPremiumRate:string>"
)
#: Signs of a lot's raw text, at most.
RAW_TEXT = 12_000


def words(x: Column) -> Column:
    """x in one line; null is empty."""
    return collapsed(F.coalesce(x.cast("string"), F.lit("")))


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def description_text(markup: Column) -> Column:
    """Text of a description's markup with its lines: a line for each block, a dash before items, no more than one empty line."""
    x = F.coalesce(markup, F.lit(""))
    for pattern, by in ((r"(?i)<\s*br\s*/?>", "\n"), (r"(?i)</(?:p|div|li|tr|h\d)>", "\n"), (r"(?i)<li\b[^>]*>", "- "), (r"<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")):
        x = F.regexp_replace(x, pattern, by)
    for pattern, by in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        x = F.regexp_replace(x, pattern, by)
    return trimmed(x)


def pictures(lot: Column) -> Column:
    """Distinct addresses of a lot's pictures: the featured one first, of each the largest first."""
    each = lambda p: F.array(*(words(p[f]) for f in ("fullSizeLocation", "hdThumbnailLocation", "thumbnailLocation", "url", "src")))
    every = F.concat(F.array(lot["featuredPicture"]), F.coalesce(lot["pictures"], F.array().cast(f"array<{PICTURE}>")))
    return F.array_distinct(F.filter(F.flatten(F.transform(every, each)), lambda u: u != ""))


def categories(lot: Column) -> Column:
    """Distinct names of a lot's categories, full names first."""
    each = lambda c: F.array(*(words(c[f]) for f in ("fullCategory", "categoryName", "name")))
    none = F.array().cast(f"array<{CATEGORY}>")
    every = F.concat(F.coalesce(lot["category"], none), F.coalesce(lot["categories"], none))
    return F.array_distinct(F.filter(F.flatten(F.transform(every, each)), lambda c: c != ""))


def lot_number(lot: Column) -> Column:
    """The id of a RAW_LOT record in one line; empty without one."""
    return words(F.coalesce(lot["eventItemId"], lot["id"], lot["itemId"]))


def markup_of(lot: Column) -> Column:
    return trimmed(F.coalesce(lot["description"], F.lit("")))


def normalised_lot(lot: Column, page_kind: Column, source_url: Column, auction_id: Column, text: Column | None = None) -> Column:
    """struct of the flat lot (31 fields) for a RAW_LOT record read on a page; null without an id.

    The current bid is the realized price if that is above 0, else the high bid, else the price. Where a record has no
    address the lot's page on the source's site is given. ``text`` is ``description_text(markup_of(lot))`` as a column, where
    rows have it, so that it is not read again for each field.
    """
    state, sale = lot["lotState"], lot["auction"]
    first = lambda *xs: F.coalesce(*xs)
    number = lot_number(lot)
    place = words(first(lot["lotNumber"], lot["saleOrder"], number))
    title = words(first(lot["lead"], lot["title"], lot["name"], F.concat(F.lit("Lot "), place)))
    lead = F.coalesce(F.nullif(words(lot["lead"]), F.lit("")), title)
    markup = markup_of(lot)
    description, images, named = description_text(markup) if text is None else text, pictures(lot), categories(lot)
    realized = _finite(state["priceRealized"])
    bid = F.when(realized > 0, realized).otherwise(F.coalesce(_finite(state["highBid"]), _finite(F.coalesce(state["price"], lot["bidAmount"]))))
    page = words(first(state["productUrl"], lot["url"], lot["productUrl"]))
    origin = F.regexp_extract(source_url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    some = lambda sep, *xs: F.array_join(F.filter(F.array(*(words(x) for x in xs)), lambda x: x != ""), sep)
    raw = F.array_join(F.filter(F.array(place, title, description, words(state["status"])), lambda x: x != ""), " | ")
    fields = {
        "source": F.lit("api"), "page_kind": page_kind, "id": number, "event_item_id": number, "item_id": words(lot["itemId"]), "lot": place, "title": title, "lead": lead, "estimate": words(lot["estimate"]),
        "url": F.when(page != "", resolved(page, source_url)).otherwise(F.concat(origin, F.lit("/lot/"), number)), "image": F.coalesce(F.get(images, F.lit(0)), F.lit("")), "images": images,
        "description": description, "description_html": markup, "category": F.coalesce(F.get(named, F.lit(0)), F.lit("")), "categories": named, "current_bid": bid, "next_bid": _finite(F.coalesce(state["minBid"], state["nextBid"])),
        "bid_count": _finite(F.coalesce(state["bidCount"], lot["bidCount"])), "status": words(first(state["status"], state["productStatus"], state["priceRealizedMessage"])), "time_left": words(first(state["timeLeft"], state["timeLeftTitle"], lot["timeLeft"])),
        "quantity": _finite(lot["quantity"]), "shipping_offered": F.coalesce(lot["shippingOffered"], F.lit(False)), "auction_id": words(first(sale["id"], auction_id)), "auction_title": words(first(sale["eventName"], sale["title"])),
        "location": some(", ", sale["eventAddress"], sale["eventCity"], sale["eventState"], sale["eventZip"]), "buyer_premium": words(first(sale["buyerPremium"], sale["buyerPremiumRate"])), "watch_notes": words(first(state["watchNotes"], lot["watchNotes"])),
        "raw_text": F.left(raw, F.lit(RAW_TEXT)), "description_fields": description_labels(description), "audit": F.struct((description != "").alias("has_description"), F.size(images).alias("image_count")),
    }
    return F.when(number != "", F.struct(*(c.alias(n) for n, c in fields.items())))


def merged_visible(visible: Column, hydrated: Column) -> Column:
    """struct(current_bid, status, hydrated) of what a page shows (current_bid, status, raw_text) and its hydrated record, null if there is none.

    The record counts, but for a realized price or a closed lot's bid that the page shows while the record has none or 0,
    and for a status that the record leaves empty.
    """
    realized = F.coalesce(visible["raw_text"], F.lit("")).rlike(r"(?i)\bPrice\s+Realized\b") | F.coalesce(visible["status"], F.lit("")).rlike("(?i)^Closed$")
    keeps = realized & (F.coalesce(hydrated["current_bid"], F.lit(0.0)) == 0) & (visible["current_bid"] > 0)
    bid = F.when(hydrated.isNull() | F.coalesce(keeps, F.lit(False)), visible["current_bid"]).otherwise(hydrated["current_bid"])
    status = F.coalesce(F.nullif(hydrated["status"], F.lit("")), visible["status"])
    return F.struct(bid.alias("current_bid"), status.alias("status"), hydrated.isNotNull().alias("hydrated"))
