"""Answers of a catalogue's REST service as flat records: items, the public part of an auction, pages that carry markup in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .listing import trimmed
from .lots import words

#: An item and an auction, as from_json reads them; what they hold besides is never read.
ITEM = (
    "id string, auction_id string, auction_name string, lot_identifier string, name string, name_with_prefix string, description string, description_without_html string, images array<map<string,string>>,"
    " api_bidding_state struct<high:struct<amount:double>,ask_amount:double,accepted_bid_count:bigint>, status string, main_category string, sub_categories array<struct<name:string>>,"
    " location struct<street:string,city:string,state:string,zip:string,country:string>, quantity double, start_amount double, bidding_configuration struct<start_amount:double,low_estimate:double,high_estimate:double>,"
    " custom_buyers_premium_amount double, scheduled_end_time string"
)
AUCTION = (
    "id string, name string, simple_description string, terms string, location struct<street:string,city:string,state:string,zip:string,country:string>, published_items_count bigint, items_count bigint, starts_at string,"
    " scheduled_end_time string, status string"
)
# Sizes of a picture, the largest first; where a description ends; members of a page answer that are markup.
SIZES, TERMS, FRAGMENTS = ("xl", "lg", "md", "sm"), r"(?is)\bTerms of Sale\b.*$", ("head", "body", "pagination")


def plain(markup: Column) -> Column:
    """Text of markup in one line."""
    text = F.coalesce(markup, F.lit(""))
    for pattern, by in ((r"<[^>]*>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")):
        text = F.regexp_replace(text, pattern, by)
    return words(text)


def place(location: Column) -> Column:
    """Street, city, state, zip and country that are known, with commas."""
    return F.array_join(F.filter(F.array(*(words(location[f]) for f in ("street", "city", "state", "zip", "country"))), lambda x: x != ""), ", ")


def stated_premium(text: Column) -> Column:
    """The buyer's premium that a text names in per cent, with its sign; empty if none."""
    return F.regexp_extract(text, r"(?i)buyer.?s?\s+premium\D{0,40}?(\d+(?:\.\d+)?\s*%)", 1)


def rest_item(item: Column, site: Column) -> Column:
    """struct of a flat lot for an ITEM; null without an id.

    Bids come from the nested state, estimates from the bidding configuration. The description is its text without markup up
    to the terms of sale. ``site`` is the origin of the lot's page.
    """
    number = words(item["id"])
    text = F.coalesce(F.nullif(words(item["description_without_html"]), F.lit("")), plain(item["description"]))
    description = trimmed(F.regexp_replace(text, TERMS, ""))
    image = lambda m: F.coalesce(*(F.nullif(F.try_element_at(m, F.lit(s)), F.lit("")) for s in SIZES))
    images = F.array_distinct(F.array_compact(F.transform(F.coalesce(item["images"], F.array().cast("array<map<string,string>>")), image)))
    state, status = item["api_bidding_state"], F.replace(words(item["status"]), F.lit("_"), F.lit(" "))
    high, ask, bids = state["high"]["amount"], state["ask_amount"], state["accepted_bid_count"]
    dollars = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.00$", "")
    said = F.when(high.isNotNull(), F.concat(F.lit("High bid $"), dollars(high))), F.when(bids.isNotNull(), F.concat(bids.cast("string"), F.when(bids == 1, " Bid").otherwise(" Bids")))
    path = F.array_distinct(F.filter(F.concat(F.array(words(item["main_category"])), F.transform(F.coalesce(item["sub_categories"], F.array().cast("array<struct<name:string>>")), lambda c: words(c["name"]))), lambda c: c != ""))
    prefixed = F.coalesce(F.nullif(words(item["name_with_prefix"]), F.lit("")), words(item["name"]))
    fields = {
        "id": number, "auction_id": words(item["auction_id"]), "auction_title": words(item["auction_name"]), "lot": words(item["lot_identifier"]), "title": words(item["name"]),
        "url": F.concat_ws("/", site, F.lit("ui/auctions"), words(item["auction_id"]), number), "image": F.coalesce(F.get(images, F.lit(0)), F.lit("")), "images": images, "description": description, "description_html": F.coalesce(item["description"], F.lit("")),
        "current_bid": high, "next_bid": ask, "bid_count": bids, "status": status, "quantity": item["quantity"], "category": F.coalesce(F.get(path, F.lit(0)), F.lit("")), "category_path": path, "location": place(item["location"]),
        "start_amount": F.coalesce(item["start_amount"], item["bidding_configuration"]["start_amount"]), "estimate_low": item["bidding_configuration"]["low_estimate"], "estimate_high": item["bidding_configuration"]["high_estimate"],
        "buyer_premium": item["custom_buyers_premium_amount"], "ends_at": words(item["scheduled_end_time"]), "raw_text": F.array_join(F.filter(F.array(prefixed, description, *(F.coalesce(x, F.lit("")) for x in said), status), lambda x: x != ""), " "),
    }
    return F.when(number != "", F.struct(*(c.alias(n) for n, c in fields.items())))


def public_context(auction: Column) -> Column:
    """struct of what may be told of an AUCTION; contacts and everything else that is not named here stay out."""
    description, terms = plain(auction["simple_description"]), plain(auction["terms"])
    return F.struct(
        words(auction["id"]).alias("auction_id"), words(auction["name"]).alias("auction_title"), place(auction["location"]).alias("location"), description.alias("description"), terms.alias("terms"),
        F.coalesce(F.nullif(stated_premium(description), F.lit("")), stated_premium(terms)).alias("buyer_premium"), words(auction["starts_at"]).alias("starts_at"), words(auction["scheduled_end_time"]).alias("ends_at"),
        words(auction["status"]).alias("status"), auction["published_items_count"].alias("published"), auction["items_count"].alias("items"),
    )


def json_fragments(body: Column) -> Column:
    """struct(html, total_sales, ignored): the markup members of a page answer, the number of sales it names, and the names of all other members, which are not read; null for what is no JSON object."""
    members = F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>")
    html = F.concat_ws("\n", *(F.coalesce(F.try_variant_get(F.try_element_at(members, F.lit(n)), "$", "string"), F.lit("")) for n in FRAGMENTS))
    total = F.replace(F.regexp_extract(plain(html), r"(?i)([\d,]+)\s+sales?\b", 1), F.lit(","), F.lit("")).try_cast("int")
    ignored = F.array_sort(F.filter(F.map_keys(members), lambda k: ~k.isin(*FRAGMENTS)))
    return F.when(members.isNotNull(), F.struct(html.alias("html"), total.alias("total_sales"), ignored.alias("ignored")))
