"""REST items, public contexts and page answers against known outcomes; proofs of captures."""

import json

from pyspark.sql import functions as F

from lotwright.functions import rest
from lotwright.operators import coverage

ITEM = {
    "id": 24887841, "auction_id": 164037, "auction_name": "Overstock Liquidation", "lot_identifier": "32", "name": 'Rowe "Moore" Upholstered Sofa', "name_with_prefix": '#32 Rowe "Moore" Upholstered Sofa',
    "description": "<p>Quantity: 1</p><p>Dimensions: 93W x 40D x 33H</p><strong>Terms of Sale</strong><p>Everything repeats forever.</p>", "description_without_html": "Quantity: 1 Dimensions: 93W x 40D x 33H Terms of Sale Everything repeats forever.",
    "images": [{"lg": "https://img/large.jpg", "sm": "https://img/small.jpg"}, {"xl": "https://img/detail.jpg"}], "api_bidding_state": {"high": {"amount": 650}, "ask_amount": 700, "accepted_bid_count": 7}, "status": "accepting_bids",
    "main_category": "Sofas", "sub_categories": [{"name": "Upholstered"}], "location": {"city": "Bedford Hills", "state": "NY", "zip": "10507"}, "quantity": 1, "bidding_configuration": {"start_amount": 500, "low_estimate": 1200, "high_estimate": 1800},
    "custom_buyers_premium_amount": 15, "scheduled_end_time": "2026-07-17T23:00:00Z",
}


def one(spark, body, column):
    return spark.createDataFrame([(body if isinstance(body, str) or body is None else json.dumps(body),)], "body string").select(column(F.col("body")).alias("x")).first()["x"]


def test_item(spark):
    lot = one(spark, ITEM, lambda b: rest.rest_item(F.from_json(b, rest.ITEM), F.lit("https://bid.example")))
    assert (lot["id"], lot["lot"], lot["title"], lot["url"]) == ("24887841", "32", 'Rowe "Moore" Upholstered Sofa', "https://bid.example/ui/auctions/164037/24887841")
    assert lot["images"] == ["https://img/large.jpg", "https://img/detail.jpg"] and lot["image"] == "https://img/large.jpg" and lot["description"] == "Quantity: 1 Dimensions: 93W x 40D x 33H"
    assert (lot["current_bid"], lot["next_bid"], lot["bid_count"], lot["status"], lot["category_path"], lot["location"]) == (650, 700, 7, "accepting bids", ["Sofas", "Upholstered"], "Bedford Hills, NY, 10507")
    assert (lot["start_amount"], lot["estimate_low"], lot["estimate_high"], lot["buyer_premium"]) == (500, 1200, 1800, 15)
    assert lot["raw_text"] == '#32 Rowe "Moore" Upholstered Sofa Quantity: 1 Dimensions: 93W x 40D x 33H High bid $650 7 Bids accepting bids'
    bare = one(spark, {"id": 5, "description": "<b>Only &amp; markup</b>TERMS OF SALE<br>x"}, lambda b: rest.rest_item(F.from_json(b, rest.ITEM), F.lit("https://bid.example")))
    assert (bare["description"], bare["images"], bare["current_bid"], bare["estimate_low"], bare["raw_text"]) == ("Only & markup", [], None, None, "Only & markup")
    assert one(spark, {"name": "no id"}, lambda b: rest.rest_item(F.from_json(b, rest.ITEM), F.lit("x"))) is None


def test_public_context(spark):
    auction = {
        "id": 164037, "name": "Willow Furniture & Design", "simple_description": "<p>Showroom inventory. Buyer's premium is 15%.</p>", "terms": "<p>All items sold as-is.</p>",
        "location": {"street": "230 Route 117 Bypass", "city": "Bedford Hills", "state": "NY", "zip": "10507", "country": "US"}, "published_items_count": 868, "items_count": 868, "scheduled_end_time": "2026-07-14T15:00:00Z", "status": "complete",
        "contact_email": "must-not-export@example.test", "contact_phone": "555-0100",
    }
    got = one(spark, auction, lambda b: rest.public_context(F.from_json(b, rest.AUCTION)))
    assert (got["auction_id"], got["location"], got["description"], got["terms"], got["buyer_premium"], got["starts_at"], got["items"]) == ("164037", "230 Route 117 Bypass, Bedford Hills, NY, 10507, US", "Showroom inventory. Buyer's premium is 15%.", "All items sold as-is.", "15%", "", 868)
    assert "must-not" not in str(got) and "555" not in str(got)


def test_page_answers_keep_markup_only(spark):
    body = {"head": "<div><span>118 sales</span></div>", "body": '<div class="all"><a href="/seller/1.html">Example</a></div>', "pagination": "<a onclick=\"pagination('x.php?Page=2')\">2</a>", "location": ["private map popup"], "SlrVals": "private-filter", "DefLati": "40.0000"}
    got = one(spark, body, rest.json_fragments)
    assert got["total_sales"] == 118 and "all" in got["html"] and "x.php" in got["html"] and got["ignored"] == ["DefLati", "SlrVals", "location"]
    assert not any(x in got["html"] for x in ("private", "40.0000"))
    assert one(spark, "[1]", rest.json_fragments) is None and one(spark, None, rest.json_fragments) is None and one(spark, {}, rest.json_fragments)["total_sales"] is None


def test_proofs(spark):
    ids = lambda rows: spark.createDataFrame(rows, "snapshot string, id string")
    found = [("exact", "a"), ("exact", "b"), ("under", "a"), ("under", "b"), ("over", "a"), ("over", "b"), ("twice", "a"), ("twice", "a"), ("route", "a"), ("dom", "x"), ("none", "x"), ("paged", "x"), ("paged2", "x"), ("paged2", "x")]
    there = [("exact", "a"), ("exact", "b"), ("under", "a"), ("over", "a"), ("over", "b"), ("over", "c"), ("twice", "a"), ("route", "a"), ("dom", "x"), ("none", "x"), ("paged", "x"), ("paged2", "x")]
    totals = [("exact", 2, "f"), ("under", 2, "f"), ("over", 2, "f"), ("twice", 2, "f"), ("zero", 0, "f"), ("route", 1, "g"), ("dom", None, "f"), ("none", None, "f"), ("paged", None, "f"), ("paged2", None, "f")]
    expected = spark.createDataFrame([(s, n, "f", e) for s, n, e in totals], "snapshot string, total long, start string, end string")
    proofs = spark.createDataFrame([("dom", None, True), ("paged", True, True), ("paged2", True, True), ("under", True, True)], "snapshot string, exhausted boolean, settled boolean")
    got = {r["snapshot"]: (r["tier"], r["proof"]) for r in coverage.proven(coverage.audit(ids(found), ids(there), expected), proofs).collect()}
    assert got == {
        "exact": ("api-exact", "complete"), "zero": ("api-exact", "complete"), "under": ("unproven", "count-mismatch"), "over": ("unproven", "count-mismatch"), "twice": ("unproven", "duplicate-identities"), "route": ("unproven", "route-fingerprint-changed"),
        "dom": ("dom-bottom-settled", "complete"), "none": ("unproven", "expected-total-unknown"), "paged": ("pagination-exact", "complete"), "paged2": ("unproven", "duplicate-identities"),
    }
