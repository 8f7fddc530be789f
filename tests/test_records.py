"""Lots, jobs, settings and private data on records with known outcomes."""

import json

import pytest
from pyspark.sql import functions as F

from lotwright.functions import jobs as J
from lotwright.functions import lots as L
from lotwright.functions import listing
from lotwright.functions import money as M
from lotwright.functions import urls as U
from lotwright.operators import match


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lot(spark, raw, kind="catalog"):
    parsed = F.from_json(F.lit(json.dumps(raw)), L.RAW_LOT)
    return one(spark, L.normalised_lot(parsed, F.lit(kind), F.lit("https://site.example/catalog/765226/x?q=1"), F.lit("765226")))


def test_a_whole_lot(spark):
    got = lot(
        spark,
        {
            "id": 299, "itemId": 12, "lotNumber": " 7A ", "lead": "Acme   drill", "description": "<p>Year: 1999<br/>Make : Acme</p><ul><li>a &amp; b</li></ul>", "featuredPicture": {"fullSizeLocation": "https://i/1.jpg"},
            "pictures": [{"fullSizeLocation": "https://i/1.jpg", "url": "https://i/1s.jpg"}, {"fullSizeLocation": "https://i/2.jpg"}], "category": [{"categoryName": "Tools", "fullCategory": "Home > Tools"}],
            "lotState": {"highBid": 12.5, "minBid": 15, "bidCount": 3, "productUrl": "/lot/299/acme", "status": "OPEN", "watchNotes": "mine"}, "auction": {"id": 5, "eventName": "Sale", "eventCity": "Edison", "eventState": "NJ", "buyerPremiumRate": 15},
        },
    )
    want = {
        "id": "299", "item_id": "12", "lot": "7A", "title": "Acme drill", "url": "https://site.example/lot/299/acme", "images": ["https://i/1.jpg", "https://i/1s.jpg", "https://i/2.jpg"], "description": "Year: 1999\nMake : Acme\n- a & b",
        "category": "Home > Tools", "categories": ["Home > Tools", "Tools"], "current_bid": 12.5, "next_bid": 15.0, "bid_count": 3.0, "status": "OPEN", "auction_id": "5", "location": "Edison, NJ", "buyer_premium": "15", "watch_notes": "mine",
        "raw_text": "7A | Acme drill | Year: 1999\nMake : Acme\n- a & b | OPEN", "description_fields": {"Year": "1999", "Make": "Acme"}, "shipping_offered": False, "quantity": None,
    }
    assert {k: got[k] for k in want} == want and len(got) == 31 and tuple(got["audit"]) == (True, 3)


def test_sparse_lots(spark):
    assert lot(spark, {"title": "no id"}) is None
    bare = lot(spark, {"id": 1, "lotState": {"priceRealized": 40, "highBid": 0}})
    assert (bare["title"], bare["lot"], bare["url"], bare["current_bid"], bare["image"], bare["category"], bare["auction_id"]) == ("Lot 1", "1", "https://site.example/lot/1", 40.0, "", "", "765226")
    assert lot(spark, {"id": 1, "lotState": {"priceRealized": 0, "highBid": 7}})["current_bid"] == 7.0
    assert lot(spark, {"id": 1, "bidAmount": 3, "description": "x" * 20_000})["current_bid"] == 3.0
    assert len(lot(spark, {"id": 1, "description": "x" * 20_000})["raw_text"]) == L.RAW_TEXT


@pytest.mark.parametrize(
    "link,want",
    [("https://o/x", "https://o/x"), ("//cdn/x", "https://cdn/x"), ("/a/b", "https://s.e/a/b"), ("b", "https://s.e/p/b"), ("?z=1", "https://s.e/p/q?z=1"), ("#f", "https://s.e/p/q?r=1#f")],
)
def test_links(spark, link, want):
    assert one(spark, U.resolved(F.lit(link), F.lit("https://s.e/p/q?r=1#t"))) == want


def test_redirects_and_canonical_links(spark):
    assert one(spark, U.unwrapped(F.lit("https://r.e/go?k=1&url=https%3A%2F%2Fa.b%2Fc%3Fd%3D1"))) == "https://a.b/c?d=1"
    assert one(spark, U.unwrapped(F.lit("https://r.e/go?url=no"))) == "https://r.e/go?url=no"
    assert one(spark, U.canonical_link(F.lit("https://a.b/c?utm_source=x&id=5&buyer_email=q&REF=1&flag#top"))) == "https://a.b/c?id=5&flag"


def test_settings(spark):
    empty = one(spark, J.settings(F.create_map().cast("map<string,string>"))).asDict()
    assert empty["ebayFeePct"] == 13.25 and empty["taxOnPremium"] and empty["stateCode"] is None and empty["originZip"] == "08817" and empty["customInstructions"] == ""
    text = {"retailTargetPct": "500", "retailWarningPct": "-3", "radiusMiles": "NaN", "taxOnPremium": "false", "originLabel": " Town ", "taxPctOverride": "", "debugMode": "1"}
    got = one(spark, J.settings(F.create_map(*(F.lit(x) for pair in text.items() for x in pair)))).asDict()
    assert (got["retailTargetPct"], got["retailWarningPct"], got["radiusMiles"], got["taxOnPremium"], got["originLabel"], got["taxPctOverride"], got["debugMode"]) == (95.0, 1.0, 100.0, False, "Town", None, False)


@pytest.mark.parametrize("exempt,override,state,want", [(True, "5", "NJ", 0.0), (False, "5.5", "NJ", 5.5), (False, None, "NJ", 6.6), (False, "x", "OR", 0.0), (None, None, "ZZ", 0.0), (None, None, None, 0.0)])
def test_tax(spark, exempt, override, state, want):
    assert one(spark, J.effective_tax(*(F.lit(x).cast(t) for x, t in ((exempt, "boolean"), (override, "string"), (state, "string"))))) == want


def _struct(**fields):
    return F.struct(*(F.lit(v).cast(t).alias(k) for k, (v, t) in fields.items()))


@pytest.mark.parametrize(
    "phase,own,kind,scope,total,items,ids,want",
    [
        ("completed", "a", "catalog", None, 3, 3, 3, None), ("failed", "a", "catalog", None, 3, 3, 3, "phase"), ("completed", "b", "catalog", None, 3, 3, 3, "fingerprint"), ("completed", "a", "catalog", "g", 3, 3, 3, "scope"),
        ("completed", "a", "pastbids", None, 3, 3, 3, "scope"), ("completed", "a", "pastbids", "g", 3, 3, 3, None), ("completed", "a", "search", None, 4, 3, 3, "count"), ("completed", "a", "search", None, 3, 3, 2, "unique"), (None, "a", "search", None, 3, 3, 3, "phase"),
    ],
)
def test_refusals(spark, phase, own, kind, scope, total, items, ids, want):
    job = _struct(phase=(phase, "string"), fingerprint=(own, "string"), scope_id=(scope, "string"), expected_total=(total, "long"))
    page = _struct(fingerprint=("a", "string"), kind=(kind, "string"), visible_total=(None, "long"))
    assert one(spark, J.refusal(job, page, F.lit(items), F.lit(ids))) == want


@pytest.mark.parametrize("kind,scope,total,visible,group,want", [("catalog", None, 3, 3, "", True), ("catalog", None, 3, 4, "", False), ("catalog", "g", 3, 3, "", False), ("pastbids", "g", 3, 9, "g", True), ("pastbids", "g", 3, 9, "", False), ("catalog", None, 3, None, None, True)])
def test_job_of_a_page(spark, kind, scope, total, visible, group, want):
    job = _struct(phase=("completed", "string"), fingerprint=("a", "string"), scope_id=(scope, "string"), expected_total=(total, "long"))
    page = _struct(fingerprint=("a", "string"), kind=(kind, "string"), visible_total=(visible, "long"))
    assert one(spark, J.matches(job, page, F.lit(group).cast("string"))) is want


def test_natural_order(spark):
    names = ["10a", "9", "10", "Lot 2", "lot 010", "lot 9", "1" * 25]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(J.natural(F.col("n")))
    assert [r["n"] for r in rows.collect()] == ["9", "10", "10a", "1" * 25, "Lot 2", "lot 9", "lot 010"]


UNSAFE = {"records.0.sale_date": "Jul 12, 2026 Buyer: J. Doe", "records.0.buyer_email": "a@b.example", "records.0.buyerName": "J. Doe", "records.0.nested.message": "Please call 212-555-0100 or x.y@mail.example", "records.0.nested.note": "Ship to 123 Example Street", "page_kind": "sold"}


def test_private_data(spark):
    record = F.create_map(*(F.lit(x) for pair in UNSAFE.items() for x in pair))
    clean = one(spark, J.asserted(J.scrubbed_fields(record)))
    assert clean == {"records.0.sale_date": "Jul 12, 2026 buyer: [private]", "records.0.nested.message": "Please call [phone] or [email]", "records.0.nested.note": "Ship to [address]", "page_kind": "sold"}
    with pytest.raises(Exception, match="unsafe buyer pii"):
        one(spark, J.asserted(record))


def test_rules_that_queries_share(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first()["x"]
    lit = lambda x, t: F.lit(x).cast(t)
    assert [one(listing.stated_premium(lit(t, "string"))) for t in ("A buyer's premium of 15% online, 18% on site. 29% off.", "Premium 45%", "29% off", None)] == [18.0, None, None, None]
    assert [one(listing.size_conflict(lit(a, "string"), lit(b, "string"))) for a, b in (("Shirt size XL", "Size: M"), ("size XL", "Size: m, size xl"), ("size XL", ""), ("size s", None))] == [True, False, False, False]
    assert [one(J.stored_amount(lit(t, "string"))) for t in ("1.5", " ", "n/a", None, "0")] == [1.5, None, None, None, 0.0]
    assert [one(J.stored_quantity(lit(t, "string"))) for t in ("3", "0", "900", "x", None)] == [3, 1, 500, 1, 1]
    assert [tuple(one(M.transaction(F.lit(f), F.lit(10.0), F.lit(-2.0)))) for f in "RAN"] == [("refund", -10.0, 2.0, -12.0), ("sale", 10.0, 2.0, 8.0), ("pending", 10.0, 2.0, 8.0)]
    assert [tuple(one(match.overridden(lit(a, "string"), lit(b, "string"), 7))) for a, b in (("u", "f"), (None, "f"), (None, None))] == [("u", 100), ("f", 7), (None, None)]
    shown = lambda bid, status, raw="": F.struct(F.lit(bid).alias("current_bid"), F.lit(status).alias("status"), F.lit(raw).alias("raw_text"))
    record = lambda bid, status: F.struct(lit(bid, "double").alias("current_bid"), F.lit(status).alias("status"))
    none = F.lit(None).cast("struct<current_bid:double,status:string>")
    cases = [(shown(9.0, "Open"), record(0.0, "")), (shown(9.0, "Closed"), record(0.0, "Sold")), (shown(9.0, "", "Price Realized: $9"), record(None, "Sold")), (shown(9.0, "closed"), record(5.0, "")), (shown(0.0, "Closed"), record(None, "x")), (shown(9.0, "Open"), none)]
    assert [tuple(one(L.merged_visible(a, b))) for a, b in cases] == [(0.0, "Open", True), (9.0, "Sold", True), (9.0, "Sold", True), (5.0, "closed", True), (None, "x", True), (9.0, "Open", False)]
