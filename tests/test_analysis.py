"""The wide record of a lot: premiums, currency, quantities, indicators, overrides."""

from pyspark.sql import functions as F

from lotwright.functions import analysis

LOT = "id long, title string, lead string, description string, estimate string, quantity double, next_bid double, current_bid double, auction_id long, buyer_premium string, raw_text string"


def records(spark, lots, stored=(), premiums=(), **settings):
    stored = spark.createDataFrame(list(stored), "id long, resale double, confirmed_quantity double, query_override string")
    rows = analysis.analysed(spark.createDataFrame(lots, LOT), stored, spark.createDataFrame(list(premiums), "auction_id long, pct double"), F.lit(6.625), **settings)
    return {r["id"]: r for r in rows.collect()}


def lot(i, title="Acme TV 55", **other):
    own = {"lead": "", "description": "", "estimate": None, "quantity": None, "next_bid": 100.0, "current_bid": 90.0, "auction_id": 1, "buyer_premium": None, "raw_text": ""} | other
    return (i, title, *own.values())


def test_premium_of_auction_then_lot_then_usual(spark):
    got = records(spark, [lot(1), lot(2, auction_id=2), lot(3, auction_id=2, buyer_premium="12.5% online"), lot(4, auction_id=None), lot(5, auction_id=9, buyer_premium="none")], premiums=[(1, 18.0)])
    assert [got[k]["premium_pct"] for k in range(1, 6)] == [18.0, 15.0, 12.5, 15.0, 15.0]
    assert abs(got[1]["all_in"]["total"] - 118 * 1.06625) < 1e-9 and got[1]["hammer"] == 100.0
    assert abs(records(spark, [lot(1)], tax_on_premium=False)[1]["all_in"]["total"] - (115 + 6.625)) < 1e-9


def test_canadian_lots_and_lots_without_a_bid_have_no_cost(spark):
    got = records(spark, [lot(1, raw_text="Bids in CAD"), lot(2, next_bid=None, current_bid=None), lot(3, next_bid=0.0, current_bid=0.0), lot(4, buyer_premium="$5 CDN")])
    assert [(got[k]["currency"], got[k]["all_in"] is None, got[k]["eligible"]) for k in (1, 2, 3, 4)] == [("CAD", True, False), ("USD", True, True), ("USD", False, True), ("CAD", True, False)]
    assert got[2]["amazon_indicator"] == got[2]["ebay_indicator"] == "na"


def test_quantities_state_and_indicators(spark):
    lots = [lot(1, quantity=3.0), lot(2, quantity=3.0), lot(3, "Assorted tools"), lot(4, description="Retail: $400"), lot(5, lead="Sony XM5 Headphones", description="Quantity: 2"), lot(6, estimate="100 - 250")]
    got = records(spark, lots, [(2, 150.0, 3.0, "acme tv"), (1, None, None, ""), (4, 1.0, None, None)])
    assert [(got[k]["needs_quantity"], got[k]["eligible"]) for k in range(1, 7)] == [(True, False), (False, True), (True, False), (False, True), (True, False), (False, True)]
    assert got[2]["identity"]["query"] == "acme tv" and got[1]["identity"]["query"] not in ("", None) and got[3]["mixed"]["mixed"]
    assert (got[4]["stated_retail"], got[4]["amazon_indicator"], got[4]["ebay_indicator"], round(got[4]["ebay_net"], 9)) == (400.0, "green", "red", 0.5675)
    assert got[5]["identity"]["name"].startswith("Sony XM5") and got[6]["stated_retail"] == 250.0 and got[6]["amazon"] is None
    assert got[2]["state"]["confirmed_quantity"] == 3.0 and got[5]["state"] is None


def test_private_columns_need_an_opt_in(spark):
    rows = spark.createDataFrame([(1, "note", "x")], "id long, watch_notes string, title string")
    assert analysis.masked(rows, ["watch_notes", "email"], opted_in=False).columns == ["id", "title"]
    assert analysis.masked(rows, ["watch_notes", "email"], opted_in=True).first()["watch_notes"] == "note"
