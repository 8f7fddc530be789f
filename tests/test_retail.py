"""Retail lookups, requests, phases, and lots' own pages on cases with known outcomes."""

import pytest
from pyspark.sql import functions as F

from lotwright.functions import identity as I
from lotwright.functions import retail as R
from lotwright.sources import detail


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "price,used,sponsored,stated,want",
    [(30.0, False, False, 100.0, True), (29.9, False, False, 100.0, False), (5.0, None, None, None, True), (5.0, True, False, None, False), (5.0, False, True, None, False), (None, False, False, None, False), (5.0, False, False, float("nan"), True)],
)
def test_candidates_that_take_part(spark, price, used, sponsored, stated, want):
    offer = F.struct(F.lit(price).cast("double").alias("price"), F.lit(used).cast("boolean").alias("used"), F.lit(sponsored).cast("boolean").alias("sponsored"))
    assert one(spark, R.takes_part(offer, F.lit(stated).cast("double"))) is want


def test_eligibility(spark):
    cases = [("USD", False, False, "tv"), ("CAD", False, False, "tv"), ("USD", True, False, "tv"), ("USD", False, True, "tv"), ("USD", False, False, ""), ("USD", False, False, None)]
    rows = spark.createDataFrame(cases, "c string, m boolean, q boolean, t string")
    assert [r[0] for r in rows.select(R.eligible(*(F.col(x) for x in "cmqt"))).collect()] == [True, False, False, False, False, False]


def test_sanitised_offers(spark):
    rows = [("b000000001", " A   b ", None, 1.0), ("short", "t", None, 1.0), ("B000000002", "", None, 1.0), ("B000000003", "t" * 900, "m" * 900, None), ("B000000004", "t", None, 0.0), ("B000000005", "t", None, float("inf"))] + [("B000000006", "t", None, 1.0)] * 40
    df = spark.createDataFrame([([(k, t, m, p, None, None) for k, t, m, p in rows],)], "o array<struct<key:string,title:string,match_text:string,price:double,used:boolean,sponsored:boolean>>")
    got = df.select(R.sanitised(F.col("o")).alias("o")).first()["o"]
    assert [(o["key"], len(o["title"]), len(o["match_text"]), o["price"]) for o in got[:2]] == [("B000000001", 3, 3, 1.0), ("B000000003", 500, 800, None)] and len(got) == 2 + 24


def test_revalidated_identity(spark):
    rows = spark.createDataFrame([("Sony WH-1000XM5 headphones black",), ("x",)], "t string")
    rows = I.identified(rows, "t").withColumn("identity", F.col("identity").withField("kind", F.lit("laptop")).withField("tokens", F.array_repeat(F.lit("w" * 99), 50)).withField("seriesSignatures", F.array(F.lit("forged"))))
    good, short = (r["checked"] for r in R.revalidated(rows, "identity").collect())
    assert (good["kind"], good["model"], good["colors"], good["seriesSignatures"], len(good["tokens"]), len(good["tokens"][0])) == ("headphones", "WH-1000XM5", ["black"], [], 20, 40) and short is None


@pytest.mark.parametrize("kind,body,want", [("text/html", "<p>", None), ("application/json", "{}", "non-html"), (None, "", "non-html"), ("TEXT/HTML", "é" * 2_500_001, "too-large"), ("text/html", "Enter the characters you see below", "challenge"), ("text/html", None, None)])
def test_answers(spark, kind, body, want):
    df = spark.createDataFrame([(kind, body)], "k string, b string")
    assert df.select(R.admitted(F.col("k"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize("before,phase,want", [(None, "queued", True), (None, "completed", False), ("queued", "enumerating", True), ("hydrating", "enumerating", False), ("validating", "completed", True), ("enumerating", "stale", True), ("completed", "failed", False), ("completed", "queued", True), ("stopping", "stopped", True)])
def test_phases(spark, before, phase, want):
    assert one(spark, R.may_follow(F.lit(before).cast("string"), F.lit(phase))) is want


PAGE = """<html><head><style>.a{content:'High Bid: $9'}</style></head><body><h1>Page heading</h1><p hidden>High Bid: $7.00</p>
<table><tr><th>Lot #:</th><td>12B</td></tr><tr><th>Lead</th><td>Acme &amp; Co drill</td></tr><tr><th>Group - Category</th><td>Tools</td></tr><tr><th>Description</th><td>Works <b>well</b></td></tr><tr><td>Quantity</td><td>3</td></table>
<div class="lot-images"><img src="/1.jpg"><img data-src="https://i.example/2.jpg"><img src="/spacer.gif"><img src="http://i.example/3.jpg"></div>
<aside><div class="description">Other lot</div><img src="/ad.jpg"></aside><p>High Bid: $1,040.50 | 4 Bids</p><p>Minimum Next Bid: $1,050</p><p>Time left 1d 3h 2m 5s. Will ship. Outbid</p><p>Buyer's Premium: 15% | more</p></body></html>"""


def test_a_lot_page(spark):
    rows = spark.createDataFrame([(1, "https://s.example/lot/77/acme?auction=9", PAGE), (2, "https://s.example/about", PAGE), (3, "https://s.example/lot/5", None), (4, None, "<p data-event-item-id=8 style='display: none'>No matches</p><p>Condition: Good | Lot 9")], "id long, url string, html string")
    got = {r["k"]: r.asDict() for r in detail.lot_details(rows.withColumnRenamed("id", "k").withColumn("lot", F.lit("x")), "html", "url", ["k"]).collect()}
    assert sorted(got) == [1, 3, 4]
    want = {
        "id": "77", "lot": "12B", "lead": "Acme & Co drill", "category": "Tools", "description": "Works well", "images": ["https://s.example/1.jpg", "https://i.example/2.jpg"], "current_bid": 1040.5, "next_bid": 1040.5,
        "bid_count": 4, "status": "Outbid", "time_left": "1d 3h 2m 5s", "shipping_offered": True, "auction_id": "9", "buyer_premium": "15%",
    }
    assert {k: got[1][k] for k in want} == want and "7.00" not in got[1]["raw_text"]
    assert (got[3]["id"], got[3]["lot"], got[3]["lead"], got[3]["images"], got[3]["raw_text"]) == ("5", "5", "Lot 5", [], "")
    assert (got[4]["id"], got[4]["lot"], got[4]["fields"]["Condition"], got[4]["raw_text"]) == ("8", "9", "Good", "Condition: Good | Lot 9")
