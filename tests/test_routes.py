"""Page URLs whose routes, fingerprints and requests are known."""

import pytest
from pyspark.sql import functions as F

from lotwright.functions import routes as R

SITE = "example.com"
KINDS = [
    ("https://example.com/catalog/765226/example", "catalog"), ("https://example.com/livecatalog/752334/example", "livecatalog"), ("https://example.com/lots/40198/computers?q=pc", "search"), ("https://example.com/newjersey/lots/40196/electronics", "search"),
    ("https://example.com/newjersey/catalog/765226/example", "catalog"), ("https://example.com/newjersey/livecatalog/752334/example", "livecatalog"), ("https://example.com/lot/123/example", "lot"), ("https://example.com/newjersey/lot/123/example", "lot"),
    ("https://example.com/account/watchlist", "watchlist"), ("https://example.com/newjersey/account/watchlist", "watchlist"), ("https://example.com/account/currentbids?status=WINNING", "currentbids-winning"), ("https://example.com/account/currentbids?status=OUTBID", "currentbids-outbid"),
    ("https://example.com/account/pastbidsm", "pastbids"), ("https://example.com/account/pastwatchlist", "pastwatchlist"), ("https://badexample.com/lot/1", "unsupported"), ("https://www.EXAMPLE.com/LOT/1", "lot"), ("https://example.com/", "unsupported"), (None, "unsupported"),
]


@pytest.fixture(scope="module")
def routes(spark):
    rows = spark.createDataFrame([(u,) for u, _ in KINDS], "url string").withColumn("r", R.route(F.col("url"), SITE)).collect()
    return {r["url"]: r["r"] for r in rows}


def test_kinds(routes):
    assert {u: routes[u]["kind"] for u, _ in KINDS} == dict(KINDS)


def test_parts_of_routes(routes):
    category = routes["https://example.com/lots/40198/computers?q=pc"]
    assert (category["auction_id"], category["category_id"], category["site_type"]) == (None, "40198", 0)
    state = routes["https://example.com/newjersey/lots/40196/electronics"]
    assert (state["state_prefix"], state["site_type"], state["category_id"]) == ("newjersey", 2, "40196")
    sale = routes["https://example.com/newjersey/catalog/765226/example"]
    assert (sale["auction_id"], sale["state_prefix"], sale["site_type"], sale["reason"]) == ("765226", "newjersey", 2, None)
    assert routes["https://badexample.com/lot/1"]["reason"] == "unsupported host" and routes["https://example.com/"]["reason"] == "unsupported route"


def test_fingerprints_ignore_pagination_only(spark):
    a = "https://example.com/lots/40198/x?q=gaming+pc&status=OPEN&apage=1"
    b = "https://example.com/lots/40198/x?apage=9&status=OPEN&q=gaming+pc"
    rows = spark.createDataFrame([(a,), (b,), (b.replace("gaming+pc", "laptop"),)], "url string")
    got = [r[0] for r in rows.select(R.canonical(F.col("url"), R.route(F.col("url"), SITE))).collect()]
    assert got[0] == got[1] != got[2]
    assert got[0] == '{"host":"example.com","path":"/lots/40198/x","kind":"search","auctionId":null,"categoryId":"40198","filters":[["q","gaming pc"],["status","OPEN"]]}'


def test_requests(spark):
    url = "https://example.com/catalog/7?q=%20pc%20&zip=08817&status=open,closed&status=OPEN&s=time%20left&archive=1&countryname=United%20States&shippingoffered=yes"
    u = F.lit(url)
    r = spark.range(1).select(R.search_request(u, R.route(u, SITE), F.lit(0), F.lit(500)).alias("s"), R.page_variables(u, R.route(u, SITE), F.lit(2), F.lit(50)).alias("p"), R.page_variables(u, R.route(u, SITE), F.lit(1), F.lit(100), F.array(F.lit(4), F.lit(5))).alias("h")).first()
    assert r["s"].asDict() == {"query": "pc", "auction_id": 7.0, "category_id": None, "country": "USA", "zip": "08817", "radius": 50.0, "page": 1, "size": 100, "shipping": True, "sort_order": "TIME_LEFT", "status": ["OPEN", "CLOSED"], "site_type": 0}
    assert (r["p"]["auction_id"], r["p"]["search_text"], r["p"]["status"], r["p"]["is_archive"], r["p"]["page_length"], r["p"]["ids"]) == (7.0, "pc", "ALL", True, 50, None)
    by_id = r["h"].asDict()
    assert [by_id[k] for k in ("auction_id", "category", "search_text", "zip", "miles", "country_name", "filter")] == [None] * 7 and by_id["ids"] == [4, 5] and by_id["status"] == "ALL" and not by_id["shipping_offered"]
