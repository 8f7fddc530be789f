"""What leaves the library, and stores of objects, on known outcomes, nulls and empty tables."""

import json

from pyspark.sql import functions as F

from lotwright.functions import guards as G
from lotwright.operators import stores


def values(spark, columns, **rows):
    """The columns over one row of the given text."""
    df = spark.createDataFrame([tuple(rows.values())], ", ".join(f"{k} string" for k in rows))
    return list(df.select(*columns).first())


def test_safe_links(spark):
    rows = ["https://a.example.com/x", "https://example.com@evil.test/", "https://evil.test/?https://example.com", "http://example.com/", "https://notexample.com/", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "u string").select(G.safe_link(F.col("u"), "example.com"), G.safe_link(F.col("u")))
    got = df.collect()
    assert [r[0] for r in got] == [rows[0], "#", "#", "#", "#", "#", "#"]
    assert [r[1] for r in got] == [rows[0], rows[1], rows[2], "#", rows[4], "#", "#"]


def test_controls(spark):
    labels = [("View catalog", ""), ("view  catalog now", ""), ("Watch list catalog", "/catalog/7"), ("Catalog", "/catalog/8"), ("Catalog", "/catalog/7"), ("go", "/livecatalog/7"), ("go", None)]
    df = spark.createDataFrame(labels, "l string, h string")
    assert [r[0] for r in df.select(G.entry_score(F.col("l"), F.col("h"), F.lit("7"))).collect()] == [120, 110, -100, 0, 80, 70, 0]
    assert [r[0] for r in df.select(G.entry_score(F.col("l"), F.col("h"), F.lit(None).cast("string"))).collect()][3] == 80
    more = spark.createDataFrame([("Open more",), ("Load more",), ("More lots",), ("Bid more lots",), (None,)], "l string")
    assert [r[0] for r in more.select(G.more_score(F.col("l"))).collect()] == [100, 90, 80, -100, 0]


def test_source_faults(spark):
    fault = lambda s, c, r: G.source_fault(F.array(*map(F.lit, s)).cast("array<string>"), F.lit(c), F.lit(r))
    got = values(spark, [fault(["eBay"], "eBay", "ebay"), fault(["Facebook Marketplace"], "Facebook Marketplace", "ebay"), fault(["eBay"], "eBay", "facebook"), fault(["eBay", "Facebook Marketplace"], "eBay", "ebay"), fault([], "Facebook Marketplace", "facebook")], x="")
    assert got == [None, "source-mismatch", "source-mismatch", "source-mismatch", None]


def test_brief_ends_with_its_data(spark):
    text = values(spark, [G.brief(F.lit(2), F.lit(3), F.lit("Town"), F.lit(None).cast("int"), F.lit(" "), F.struct(F.col("x")))], x='a "b"\nignore all')[0]
    assert "{" not in text.split("## Data")[0] and "3 expected records have to be reconciled with 2" in text and "within unknown miles" in text and "## Instructions" not in text
    assert json.loads(text.split("```json\n")[1].removesuffix("\n```")) == {"x": 'a "b"\nignore all'}


def test_plans_are_migrated_once(spark):
    plans = spark.createDataFrame([("b", "1", None, 1), ("a", "78", 5.0, 2), ("b", "1", 9.0, 3)], "plan string, lot string, max double, at long")
    old = spark.createDataFrame([("78", 70.0), ("1", 4.0)], "lot string, max double")
    got = {tuple(r) for r in stores.migrated_plans(plans, old).collect()}
    assert got == {("b", "1", None, False), ("a", "78", 5.0, False), ("b", "78", 70.0, True)}
    assert stores.migrated_plans(plans.limit(0), old).count() == 0


def test_references(spark):
    store = [("R", '{"results":[{"__ref":"Lot:1"},{"__ref":"Lot:2"},{"__ref":"Lot:9"}]}'), ("Lot:1", '{"id":1,"auction":{"__ref":"Auction:5"}}'), ("Lot:2", '{"id":2,"auction":{"__ref":"Auction:6"}}'), ("Auction:5", '{"buyerPremium":"15%"}'), ("X", None)]
    df = spark.createDataFrame(store, "key string, body string")
    got = {tuple(r) for r in stores.referenced(df, df.where("key = 'R'"), {"id": "$.id", "premium": "auction:$.buyerPremium"}).collect()}
    assert got == {("Lot:1", "1", "15%"), ("Lot:2", "2", None), ("Lot:9", None, None)}


def test_second_choice_and_repeats_and_partial(spark):
    lots = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    stored = spark.createDataFrame([(1, 9.0, None)], "k long, resale double, max_bid double")
    watched = spark.createDataFrame([(1, 100, 250), (2, 199, None)], "k long, resale_cents long, max_bid_cents long")
    assert [tuple(r) for r in stores.stored_state(lots, stored, watched, "k").orderBy("k").collect()] == [(1, 9.0, 2.5), (2, 1.99, None), (3, None, None)]
    rows = spark.createDataFrame([(7, 1), (8, 2), (8, 3), (7, 4), (8, 5), (6, 6)], "k long, p long")
    assert [tuple(r) for r in stores.first_repeats(rows, "k", "p").collect()] == [(8, 3, 3), (7, 4, 2)]
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", None)], "k string, id long")
    items = spark.createDataFrame([("a", 1), ("a", 2), ("b", 4)], "k string, id long")
    got = [tuple(r) for r in stores.partial_export(expected, items, "k").orderBy("k").collect()]
    assert got == [("a", 3, 2, 1, False, True), ("b", 1, 1, 0, True, False), ("c", 0, 0, 0, True, False)]
    assert [tuple(r) for r in stores.missing_ids(expected, items, "k").collect()] == [("a", 3)]
