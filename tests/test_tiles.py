"""Tiles and groups by element tree: known outcomes for account pages, id fallbacks, prefixes, nesting."""

import pytest

from lotwright.sources import tiles

PAGE = "html string, url string, kind string, grp string"
ACCOUNT = """
<section class="listing-box">
  <div class="listing-box-title"><a href="/catalog/765226/a"><strong>Auction A</strong></a><a href="https://maps.google.com/maps?q=Paterson,+NJ">Paterson, NJ</a> | July 31 - August 8</div>
  <app-lot-tile id="lot-6"><a href="/lot/6/headset">Lot 6 | Wireless Headset</a><img src="https://img/6.jpg">High Bid: $35 4 Bids Won</app-lot-tile>
</section>
<section class="listing-box">
  <div class="listing-box-title"><a href="/catalog/999999/b"><strong>Auction B</strong></a><a href="https://maps.google.com/maps?q=Edison,+NJ">Edison, NJ</a></div>
  <app-lot-tile id="lot-9"><a href="/lot/9/other">Lot 9 | Other</a></app-lot-tile>
</section>"""
WATCHED = """<div class="lot-tiles">
  <app-watched-auction-header><div><div class="listing-box-title"><a href="/catalog/111/a"><strong>Auction A</strong></a><a href="https://maps.google.com/maps?q=C">Cambridge, MA</a></div></div></app-watched-auction-header>
  <app-lot-tile id="lot-101"><a href="/lot/101/first">Lot 1 | First</a></app-lot-tile><app-lot-tile id="lot-102"><a href="/lot/102/second">Lot 2 | Second</a></app-lot-tile>
  <app-watched-auction-header><div><div class="listing-box-title"><a href="/catalog/222/b"><strong>Auction B</strong></a></div></div></app-watched-auction-header>
  <app-lot-tile id="lot-201"><a href="/lot/201/other">Lot 3 | Other</a></app-lot-tile></div>"""


def lots(spark, html, kind="catalog", group=None):
    df = tiles.account_lots(spark.createDataFrame([(html, "https://site.example/x/y", kind, group)], PAGE), "html", "url", "kind", "grp", ["kind"])
    return sorted(df.collect(), key=lambda r: r["pos"])


def groups(spark, html):
    df = tiles.auction_groups(spark.createDataFrame([(html, "https://site.example/x/y", "", "")], PAGE), "html", "url", ["grp"])
    return sorted(df.collect(), key=lambda r: r["pos"])


def test_boxed_groups_stay_apart(spark):
    got = groups(spark, ACCOUNT)
    assert [(r["id"], r["title"], r["location"], r["dated"], r["expected"], r["visible"]) for r in got] == [("765226", "Auction A", "Paterson, NJ", "July 31 - August 8", 1, 1), ("999999", "Auction B", "Edison, NJ", "", 1, 1)]
    r = lots(spark, ACCOUNT, "pastwatchlist", "765226")
    assert [(x["id"], x["lot"], x["title"], x["url"], x["images"], x["current_bid"], x["bid_count"], x["status"]) for x in r] == [("6", "6", "Wireless Headset", "https://site.example/lot/6/headset", ["https://img/6.jpg"], 35.0, 4, "Won")]
    assert not lots(spark, ACCOUNT, "pastwatchlist") and not lots(spark, ACCOUNT, "pastbids", "5")
    assert [x["id"] for x in lots(spark, ACCOUNT)] == ["6", "9"]


def test_groups_between_sibling_headings(spark):
    assert [(r["id"], r["expected"], r["visible"]) for r in groups(spark, WATCHED)] == [("111", 2, 2), ("222", 1, 1)]
    assert [x["id"] for x in lots(spark, WATCHED, "pastbids", "111")] == ["101", "102"]
    got = lots(spark, WATCHED, "watchlist")
    assert [(x["id"], x["lot"], x["auction_id"], x["auction_title"], x["location"]) for x in got] == [("101", "1", "111", "Auction A", "Cambridge, MA"), ("102", "2", "111", "Auction A", "Cambridge, MA"), ("201", "3", "222", "Auction B", "")]


def test_a_group_says_how_many_lots_it_has(spark):
    html = WATCHED.replace("<app-lot-tile id=\"lot-201\">", "<p hidden>Showing 1 - 5 of 9 lots</p><p>Showing 1 to 1 of 87 lots</p><app-lot-tile id=\"lot-201\">")
    assert [(r["id"], r["expected"], r["visible"]) for r in groups(spark, html)] == [("111", 2, 2), ("222", 87, 1)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<div data-event-item-id="5"><a href="/lot/77/x">Saw</a></div>', [("77", "77", "Saw", "https://site.example/lot/77/x")]),
        ('<div data-event-item-id="5"><p><b data-event-item-id="8">Rug</b></p></div>', [("8", "8", "Lot 8", "https://site.example/lot/8")]),
        ('<div data-event-item-id="5">no name</div>', []),
        ('<div class="bid-status-border" id="lot-3"><h4>Lot # 12.A-b : Vase</h4></div>', [("3", "12.A-b", "Vase", "https://site.example/lot/3")]),
        ('<div class="bid-status-border" id="x3"></div><app-lot-tile></app-lot-tile>', []),
        ('<app-lot-tile id="lot-4"><i class="sub-title">Lot 9</i> Lot 10</app-lot-tile>', [("4", "9", "Lot 9", "https://site.example/lot/4")]),
        ('<app-lot-tile id="lot-4"><h2>Desk</h2> Lot #10 Winning</app-lot-tile>', [("4", "10", "Desk", "https://site.example/lot/4")]),
        ('<app-lot-tile id="lot-4"><div id="lot-5" class="bid-status-border"><h2>In</h2></div></app-lot-tile><app-lot-tile id="lot-5"><h2>Out</h2></app-lot-tile>', [("4", "4", "In", "https://site.example/lot/4"), ("5", "5", "In", "https://site.example/lot/5")]),
        (None, []), ("", []), ("<app-lot-tile id='lot-1'>" * 3000, [("1", "1", "Lot 1", "https://site.example/lot/1")]),
    ],
)
def test_names_and_prefixes(spark, html, want):
    assert [(x["id"], x["lot"], x["title"], x["url"]) for x in lots(spark, html)] == want
