"""The wide record that decisions about a lot are made from: what it is, its state, its cost, what it may bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import identity as I
from . import listing as L
from . import money as M
from . import retail as R

#: Fixed value: the buyer's premium in per cent where none is known.
PREMIUM = 15.0


def analysed(lots: DataFrame, stored: DataFrame, premiums: DataFrame, tax_pct: Column, fee_pct: float = 13.25, fee_fixed: float = 0.30, tax_on_premium: bool = True) -> DataFrame:
    """The columns of lots with state, stated_retail, identity, condition, mixed, quantity, needs_quantity, currency, hammer, premium_pct, all_in, ebay_net, amazon, amazon_indicator, ebay_indicator and eligible.

    ``lots`` has id, title, lead, description, estimate, quantity, next_bid, current_bid, auction_id, buyer_premium and raw_text; ``stored``
    id, resale, confirmed_quantity and query_override, a row for each lot that has a state; ``premiums`` auction_id and pct. The lead
    names the product before the title. The premium is the auction's, else the lot's own, else PREMIUM. A lot in Canadian
    dollars, or without a bid, has no cost. ``amazon`` is null until a lookup has answered; till then its indicator compares the
    stated retail price. An override takes the place of the search phrase.
    """
    state = stored.select(F.col("id").alias("_a_id"), F.struct("resale", "confirmed_quantity", "query_override").alias("state"))
    pct = premiums.select(F.col("auction_id").alias("_a_auction"), F.col("pct").alias("_a_pct"))
    rows = lots.join(state, F.col("id") == F.col("_a_id"), "left").join(pct, F.col("auction_id") == F.col("_a_auction"), "left")
    named = F.coalesce(F.nullif(F.col("lead"), F.lit("")), F.col("title"))
    rows = rows.withColumns({"_a_name": named, "stated_retail": L.stated_retail(named, F.col("description"), F.col("estimate"))})
    rows = L.assessed(I.identified(rows, "_a_name", "description", "stated_retail"), "description")
    override = F.nullif(F.col("state.query_override"), F.lit(""))
    rows = rows.withColumns({"identity": F.col("identity").withField("query", F.coalesce(override, F.col("identity.query"))), "mixed": L.mixed_lot(F.col("_a_name"), F.col("description"))})
    quantity = F.coalesce(F.col("quantity").cast("double"), M.first_number(F.coalesce(F.col("condition.fields")["quantity"], F.lit(""))))
    rows = rows.withColumns({"quantity": quantity, "currency": L.comparison_currency(F.col("raw_text"), F.col("buyer_premium")), "hammer": M.hammer(F.col("next_bid"), F.col("current_bid"))})
    rows = rows.withColumns(
        {
            "needs_quantity": L.needs_quantity(F.col("quantity"), F.col("mixed.mixed"), F.col("state.confirmed_quantity")),
            "premium_pct": F.coalesce(F.col("_a_pct").cast("double"), M.first_number(F.coalesce("buyer_premium", F.lit(""))), F.lit(PREMIUM)),
            "ebay_net": M.net_resale(F.col("state.resale"), fee_pct, fee_fixed),
        }
    )
    rows = rows.withColumn("all_in", F.when((F.col("currency") == "USD") & F.col("hammer").isNotNull(), M.all_in(F.col("hammer"), F.col("premium_pct"), tax_pct, tax_on_premium)))
    indicator = lambda market: M.band(M.ratio(F.col("all_in.total"), market))
    rows = rows.withColumns(
        {
            "amazon": F.lit(None).cast("struct<asin:string,title:string,price:double>"), "amazon_indicator": indicator(F.col("stated_retail")), "ebay_indicator": indicator(F.col("state.resale")),
            "eligible": R.eligible(F.col("currency"), F.col("mixed.mixed"), F.col("needs_quantity"), F.col("identity.query")),
        }
    )
    return rows.drop("_a_id", "_a_auction", "_a_pct", "_a_name")


def masked(rows: DataFrame, private: list[str], opted_in: bool) -> DataFrame:
    """rows without their private columns, unless the user has opted in; columns that rows do not have are ignored."""
    return rows if opted_in else rows.drop(*private)
