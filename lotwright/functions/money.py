"""Costs, indicators and verdicts of auction lots as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Whether x is a number at all: neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))


def money_or_null(x: Column) -> Column:
    """A finite amount of 0 or more; null otherwise."""
    return F.when(finite(x) & (x >= 0), x)


def all_in(hammer: Column, premium_pct: Column, tax_pct: Column, tax_on_premium: bool = True) -> Column:
    """struct(hammer, premium, taxable, tax, total); null parts where an input is no amount."""
    h, p, t = money_or_null(hammer), money_or_null(premium_pct), money_or_null(tax_pct)
    premium = h * p / 100
    taxable = h + premium if tax_on_premium else h + premium * 0
    tax = taxable * t / 100
    return F.struct(h.alias("hammer"), premium.alias("premium"), taxable.alias("taxable"), tax.alias("tax"), (h + premium + tax).alias("total"))


def cents(x: Column) -> Column:
    """Dollars to whole cents, halves up."""
    return F.floor(x * 100 + 0.5).cast("long")


def all_in_cents(hammer: Column, premium_pct: Column, tax_pct: Column, shipping: Column | None = None) -> Column:
    """Whole-cent cost: premium rounded to a cent, then tax on hammer and premium rounded to a cent."""
    premium = F.floor(hammer * premium_pct / 100 + 0.5).cast("long")
    tax = F.floor((hammer + premium) * tax_pct / 100 + 0.5).cast("long")
    total = hammer + premium + tax
    return total if shipping is None else total + shipping


def max_bid_cents(budget: Column, premium_pct: Column, tax_pct: Column) -> Column:
    """The highest whole-cent hammer whose all-in cost is within budget; null where even 0 is not.

    The cost rises with the hammer and differs from its unrounded value by at most a cent, so the answer lies within two
    cents of the closed form.
    """
    estimate = F.floor(budget / ((1 + premium_pct / 100) * (1 + tax_pct / 100))).cast("long")
    near = F.sequence(F.greatest(estimate - 2, F.lit(0).cast("long")), F.greatest(estimate + 2, F.lit(0).cast("long")))
    return F.when(budget >= 0, F.array_max(F.filter(near, lambda h: all_in_cents(h, premium_pct, tax_pct) <= budget)))


def hammer(next_bid: Column, current_bid: Column) -> Column:
    """The next bid if above 0, else the current one if 0 or more, else null."""
    return F.when(finite(next_bid) & (next_bid > 0), next_bid).when(finite(current_bid) & (current_bid >= 0), current_bid)


def current_bid(realized: Column, high: Column, price: Column) -> Column:
    return F.when(realized > 0, realized).otherwise(F.coalesce(high, price))


def net_resale(price: Column, fee_pct: float = 13.25, fixed: float = 0.30) -> Column:
    """Proceeds after fees, never below 0; null for a null price."""
    return F.when(price.isNotNull(), F.greatest(F.lit(0.0), price * (1 - fee_pct / 100) - fixed))


def ratio(cost: Column, market: Column) -> Column:
    return F.when(finite(cost) & finite(market) & (market > 0), cost / market)


def band(r: Column) -> Column:
    """Indicator class of a cost-to-market ratio."""
    return F.when(r.isNull(), "na").when(r < 0.5, "green").when(r < 0.65, "yellow").when(r < 0.75, "orange").otherwise("red")


def market_value(status: Column, price: Column, quantity: Column) -> Column:
    return F.when((status == "matched") & finite(price) & (price > 0), price * F.greatest(F.lit(1), F.coalesce(quantity, F.lit(1))))


def verdict(parts_only: Column, status: Column, next_hammer: Column, cost: Column, max_bid: Column, retail: Column) -> Column:
    """What to do about a lot one has bid on; the first rule that applies decides."""
    winning, outbid = status.rlike("(?i)winning|won"), status.rlike("(?i)outbid|losing")
    priced = finite(cost) & finite(retail) & (retail > 0)
    limited = finite(max_bid) & finite(next_hammer)
    over = next_hammer > max_bid
    return (
        F.when(F.coalesce(parts_only, F.lit(False)), "parts_only")
        .when(F.coalesce(winning, F.lit(False)), F.when(~priced, "manual").when(cost > retail, "winning_above_retail").otherwise("hold"))
        .when(~(limited & priced), "manual")
        .when(F.coalesce(outbid, F.lit(False)), F.when(over, "let_go").otherwise("raise"))
        .when(over, "at_ceiling")
        .otherwise("under_ceiling")
    )


def roi_class(profit: Column, cost: Column) -> Column:
    roi = F.try_divide(profit, cost)
    return F.when(roi >= 0.5, "positive").when(profit < 0, "negative").otherwise("neutral")


def premium_pct(user: Column, parsed: Column, parsed_age_days: Column, page: Column) -> Column:
    """The user's rate, else one parsed at most 30 days ago, else the page's, else 15."""
    return F.coalesce(user, F.when(parsed_age_days <= 30, parsed), page, F.lit(15.0))


def money_text(x: Column) -> Column:
    """The first unsigned number of a text, thousands commas removed; null without one."""
    digits = F.replace(F.regexp_extract(x, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit(""))
    return F.nullif(digits, F.lit("")).try_cast("double")


def usd(x: Column) -> Column:
    """$1,234.50, or -- for what is no number."""
    body = F.format_number(F.abs(x), 2)
    return F.when(finite(x), F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), body)).otherwise("--")


def max_bid_label(current: Column, max_bid: Column) -> Column:
    return F.when(max_bid.isNull() | current.isNull(), "none").when(current < max_bid, "under").when(current == max_bid, "at").otherwise("over")


def first_number(x: Column, signed: bool = False) -> Column:
    """The first number in text, commas taken out; with ``signed`` a minus before it counts."""
    return F.nullif(F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), (r"-?" if signed else "") + r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def usd_number(x: Column) -> Column:
    """The first amount in text that is followed by USD; null if there is none."""
    return F.nullif(F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"(?i)(\d+(?:\.\d+)?)\s*USD(?![A-Za-z0-9_])", 1), F.lit("")).try_cast("double")


def transaction(flag: Column, amount: Column, fee: Column) -> Column:
    """struct(kind, gross, fee, net) of an account's line: sales (A) and refunds (R), all others pending; a refund's gross is negative, fees are positive."""
    kind = F.when(flag == "R", "refund").when(flag == "A", "sale").otherwise("pending")
    gross, cost = F.when(flag == "R", -amount).otherwise(amount), F.abs(fee)
    return F.struct(kind.alias("kind"), gross.alias("gross"), cost.alias("fee"), (gross - cost).alias("net"))
