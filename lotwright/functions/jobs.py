"""Capture jobs, settings and provider state: what may be shown, exported or retried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import ascii_words

#: Kinds of pages whose jobs belong to one chosen group.
PAST = ("pastbids", "pastwatchlist")


def matches(job: Column, context: Column, group: Column) -> Column:
    """Whether a job (fingerprint, scope_id, phase, expected_total) is that of a page (fingerprint, kind, visible_total) and the chosen group."""
    past = context["kind"].isin(*PAST)
    same = job["fingerprint"].eqNullSafe(context["fingerprint"]) & job["fingerprint"].isNotNull()
    stale = (job["phase"] == "completed") & context["visible_total"].isNotNull() & ~job["expected_total"].eqNullSafe(context["visible_total"])
    chosen = (F.coalesce(group, F.lit("")) != "") & job["scope_id"].eqNullSafe(group)
    return same & F.when(past, chosen).otherwise(job["scope_id"].isNull() & ~F.coalesce(stale, F.lit(False)))


def refusal(job: Column, context: Column, items: Column, ids: Column) -> Column:
    """Why a job's items may not be exported (null if they may): phase, fingerprint, scope, count or unique ids, in this order."""
    past = context["kind"].isin(*PAST)
    scoped = F.coalesce(job["scope_id"], F.lit("")) != ""
    return (
        F.when(~job["phase"].eqNullSafe("completed"), "phase")
        .when(~job["fingerprint"].eqNullSafe(context["fingerprint"]), "fingerprint")
        .when(F.when(past, ~scoped).otherwise(job["scope_id"].isNotNull()), "scope")
        .when(~job["expected_total"].eqNullSafe(items), "count")
        .when(ids != items, "unique")
    )


def number(x: Column) -> Column:
    """A finite number from text or a number; null else."""
    v = F.nullif(F.trim(x.cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


# Settings by name: kind, default, and the range that numbers are kept in.
SETTINGS: dict[str, tuple] = {
    "stateCode": ("text", None), "taxPctOverride": ("number", None), "taxOnPremium": ("flag", True), "ebayFeePct": ("number", 13.25), "ebayFeeFixedCents": ("number", 30.0), "catalogChips": ("flag", True),
    "nativeWatchSync": ("flag", False), "taxExempt": ("flag", False), "debugMode": ("flag", False), "includePrivateWatchNotes": ("flag", False), "amazonAutoLookup": ("flag", True), "retailTargetPct": ("number", 50.0, 1.0, 95.0),
    "retailWarningPct": ("number", 25.0, 1.0, 95.0), "originLabel": ("filled", "Edison, NJ"), "originZip": ("filled", "08817"), "radiusMiles": ("number", 100.0, 1.0, 500.0), "customInstructions": ("filled", ""),
}


def settings(stored: Column) -> Column:
    """struct of all settings from a map of text: unusable values give the default, numbers are kept in their range."""
    out = []
    for name, (kind, default, *limits) in SETTINGS.items():
        x = stored[name]
        if kind == "number":
            value = F.coalesce(number(x), F.lit(default).cast("double"))
            value = F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), value)) if limits else value
        elif kind == "flag":
            value = F.coalesce(F.when(x == "true", True).when(x == "false", False), F.lit(default))
        else:
            value = F.coalesce(F.nullif(F.trim(x) if kind == "filled" else x, F.lit("")), F.lit(default).cast("string"))
        out.append(value.alias(name))
    return F.struct(*out)


def effective_tax(exempt: Column, override: Column, state: Column) -> Column:
    """Sales tax in percent: none if exempt, else the override, else the state's, else 0."""
    rates = F.create_map(*(F.lit(x) for pair in V.STATE_TAX.items() for x in pair))
    return F.when(F.coalesce(exempt, F.lit(False)), 0.0).otherwise(F.coalesce(number(override), F.try_element_at(rates, state), F.lit(0.0)))


def throttle(stored: Column) -> Column:
    """struct(next_allowed_at, consecutive_failures, last_status, updated_at) from a map of text; what is no number is 0."""
    count = lambda n: F.coalesce(number(stored[n]), F.lit(0.0)).cast("long")
    return F.struct(count("nextAllowedAt").alias("next_allowed_at"), count("consecutiveFailures").alias("consecutive_failures"), F.coalesce(stored["lastStatus"], F.lit("")).alias("last_status"), count("updatedAt").alias("updated_at"))


def natural(x: Column) -> Column:
    """A key that sorts text by the numbers in it, whatever the case: 9 before 10 before 10a."""
    runs = F.regexp_extract_all(F.lower(x), F.lit(r"\d+|\D+"), F.lit(0))
    digits = lambda t: F.regexp_replace(t, r"^0+(?=\d)", "")
    return F.array_join(F.transform(runs, lambda t: F.when(t.rlike(r"^\d"), F.lpad(digits(t), F.greatest(F.lit(20), F.length(digits(t))), F.lit("0"))).otherwise(t)), "")


def due(rows, now: Column, most: int = 10):
    """The watched lots to be refreshed: not stale, ending after now and within a day, the soonest ``most``."""
    soon = rows.where(~F.coalesce("stale", F.lit(False)) & (F.col("ends_at") > now) & (F.col("ends_at") <= now + 86_400_000))
    return soon.orderBy("ends_at", "lot_id").limit(most)


def watch_order() -> list[Column]:
    """The order of a watchlist: by end, unknown ends last, by when a lot was added where ends are equal or unknown."""
    return [F.col("ends_at").asc_nulls_last(), F.col("added_at").asc_nulls_last(), F.col("lot_id").asc()]


# Names of fields that hold a person, and what a person is recognised by in text.
PRIVATE_FIELD = r"(?i)(?:buyer|email|e_mail|phone|address|recipient|contact|first_?name|last_?name|full_?name)"
PRIVATE_TEXT = [
    (r"(?i)\bbuyer\s*:\s*[^|,;\n]+", "buyer: [private]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[email]"),
    (r"(?:\+1[\s.-]?)?\(?\b\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", "[phone]"),
    (r"(?i)\b\d{1,6}\s+(?:[A-Za-z0-9.'-]+\s+){1,4}(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|way)\b\.?", "[address]"),
]


#: What a text must hold for a pattern of PRIVATE_TEXT to be tried: cheap tests that leave nearly all texts out.
HINTS = {"buyer: [private]": "(?i)buyer", "[phone]": r"\d{3}[\s.-]\d{4}", "[address]": r"\d\s"}


def scrubbed(x: Column) -> Column:
    """Text without mail addresses, telephone numbers, street addresses and buyers' names."""
    for pattern, by in PRIVATE_TEXT:
        if "@" in pattern:  # a look-behind and a possessive name: no start inside a name is tried again
            fast = pattern.replace("[A-Za-z0-9._%+-]+@", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@", 1)
            x = F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, fast, by)).otherwise(x)
        else:
            x = F.when(x.rlike(HINTS[by]), F.regexp_replace(x, ascii_words(pattern), by)).otherwise(x)
    return x


def scrubbed_fields(record: Column) -> Column:
    """A map without fields that hold a person, every other value scrubbed; nested records are maps of their paths."""
    return F.transform_values(F.map_filter(record, lambda k, v: ~k.rlike(PRIVATE_FIELD)), lambda k, v: scrubbed(v))


def unsafe(x: Column) -> Column:
    """Whether text still holds what ``scrubbed`` takes away."""
    return F.coalesce(~scrubbed(x).eqNullSafe(x), F.lit(False))


def asserted(record: Column) -> Column:
    """The map, or an error when it is read if it still holds private data."""
    bad = F.exists(F.map_entries(record), lambda e: e["key"].rlike(PRIVATE_FIELD) | unsafe(e["value"]))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("unsafe buyer pii")).cast("map<string,string>")).otherwise(record)


# Fixed value: the most pieces that a lot's confirmed quantity may be.
MOST_PIECES = 500


def stored_amount(x: Column) -> Column:
    """A stored amount; what is no number is null and never 0."""
    return F.nullif(F.trim(x), F.lit("")).try_cast("double")


def stored_quantity(x: Column) -> Column:
    """A stored quantity from 1 to MOST_PIECES; 1 where unknown."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_PIECES), F.coalesce(x.try_cast("int"), F.lit(1))))
