"""Lookups of retail prices: what may be asked, what answers count, which candidates take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import GROUPS, attributes_of, kind_of
from .listing import normalised
from .lots import words
from .money import finite

# Limits of requests and answers.
BODY_BYTES, REQUEST_BYTES, PAGE_SIZE = 5_000_000, 180_000, 100
CANDIDATES, TITLE, MATCH_TEXT, QUERY = 30, 500, 800, 180
CHALLENGE = r"(?i)(?:enter the characters you see below|sorry, we just need to make sure|robot check|captcha)"


def eligible(currency: Column, mixed: Column, needs_quantity: Column, query: Column) -> Column:
    """Whether a lot's price is looked up: not in Canadian dollars, not mixed, no open quantity, with a search phrase."""
    return (currency != "CAD") & ~mixed & ~needs_quantity & (F.coalesce(query, F.lit("")) != "")


def takes_part(offer: Column, stated_retail: Column) -> Column:
    """Whether a candidate (price, used, sponsored) is scored: organic, new, priced at three tenths of the stated retail price or more."""
    floor = F.when(finite(stated_retail) & (stated_retail > 0), stated_retail * 0.3).otherwise(0.0)
    return ~F.coalesce(offer["sponsored"], F.lit(False)) & ~F.coalesce(offer["used"], F.lit(False)) & F.coalesce(offer["price"] >= floor, F.lit(False))


def sanitised(offers: Column) -> Column:
    """The usable ones of the first CANDIDATES offers (key, title, match_text, price, used, sponsored): keys of ten signs, cut texts, prices above 0 or none."""

    def cut(o: Column) -> Column:
        return F.struct(F.left(words(o["title"]), F.lit(TITLE)).alias("title"), F.nullif(o["match_text"], F.lit("")).alias("match_text"), o["key"].alias("key"), o["price"].alias("price"), o["used"].alias("used"), o["sponsored"].alias("sponsored"))

    def clean(o: Column) -> Column:  # a title is read once; in one line already, as a match text it only loses what a cut left at its end
        text = F.left(F.when(o["match_text"].isNull(), F.trim(o["title"])).otherwise(words(o["match_text"])), F.lit(MATCH_TEXT))
        return F.struct(F.upper(F.coalesce(o["key"], F.lit(""))).alias("key"), o["title"].alias("title"), text.alias("match_text"), o["price"].alias("price"), F.coalesce(o["used"], F.lit(False)).alias("used"), F.coalesce(o["sponsored"], F.lit(False)).alias("sponsored"))

    usable = lambda o: o["key"].rlike("^[A-Z0-9]{10}$") & (o["title"] != "") & (o["price"].isNull() | (finite(o["price"]) & (o["price"] > 0)))
    return F.filter(F.transform(F.transform(F.slice(offers, 1, CANDIDATES), cut), clean), usable)


def revalidated(rows: DataFrame, identity: str, out: str = "checked") -> DataFrame:
    """rows with an identity that came from elsewhere, cut to its limits; kind and attributes are read from its name again.

    Null if its search phrase has fewer than two signs.
    """
    i = F.col(identity)
    cut = lambda x, n: F.left(words(x), F.lit(n))
    some = lambda x, n: F.when(F.coalesce(x, F.lit("")) != "", cut(x, n))
    listed = lambda x, most, n: F.transform(F.slice(F.coalesce(x, F.array().cast("array<string>")), 1, most), lambda t: cut(t, n))
    rows = rows.withColumns({"_r_name": cut(i["name"], 300), "_r_query": cut(i["query"], QUERY), "_r_whole": F.lower(normalised(i["name"]))})  # each is read many times
    rows = rows.withColumn("_r_text", F.lower(normalised(F.col("_r_name"))))
    rows = rows.withColumns({f"_r_{g}": c for g, c in attributes_of(F.col("_r_text")).items()})
    certain = (F.coalesce(i["model"], F.lit("")) != "") | (F.size("_r_gpuModels") > 0) | (F.size("_r_cpuModels") > 0)
    found = {g: F.col(f"_r_{g}") for g in GROUPS} | {"seriesSignatures": F.when(certain, F.array().cast("array<string>")).otherwise(F.col("_r_seriesSignatures"))}
    retail = F.when(finite(i["stated_retail"]) & (i["stated_retail"] > 0), i["stated_retail"])
    checked = F.struct(
        F.col("_r_name").alias("name"), F.col("_r_query").alias("query"), cut(i["brand"], 80).alias("brand"), some(i["model"], 60).alias("model"), some(i["model2"], 60).alias("model2"), kind_of(F.col("_r_whole")).alias("kind"),
        listed(i["sizes"], 8, 30).alias("sizes"), listed(i["tokens"], 20, 40).alias("tokens"), retail.alias("stated_retail"), *(found[g].alias(g) for g in GROUPS),
    )
    rows = rows.withColumn(out, F.when(F.length("_r_query") >= 2, checked))
    return rows.drop("_r_name", "_r_query", "_r_whole", "_r_text", *(f"_r_{g}" for g in GROUPS))


def is_challenge(html: Column) -> Column:
    return F.coalesce(html.rlike(CHALLENGE), F.lit(False))


def reusable(status: Column) -> Column:
    return F.coalesce(status.isin("ok", "no_results"), F.lit(False))


def admitted(content_type: Column, body: Column) -> Column:
    """Why an answer is not read (null if it is): not a page, too large, or a challenge instead of results."""
    return F.when(~F.coalesce(content_type.rlike("(?i)text/html|application/xhtml\\+xml"), F.lit(False)), "non-html").when(F.octet_length(body) > BODY_BYTES, "too-large").when(is_challenge(body), "challenge")


def request_fault(page: Column, size: Column, ids: Column, body: Column) -> Column:
    """Why a request is not sent (null if it is): page under 1, size outside 1 to PAGE_SIZE, too many or null ids, or too many bytes. Null ids read none."""
    bad_ids = ids.isNotNull() & ((F.size(ids) > PAGE_SIZE) | F.exists(ids, lambda x: x.isNull()))
    return (
        F.when(~F.coalesce(page >= 1, F.lit(False)), "page")
        .when(~F.coalesce(size.between(1, PAGE_SIZE), F.lit(False)), "size")
        .when(F.coalesce(bad_ids, F.lit(False)), "ids")
        .when(F.octet_length(body) > REQUEST_BYTES, "bytes")
    )


# Phases of a capture job, and those that each may be followed by; every phase may also be stopped, fail or go stale.
PHASES = {
    "idle": ["queued"], "queued": ["enumerating", "hydrating"], "enumerating": ["enumerating", "hydrating", "validating"], "hydrating": ["hydrating", "validating"], "validating": ["completed"],
    "stopping": ["stopped"], "completed": [], "stopped": [], "failed": [], "stale": [],
}
ENDS = ["completed", "stopped", "failed", "stale"]


def may_follow(before: Column, phase: Column) -> Column:
    """Whether a job's phase may follow the one before (null: none): ended jobs start again as queued."""
    onward = F.coalesce(*(F.when(before == k, F.lit(False) if not after else phase.isin(*after)) for k, after in PHASES.items()), F.lit(False))
    breaks = ~before.isin(*ENDS) & phase.isin("stopping", "stopped", "failed", "stale")
    return F.when(before.isNull(), phase.isin("idle", "queued")).when(before.isin(*ENDS), phase == "queued").otherwise(onward | breaks)
