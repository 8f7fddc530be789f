"""Proof that a listing was read to its end, from the links that its pages show, where the stated total is another's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwright.sources.shared import written

#: Fixed value: why reading stopped, where it stopped rightly.
EXHAUSTED = "deterministic-pagination-exhausted"


def reached(pages: DataFrame) -> DataFrame:
    """(scope, page) that can be reached from the first page by going on to the nearest higher page, if that is there.

    ``pages`` has scope, page and links (page numbers; null or empty for none), a row for each. Pointers are doubled each round,
    so a listing of n pages takes log2(n) rounds, and a link back does no harm.
    """
    ahead = F.array_min(F.filter("links", lambda x: x > F.col("page")))
    there = pages.select("scope", F.col("page").alias("jump")).distinct()
    state = pages.select("scope", "page", ahead.alias("jump")).groupBy("scope", "page").agg(F.min("jump").alias("jump"))
    state = written(state.join(there, ["scope", "jump"], "left_semi").select("scope", "page", "jump"), "jumps")
    found = pages.where("page = 1").select("scope", "page").distinct()
    while not state.isEmpty():
        moved = found.join(state, ["scope", "page"]).select("scope", F.col("jump").alias("page"))
        found = written(found.union(moved).distinct(), "reached")
        state = written(state.join(state.select("scope", F.col("page").alias("jump"), F.col("jump").alias("far")), ["scope", "jump"]).select("scope", "page", F.col("far").alias("jump")), "jumps")
    return found


def exhaustion(pages: DataFrame) -> DataFrame:
    """One row per scope: last (the highest page reached), pages (reached), items (on them), missing, unlinked, broader, proven and reason.

    ``pages`` has scope, page, links, items (rows on the page) and total (as stated, or null). ``missing`` counts pages that a reached page links to, or that
    lie before the last one, and that are not there; ``unlinked`` those that are there and are not reached. A listing is
    proven if nothing is missing and no page links beyond the last one. ``broader``: the stated total is more than the
    items, as where it is that of a whole auction. Repeated rows of a page are one page; their first items count.
    """
    one = pages.groupBy("scope", "page").agg(F.flatten(F.collect_list(F.coalesce("links", F.array().cast("array<int>")))).alias("links"), F.max("items").alias("items"), F.max("total").alias("total"))  # a page's links
    own = written(one, "pages")
    got = reached(own)
    seen = own.join(got, ["scope", "page"], "left_semi")
    asked = seen.select("scope", F.explode("links").alias("page")).where("page >= 1").distinct()
    ends = seen.groupBy("scope").agg(F.max("page").alias("last"), F.count("*").alias("pages"), F.sum("items").alias("items"), F.max("total").alias("total"))
    before = ends.select("scope", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page"))
    missing = asked.union(before).distinct().join(own.select("scope", "page"), ["scope", "page"], "left_anti").groupBy("scope").agg(F.count("*").alias("missing"))
    unlinked = own.join(got, ["scope", "page"], "left_anti").groupBy("scope").agg(F.count("*").alias("unlinked"))
    rows = own.select("scope").distinct().join(ends, "scope", "left").join(missing, "scope", "left").join(unlinked, "scope", "left").fillna(0, ["pages", "items", "missing", "unlinked"])
    proven = (F.col("pages") > 0) & (F.col("missing") == 0)
    reason = F.when(proven, EXHAUSTED).when(F.col("pages") == 0, "no-first-page").otherwise("missing-page")
    return rows.select("scope", "last", "pages", "items", "missing", "unlinked", F.coalesce(F.col("total") > F.col("items"), F.lit(False)).alias("broader"), proven.alias("proven"), reason.alias("reason"))
