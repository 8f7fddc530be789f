"""Whether what a text search returned holds the terms that were searched for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: why an export of a filtered search is refused.
REASON = "filtered-search-results-do-not-match-query"


def terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def postings(rows: DataFrame, searches: DataFrame) -> DataFrame:
    """(scope, id, term), one for each term of a search that a row of its scope holds. Rows' other terms are dropped before they are joined."""
    wanted = searches.select("scope", F.explode(terms(F.col("phrase"))).alias("term")).distinct()
    own = rows.select("scope", "id", F.explode(terms(F.col("text"))).alias("term"))
    return own.join(wanted, ["scope", "term"], "left_semi")


def unmatched(rows: DataFrame, searches: DataFrame) -> DataFrame:
    """(scope, id, missing): rows that lack terms of their scope's search, with how many.

    ``rows`` has scope, id and text, ``searches`` scope and phrase; several phrases of one scope are one search. Postings are
    counted by row, never gathered by term, so a term that all rows hold is no hot key. A search without terms has no such rows.
    """
    asked = searches.select("scope", F.explode(terms(F.col("phrase"))).alias("term")).distinct().groupBy("scope").agg(F.count("*").alias("asked"))
    held = postings(rows, searches).groupBy("scope", "id").agg(F.countDistinct("term").alias("held"))
    both = rows.select("scope", "id").distinct().join(asked, "scope").join(held, ["scope", "id"], "left")
    missing = F.col("asked") - F.coalesce("held", F.lit(0))
    return both.select("scope", "id", missing.alias("missing")).where("missing > 0")


def refusals(rows: DataFrame, searches: DataFrame) -> DataFrame:
    """(scope, rows, unmatched, reason) of every search; the reason is null where all its rows hold all its terms."""
    counted = rows.groupBy("scope").agg(F.countDistinct("id").alias("rows"))
    bad = unmatched(rows, searches).groupBy("scope").agg(F.count("*").alias("unmatched"))
    out = searches.select("scope").distinct().join(counted, "scope", "left").join(bad, "scope", "left").fillna(0, ["rows", "unmatched"])
    return out.withColumn("reason", F.when(F.col("unmatched") > 0, REASON))
