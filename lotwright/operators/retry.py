"""Captures that are read again until they are right: short pages one by one, whole snapshots until their audit passes.

A response is one row: snapshot, page, attempt, total (as stated) and ids. ``read(wanted, attempt)`` gives the responses of that
attempt for the rows of ``wanted``; it is asked only for what the attempt before left open, so a source that is
partitioned by attempt and page reads just these. Every attempt is written before it is judged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwright.sources.shared import written

from . import coverage

Read = Callable[[DataFrame, int], DataFrame]
#: Fixed value: attempts at a page or a snapshot.
ATTEMPTS = 3


def rounds(wanted: DataFrame, read: Read, unfinished: Callable[[DataFrame, DataFrame], DataFrame], attempts: int = ATTEMPTS) -> DataFrame:
    """The rows of each key's first attempt that ``unfinished(got, wanted)`` doesn't name again, or of its last attempt.

    The columns of ``wanted`` are the key. Stops as soon as nothing is left.
    """
    keys, done = wanted.columns, []
    for attempt in range(1, attempts + 1):
        got = written(read(wanted, attempt), f"attempt-{attempt}")
        left = None if attempt == attempts else written(unfinished(got, wanted).select(keys), f"open-{attempt}")
        if left is None or left.isEmpty():
            done.append(got)
            break
        done.append(got.join(left, keys, "left_anti"))
        wanted = left
    return reduce(DataFrame.unionByName, done)


def expected_on_page(total: DataFrame, size: int) -> DataFrame:
    """snapshot, page (from 1) and expected: full pages, and what is left on the last one. ``total`` has snapshot and total."""
    pages = total.where("total > 0").select("snapshot", "total", F.explode(F.sequence(F.lit(1), F.ceil(F.col("total") / size).cast("int"))).alias("page"))
    return pages.select("snapshot", "page", F.least(F.lit(size), F.col("total") - (F.col("page") - 1) * size).cast("int").alias("expected"))


def covered_pages(read: Read, pages: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """One row for each row of ``pages`` (snapshot, page, expected): attempt, n (ids returned), ids, complete.

    A page is read again while it has another number of ids than expected; the last response counts. A page without any
    response has a null attempt, no ids and is not complete. Null ids do not count.
    """

    def short(got: DataFrame, wanted: DataFrame) -> DataFrame:
        counted = got.select("snapshot", "page", F.size(F.array_compact("ids")).alias("n"))
        return wanted.join(counted, ["snapshot", "page"], "left").where(~F.col("n").eqNullSafe(F.col("expected"))).select("snapshot", "page", "expected")

    own = lambda wanted, attempt: wanted.join(read(wanted, attempt).select("snapshot", "page", F.array_compact("ids").alias("ids"), F.lit(attempt).alias("attempt")), ["snapshot", "page"], "left")
    rows = rounds(pages.select("snapshot", "page", "expected"), own, short, attempts)
    n = F.coalesce(F.size("ids"), F.lit(0))
    return rows.select("snapshot", "page", "expected", "attempt", n.alias("n"), "ids", (n == F.col("expected")).alias("complete"))


def audited(responses: DataFrame) -> DataFrame:
    """coverage.audit of responses (snapshot, page, total, ids): expected is the first page's total, other totals are drift."""
    ids = responses.select("snapshot", F.explode("ids").alias("id"))
    first = responses.groupBy("snapshot").agg(F.min_by("total", "page").alias("total"))
    drift = responses.join(first.withColumnRenamed("total", "stated"), "snapshot").groupBy("snapshot").agg(F.count_if(F.col("total") != F.col("stated")).alias("drifted"))
    expected = first.join(drift, "snapshot").select("snapshot", "total", F.lit("").alias("start"), F.lit("").alias("end"), "drifted")
    return coverage.audit(ids, ids.distinct(), expected)


def complete_snapshots(read: Read, snapshots: DataFrame, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(responses of the first attempt whose audit passes, or of the last one; snapshot, attempt and the audit's columns).

    ``snapshots`` has snapshot. A snapshot without any response has no audit and is read again.
    """
    reports: list[DataFrame] = []

    def open_(got: DataFrame, wanted: DataFrame) -> DataFrame:
        reports.append(written(audited(got).withColumn("attempt", F.lit(len(reports) + 1)), "audit"))
        return wanted.join(reports[-1].where("complete"), "snapshot", "left_anti")

    own = lambda wanted, attempt: read(wanted, attempt).withColumn("attempt", F.lit(attempt))
    rows = rounds(snapshots.select("snapshot").distinct(), own, open_, attempts)
    last = rows.where(F.col("attempt") == len(reports) + 1)  # is taken as it is; none if all were complete before
    reports.append(audited(last).withColumn("attempt", F.lit(len(reports) + 1)))
    report = reduce(DataFrame.unionByName, reports)
    taken = rows.select("snapshot", "attempt").distinct()
    return rows, report.join(taken, ["snapshot", "attempt"])
