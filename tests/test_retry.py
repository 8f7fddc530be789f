"""Pages and snapshots that are read again: what is asked for, when it stops, what is taken."""

from pyspark.sql import functions as F

from lotwright.operators import retry

ANSWER = "snapshot string, attempt int, page int, total long, ids array<bigint>"


def source(spark, rows):
    """A read over rows, and what it was asked for."""
    table, asked = spark.createDataFrame(rows, ANSWER), []

    def read(wanted, attempt):
        keys = [c for c in ("snapshot", "page") if c in wanted.columns]
        asked.append((attempt, sorted(tuple(r[k] for k in keys) for r in wanted.collect())))
        return table.where(F.col("attempt") == attempt).join(wanted, keys, "left_semi")

    return read, asked


def test_expected_on_page(spark):
    got = retry.expected_on_page(spark.createDataFrame([("a", 245), ("b", 0), ("c", 100), ("d", None)], "snapshot string, total long"), 100)
    assert sorted((r["snapshot"], r["page"], r["expected"]) for r in got.collect()) == [("a", 1, 100), ("a", 2, 100), ("a", 3, 45), ("c", 1, 100)]


def test_only_short_pages_are_read_again(spark):
    rows = [("a", 1, 1, 5, [1, 2, 3]), ("a", 1, 2, 5, [4]), ("a", 2, 2, 5, [4, 5]), ("b", 1, 1, 2, [7]), ("b", 2, 1, 2, [7, None]), ("b", 3, 1, 2, [7, 8, 9]), ("c", 2, 1, 1, [1])]
    read, asked = source(spark, rows)
    pages = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("b", 1, 2), ("c", 1, 1), ("d", 1, 1)], "snapshot string, page int, expected int")
    got = {(r["snapshot"], r["page"]): (r["attempt"], r["n"], r["complete"]) for r in retry.covered_pages(read, pages).collect()}
    assert got == {("a", 1): (1, 3, True), ("a", 2): (2, 2, True), ("b", 1): (3, 3, False), ("c", 1): (2, 1, True), ("d", 1): (None, 0, False)}
    assert asked == [(1, [("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1)]), (2, [("a", 2), ("b", 1), ("c", 1), ("d", 1)]), (3, [("b", 1), ("d", 1)])]


def test_nothing_is_read_again_when_all_is_there(spark):
    read, asked = source(spark, [("a", 1, 1, 2, [1, 2])])
    pages = spark.createDataFrame([("a", 1, 2)], "snapshot string, page int, expected int")
    assert [r["complete"] for r in retry.covered_pages(read, pages).collect()] == [True] and len(asked) == 1
    assert retry.covered_pages(read, pages.limit(0)).count() == 0


def test_a_changing_snapshot_is_captured_again(spark):
    """51 lots of which 50 come, then 50 of 50; one that drifts, one that repeats ids, one that is never complete, one that never answers."""
    rows = [("shrunk", 1, 1, 51, list(range(50))), ("shrunk", 2, 1, 50, list(range(50)))]
    rows += [("drift", 1, 1, 4, [1, 2]), ("drift", 1, 2, 5, [3, 4]), ("drift", 2, 1, 4, [1, 2]), ("drift", 2, 2, 5, [3, 4]), ("drift", 3, 1, 5, [1, 2]), ("drift", 3, 2, 5, [3, 4, 5])]
    rows += [("twice", 1, 1, 2, [1, 1, 2]), ("twice", 2, 1, 2, [1, 2])] + [("never", k, 1, 9, [k]) for k in (1, 2, 3)] + [("once", 1, 1, 1, [3])]
    read, asked = source(spark, rows)
    names = spark.createDataFrame([(x,) for x in ("shrunk", "drift", "twice", "never", "once", "silent", "once")], "snapshot string")
    responses, report = retry.complete_snapshots(read, names)
    got = {r["snapshot"]: (r["attempt"], r["total"], r["reason"]) for r in report.collect()}
    assert got == {"shrunk": (2, 50, None), "drift": (3, 5, None), "twice": (2, 2, None), "never": (3, 9, "api-enumeration-count-mismatch"), "once": (1, 1, None)}
    assert [(a, len(s)) for a, s in asked] == [(1, 6), (2, 5), (3, 3)]
    assert sorted((r["snapshot"], r["page"], r["attempt"]) for r in responses.collect()) == [("drift", 1, 3), ("drift", 2, 3), ("never", 1, 3), ("once", 1, 1), ("shrunk", 1, 2), ("twice", 1, 2)]


def test_first_attempts_suffice(spark):
    read, asked = source(spark, [("a", 1, 1, 1, [3])])
    responses, report = retry.complete_snapshots(read, spark.createDataFrame([("a",)], "snapshot string"))
    assert len(asked) == 1 and responses.count() == 1 and [(r["attempt"], r["complete"]) for r in report.collect()] == [(1, True)]
