"""The store of changes against a plain fold in order of sequence."""

import random

import pytest
from pyspark.sql import functions as F

from lotwright.operators import changelog

CHANGE, STORE = "k string, seq long, op string, a long, b string", "k string, seq long, deleted boolean, a long, b string"


def fold(changes, store=None):
    store = dict(store or {})
    for k, seq, op, a, b in sorted({c for c in changes if c[0] is not None and c[1] is not None}, key=lambda c: (c[1], c[2])):
        old = store.get(k, (None, True, None, None))
        if old[0] is not None and seq <= old[0]:
            continue
        if op == "insert":
            store[k] = (seq, False, a, b)
        elif op == "update" and not old[1]:
            store[k] = (seq, False, old[2] if a is None else a, old[3] if b is None else b)
        elif op == "delete":
            store[k] = (seq, True, None, None)
        else:
            store[k] = (seq, *old[1:])
    return store


def rows(df):
    return {r["k"]: (r["seq"], r["deleted"], r["a"], r["b"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_interleaved_changes_in_any_parts(spark, tmp_path, seed):
    own = random.Random(seed)
    changes = [(own.choice("xyzw") + str(own.randrange(5)), n, own.choice(("insert", "update", "update", "update", "delete", "other")), own.choice((None, n)), own.choice((None, f"b{n}"))) for n in range(400)]
    changes += [(None, 3, "insert", 1, "lost"), ("x1", None, "insert", 1, "lost")]
    table = lambda part: spark.createDataFrame(own.sample(part, len(part)), CHANGE)
    path = str(tmp_path / "store")
    changelog.create(path, spark.createDataFrame([("y1", -5, False, 7, "old")], STORE), "k", 4)
    for part in (changes[:150], changes[100:300], changes[:150], changes[300:], changes[300:], changes[:10]):  # parts that overlap and come again
        changelog.merge(path, table(part), "k", 4)
    want = fold(changes, {"y1": (-5, False, 7, "old")})
    assert rows(spark.read.parquet(path)) == want
    assert rows(changelog.live(path, spark).withColumn("deleted", F.lit(False))) == {k: v for k, v in want.items() if not v[1]}


def test_only_buckets_with_changes_are_replaced(spark, tmp_path):
    path = str(tmp_path / "store")
    changelog.create(path, spark.createDataFrame([(f"k{n}", 0, False, n, "") for n in range(40)], STORE), "k", 8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    changelog.merge(path, spark.createDataFrame([("k3", 1, "delete", None, None)], CHANGE), "k", 8)
    kept = [p for p in (tmp_path / "store").rglob("*.parquet") if before.get(p) == p.stat().st_mtime_ns]
    assert len({p.parent for p in before} - {p.parent for p in kept}) == 1 and changelog.live(path, spark).count() == 39
    changelog.merge(path, spark.createDataFrame([], CHANGE), "k", 8)
    assert changelog.live(path, spark).count() == 39


def test_faults(spark):
    r = spark.range(1).select(
        changelog.lot_fault(F.lit("")).alias("a"), changelog.lot_fault(F.lit("7")).alias("b"), changelog.premium_fault(F.lit("k"), F.lit(30.0)).alias("c"), changelog.premium_fault(F.lit("k"), F.lit(30.5)).alias("d"),
        changelog.premium_fault(F.lit("k"), F.lit(None).cast("double")).alias("e"), changelog.premium_fault(F.lit(None).cast("string"), F.lit(1.0)).alias("f"), changelog.premium_fault(F.lit("k"), F.lit(float("nan"))).alias("g"),
    ).first()
    assert tuple(r) == ("invalid_lot", None, None, "invalid_premium", "invalid_premium", "invalid_premium", "invalid_premium")
