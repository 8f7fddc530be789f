"""Scans along a key in pieces against the same scans in plain Python, with pieces of few rows, null keys and values and a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from lotwright.operators import sequences, state

SCHEMA = "k long, i long, at long, flag boolean, v double"


def made(seed, n=300):
    r = random.Random(seed)
    keys = [None, 1, 2, 3]
    at = 0
    out = []
    for i in range(n):
        at += r.choice([0, 1, 1, 9])
        out.append((1 if r.random() < 0.5 else r.choice(keys), i, at, r.choice([None, True, False, False]), r.choice([None, 1.0, 2.0, 5.0, -3.0])))
    return out


def histories(rows):
    out = {}
    for row in sorted(rows, key=lambda x: x[1]):
        out.setdefault(row[0], []).append(row)
    return out.values()


def expected(rows):
    """i: (place, header, failures, fresh, settled, edge, accepted, before, burst), by walking each key's rows."""
    out = {}
    for own in histories(rows):
        header = top = was = last = None
        failures = burst = 0
        over, seen, fresh_at = False, set(), []
        for place, (_, i, at, flag, v) in enumerate(own, 1):
            header = i if flag else header
            failures = failures + 1 if flag else 0
            fresh = v not in seen
            seen.add(v)
            fresh_at.append(fresh)
            settled = place >= 3 and not any(fresh_at[-3:])
            above = v is not None and v > 1.5
            edge, over = above and not over, above
            taken = top is None or v is not None and v >= top
            top = v if top is None else max(top, v) if v is not None else top
            burst += last is not None and at - last > 5
            out[i] = (place, header, failures, fresh, settled, edge, taken, was, burst)
            was, last = flag, at
    return out


@pytest.mark.parametrize("piece", [None, 1, 7, 1000])
def test_scans_in_pieces(spark, piece):
    rows = made(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    p = None if piece is None else F.floor(F.col("i") / piece)
    k, o = ["k"], ["i"]
    got = sequences.numbered(df, k, o, "place", p)
    got = sequences.under_headers(got, k, o, F.col("flag"), F.col("i"), "header", p)
    got = sequences.failure_runs(got, k, o, F.col("flag"), piece=p)
    got = state.settled(got, k, o, "v", 3, p)
    got = state.edges(got, k, o, F.col("v") > 1.5, "edge", p)
    got = sequences.transitions(got, k, o, "flag", p)
    got = sequences.islands(got, k, ["at", "i"], F.lit(5), None if piece is None else F.floor(F.col("at") / piece))
    taken = {r["i"] for r in state.accepted(df, k, o, "v", p).collect()}
    found = {r["i"]: (r["place"], r["header"], r["failures"], r["fresh"], r["settled"], r["edge"], r["i"] in taken, r["before"], r["burst"]) for r in got.collect()}
    assert found == expected(rows)


def test_scans_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sequences.numbered(empty, ["k"], ["i"], "n", F.lit(0)).count() == 0
    assert sequences.since(empty, ["k"], ["i"], F.col("flag"), "n", F.lit(0)).count() == 0
