"""Column expressions on literal rows: the cases that the tables don't have."""

from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwright.functions import money as M
from lotwright.functions import text as T
from lotwright.functions import times as X
from lotwright.functions import urls as U
from lotwright.operators import coverage, keyed, match


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict(recursive=True)


def test_all_in(spark):
    cost = M.all_in(F.lit(100.0), F.lit(15.0), F.lit(8.0))
    r = one(spark, a=cost, b=M.all_in(F.lit(100.0), F.lit(15.0), F.lit(8.0), tax_on_premium=False), c=M.all_in(F.lit(-1.0), F.lit(15.0), F.lit(8.0)))
    assert abs(r["a"]["total"] - 124.2) < 1e-9 and abs(r["b"]["total"] - 123.0) < 1e-9 and r["c"]["total"] is None


def test_bands(spark):
    r = one(spark, **{f"r{i}": M.band(F.lit(x).cast("double")) for i, x in enumerate((0.49, 0.5, 0.65, 0.75, None))})
    assert list(r.values()) == ["green", "yellow", "orange", "red", "na"]


def test_verdicts(spark):
    v = lambda parts, status, nxt, cost, top, retail: M.verdict(F.lit(parts), F.lit(status), F.lit(nxt).cast("double"), F.lit(cost).cast("double"), F.lit(top).cast("double"), F.lit(retail).cast("double"))
    r = one(
        spark,
        a=v(True, "Winning", 1, 1, 1, 1), b=v(False, "Winning", 1, 9, 1, 5), c=v(False, "Winning", 1, 2, 1, 5), d=v(False, "Outbid", 5, 6, 4, 9),
        e=v(False, "Outbid", 3, 6, 4, 9), f=v(False, "", 5, 6, 4, 9), g=v(False, "", 3, 6, 4, 9), h=v(False, None, 3, 6, 4, None),
    )
    assert list(r.values()) == ["parts_only", "winning_above_retail", "hold", "let_go", "raise", "at_ceiling", "under_ceiling", "manual"]


@settings(max_examples=15, deadline=None)
@given(st.integers(-100, 10**7), st.integers(0, 30), st.integers(0, 12))
def test_max_bid_is_the_last_within_budget(spark, budget, premium, tax):
    cost = lambda h: h + int(h * premium / 100 + 0.5) + int((h + int(h * premium / 100 + 0.5)) * tax / 100 + 0.5)
    got = one(spark, m=M.max_bid_cents(F.lit(budget).cast("long"), F.lit(float(premium)), F.lit(float(tax))))["m"]
    assert got is None if budget < 0 else cost(got) <= budget < cost(got + 1)


def test_usd_and_money(spark):
    r = one(spark, a=M.usd(F.lit(1234.5)), b=M.usd(F.lit(None).cast("double")), c=M.usd(F.lit(-2.0)), d=M.money_text(F.lit("about $1,234.50 each")), e=M.money_text(F.lit("n/a")))
    assert r == {"a": "$1,234.50", "b": "--", "c": "-$2.00", "d": 1234.5, "e": None}


def test_text(spark):
    r = one(spark, a=T.squeezed(F.lit(" a  b\n")), b=T.compact_tokens(F.lit("TX-SR304 v2")), c=T.slug(F.lit("-A  b!")))
    assert r == {"a": "a b", "b": ["tx", "sr304", "v2"], "c": "a-b"}


def test_times(spark):
    r = one(spark, a=X.countdown(F.lit(90_061_000)), b=X.duration_ms(F.lit("1d 2h 3m")), c=X.duration_ms(F.lit("soon")), d=X.backoff(F.lit(9), F.lit(0)), e=X.countdown(F.lit(None).cast("long")))
    assert r == {"a": "1d 1h", "b": 93_780_000, "c": None, "d": 120_000, "e": None}


def test_fingerprint_ignores_order(spark):
    r = one(spark, a=U.fingerprint(F.lit("https://A.com/x?b=2&a=1&page=3#t"), ["page"]), b=U.fingerprint(F.lit("https://a.com/x?page=9&a=1&b=2"), ["page"]))
    assert r["a"] == r["b"] == "a.com/x?a=1&b=2"


def test_coverage_reasons(spark):
    ids = lambda rows: spark.createDataFrame(rows, "snapshot string, id long")
    a = ids([("ok", 1), ("ok", 2), ("dup", 1), ("dup", 1), ("miss", 1), ("miss", 2), ("extra", 1), ("drift", 1)])
    b = ids([("ok", 2), ("ok", 1), ("dup", 1), ("miss", 1), ("extra", 1), ("extra", 5), ("drift", 1)])
    x = spark.createDataFrame([("ok", 2, "f", "f"), ("dup", 2, "f", "f"), ("miss", 2, "f", "f"), ("extra", 1, "f", "f"), ("drift", 1, "f", "g"), ("none", None, "f", "f")], "snapshot string, total long, start string, end string")
    got = {r["snapshot"]: r["reason"] for r in coverage.audit(a, b, x).collect()}
    assert got == {"ok": None, "dup": "api-duplicate-ids", "miss": "api-missing-hydration", "extra": "api-unexpected-hydration", "drift": "route-fingerprint-changed", "none": "api-total-missing"}


def test_band_choice_takes_the_cheapest_near_the_top(spark):
    rows = spark.createDataFrame([(1, 0, 9.0, 50.0), (1, 1, 8.0, 20.0), (1, 2, 7.0, 1.0), (1, 3, 8.5, 20.0), (2, 0, 0.0, 1.0)], "k long, pos int, score double, price double")
    got = match.band_choice(rows, "k", "score", "price", ["pos"], 1.5).collect()
    assert [(r["k"], r["pos"]) for r in got] == [(1, 3)]


def test_merged_keeps_the_last_value_of_each_column(spark):
    rows = spark.createDataFrame([(1, 1, "a", 5), (1, 2, None, 6), (1, 3, "c", None)], "k long, seq long, x string, y long")
    assert keyed.merged(rows, "k", "seq").first().asDict() == {"k": 1, "x": "c", "y": 6, "seq": 3}


def test_attribute_sets(spark):
    pair = lambda a, b: match.attribute_sets({"color": F.array(*map(F.lit, a[0])), "size": F.array(*map(F.lit, a[1]))}, {"color": F.array(*map(F.lit, b[0])), "size": F.array(*map(F.lit, b[1])) if b[1] else F.array().cast("array<string>")}, ("color",))
    r = one(spark, x=pair((["red"], ["9in"]), (["red"], [])), y=pair((["red"], ["9in"]), (["blue"], ["9in"])))
    assert r["x"] == {"conflicts": [], "missing": ["size"], "matched": 2} and r["y"] == {"conflicts": ["color"], "missing": [], "matched": 1}
