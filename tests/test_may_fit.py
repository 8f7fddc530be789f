"""Cheap tests before patterns: never false where the pattern fits; listings are dealt to several tasks."""

import re

import pytest
from pyspark.sql import functions as F

from lotwright.functions import identity as I
from lotwright.functions import listing as L
from lotwright.functions import text as T
from lotwright.functions import values as V
from lotwright.plans import catalog, listings

PATTERNS = [p for group in (V.KINDS, V.FAMILIES, V.MATERIALS, V.BRANDS, V.PARTS_REASONS, V.CAUTIONS) for p in group.values()] + [p for rules in I.RULES.values() for p, _ in rules]
PATTERNS += [V.PARTS, V.GOOD, V.POSITIVE, *(p for _, p, _ in V.MIXED)]
TEXTS = [
    *(t.lower() for t in listings.TITLES), *(d.lower() for d in listings.DESCRIPTIONS), "512gb and 2 tb ram", "16 fl oz, 2 pack", "2160p 55 inch 55\" 6 ft", "iphone 13 pro max", "digital edition disc version", "core i7-9700k rtx 3080 ti rtx 4070 super",
    "2 quarts 1 qt 5l 3 litres 12 x 2 l 4 cups 100ml", "wi-fi 6e, bluetooth 5.2 bt 4", "hp wd western digital hewlett-packard", "vase flower pots kickball mega ball bouncy ball", "nintendo switch lite xbox series x ps5", "radeon rx 6800 xt ryzen 7 5800x apple m2 max", "9-in-1 3 modes 2.5 ah 60 watts 18v 24-70mm 50 mm",
    "for parts only does not work, shattered cracked as-is no returns non functional", "smart watches camcorders cameras mics microphones wooden balls", "group of 3, bundle of mixed with components",
]


def test_a_cheap_test_never_excludes_a_fit():
    fitted = 0
    for p in PATTERNS:
        literals, loose = T.needed(p), T._loose(p)
        for t in TEXTS:
            if re.search(p, t, re.I):
                fitted += 1
                assert not literals or any(x in t for x in literals), (p, t)
                assert loose is None or re.search(loose, t), (p, t)
    assert fitted > 100 and sum(bool(T.needed(p)) for p in PATTERNS) > 0.9 * len(PATTERNS)


def test_literals():
    assert T.needed(r"\b(?:playstation|ps)\s*([2-6])\b") == ("playstation", "ps")
    assert T.needed(r"\bcameras?\b|\bcamcorders?\b") == ("camcorder", "camera")
    assert T.needed(r"x*\d") == ()


def test_attributes_of_null_stay_null(spark):
    row = spark.range(1).select(F.lit(None).cast("string").alias("t")).select(*(c.alias(g) for g, c in I.attributes_of(F.col("t")).items())).first()
    assert row["voltages"] is None and row["editions"] is None and row["volumes"] is None


@pytest.mark.parametrize("source", [listings.listings, listings.documents])
def test_listings_are_several_tasks(spark, source):
    assert source(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_collapsed_leaves_single_spaces(spark):
    texts = ["a b", " a  b ", "a\tb\n\nc", "a \n b", "\t", "", "a b", "x y  z\r\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[0] == r[1] for r in rows.select(L.collapsed(F.col("t")), F.trim(F.regexp_replace("t", r"\s+", " "))).collect())


@pytest.mark.parametrize("name", ["q_lot_normalize", "q_candidate_sanitise", "q_canonical_attributes", "q_candidate_outcomes", "q_diagnostic_whitelist"])
def test_queries_over_parts_are_several_tasks(spark, name):
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_the_words_of_a_search_phrase_are_found_once(spark):
    rows = spark.createDataFrame([("Lot of 2 Sony WH-1000XM4",)], "t string").select(L.research_query(F.col("t")).alias("phrase"))
    assert rows._jdf.queryExecution().analyzed().toString().count("auction") == 1
    assert rows.first()[0] == "sony wh-1000xm4"


def test_word_boundaries_by_one_look_fit_the_same():
    edges = [V.ACCESSORY, V.MARKER, V.LATER_MARKER, V.NOT_WHOLE, *V.RETAIL, *V.CAD, r"(?i)\b(?:retail)?\b", r"\bx*\b", r"\b-a\b|\bb\b", r"\b[a-z-]+\b", r"\b(?:a|)b\b"]
    texts = [*TEXTS, "", "-a b_ é-a", "café retail: $5 msrp 7 cad", "a-b xx _x 5in 5in. für 5"]
    for p in PATTERNS + edges:
        whole = p.replace(r"\b", T.B)
        for t in texts:
            assert [m.span() for m in re.finditer(T.ascii_words(p), t, re.I | re.A)] == [m.span() for m in re.finditer(whole, t, re.I | re.A)], (p, t)
    assert sum(T.B in T.ascii_words(p) for p in PATTERNS) < 0.2 * len(PATTERNS)


@pytest.mark.parametrize("name,times", [("q_kind", 1), ("q_kind_position", 1), ("q_mixed_lot", 3), ("q_stated_retail", 1)])
def test_a_text_is_put_in_plain_signs_once(spark, name, times):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("translate(") <= times


def test_a_text_is_lower_cased_once_for_all_cautions(spark):
    rows = spark.createDataFrame([("untested, used; Cracked",)], "t string").select(L._found(F.concat("t", F.lit(" x")), V.CAUTIONS).alias("found"))
    assert rows._jdf.queryExecution().analyzed().toString().count("lower(") == 1 and rows.first()[0] == ["untested", "used"]


def test_repeated_words_of_a_title_do_not_reach_the_distinct_rows(spark):
    rows = spark.createDataFrame([(1, "a a-1x a b1", ""), (1, "a c", ""), (None, "a", ""), (2, None, "")], "id long, title string, description string")
    found = listings.q_model_shape(rows)
    assert "array_distinct" in found._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", False), (1, "a-1x", True), (1, "b1", True), (1, "c", False), (None, "a", False)], key=str)
