"""Identity of long texts: all of a text counts, and is read once, with the outcome of the plain expressions."""

import random
import re

from pyspark.sql import functions as F

from lotwright.functions import identity as I
from lotwright.functions import listing as L
from lotwright.functions import text as T
from lotwright.functions import values as V
from lotwright.plans import catalog

PATTERNS = [p for group in (V.KINDS, V.FAMILIES, V.MATERIALS, V.BRANDS, I.COLOR_PATTERNS) for p in group.values()] + [p for rules in I.RULES.values() for p, _ in rules] + [I.BALL]
WORDS = "thly the of and for nice x lot of 3 pair 12 x4 online auction item - | a-b ( ) [ -- +a.- é İx Σας ’s — TX-SR304 NT-USB+ AB-.1 16gb 2x16GB 20v red blackish anti glass wooden vase".split() + [
    "lot of 3", "3 pcs", "online auction lot", "av -", "rtx 4070 ti super", "ps5", "xbox series x", "bluetooth 5.0", "27 inch", "24-70mm", "6 x 12oz", "3-in-1", "iphone 15 pro max", "anti-fog spray", "soccer balls", "digital edition",
    "apple watch", "hp", "western digital", "speakers", "soundbar", "amplifier", "a/v receiver", "core i7-9700k", "disc version", "all-digital", "Brand: Sony", "Model: AB-12",
]


def titles(n=400):
    """Titles of words of all kinds, short and long, most of the long ones of few kinds."""
    deal = random.Random(3)
    few = ["the", "ouation", "équean", "inesea", "reoningen"]
    found = ["", " ", "\u0085", "a \u0085", "a  ", " a\n", "-", "|", "a | b -", "$5 ", "lot 3 - b -", "the " * 200 + "Sony", "thly " * 70 + "online auction item", "thly " * 58 + "lot of 3 x 4 pcs " + "b " * 40]
    for _ in range(n):
        rare = deal.choice([0.01, 0.03, 0.3, 1])
        words = [deal.choice(WORDS if deal.random() < rare else few) for _ in range(deal.choice([3, 12, 60, 90, 150]))]
        found.append("".join(w + deal.choice([" ", " ", " ", " ", "  ", "\n", ", ", "\u0085"]) for w in words))
    return found


def test_what_is_read_off_a_text_once_excludes_no_fit():
    fitted = 0
    for t in map(str.lower, titles()):
        for p in PATTERNS:
            if re.search(T.ascii_words(p), t, re.A):
                fitted += 1
                assert not T.numbered(p) or re.search("[0-9]", t), (p, t)
                assert not T.begins(p) or any(re.search(T.BEGIN + re.escape(x), t, re.A) for x in T.begins(p)), (p, t)
    assert fitted > 500 and all(T.numbered(p) or T.begins(p) or T.needed(p) for p in PATTERNS)
    assert T.begins(V.BRANDS["western-digital"]) == ("wd", "western") and T.begins(V.KINDS["receiver"]) == () and T.begins(r"\b(?:|a)bc\b") == ()
    assert T.numbered(r"\b(rtx|gtx)\s*(\d{3,4})\b") and not T.numbered(r"\bx\d*\b") and not T.numbered(r"\b(?:4k|oled)\b")


def test_words_begin_with_what_is_held(spark):
    rows = spark.createDataFrame([(t.lower(),) for t in titles()], "t string").select("t", T.held(F.col("t"), I.LITERALS).alias("held"))
    for t, held in rows.collect():
        assert set(held) == {x for x in I.LITERALS if re.search(T.BEGIN + re.escape(x), t, re.A)}, t


def test_ends_are_trimmed_alike(spark):
    rows = spark.createDataFrame([(t + e,) for t in titles(50) for e in ("", " ", "\t\n", " \u0085", "  ", " ")], "t string")
    assert all(a == b for a, b in rows.select(L.trimmed(F.col("t")), L.trimmed_ends(F.col("t"))).collect())


def test_phrases_of_long_titles_are_those_of_the_whole(spark):
    rows = spark.createDataFrame([(t,) for t in titles()], "t string")
    plain = rows.select("t", L.normalised(F.col("t")).alias("p")).select("t", L.research_query(F.col("t")), L._phrase(L.collapsed(F.col("p"))), F.length("p") > L.LONG, L._decides(L.collapsed(F.left("p", F.lit(L.LONG))))).collect()
    assert all(a == b for _, a, b, _, _ in plain)
    assert sum(long and begun for *_, long, begun in plain) > 20 and sum(long and not begun for *_, long, begun in plain) > 20


def test_attributes_of_a_text_read_once_are_the_same(spark):
    rows = spark.createDataFrame([(t,) for t in titles()], "t string").select(F.lower("t").alias("t"))
    rows = rows.withColumns({"n": F.when(F.col("t").rlike(r"\d"), F.col("t")).otherwise(""), "h": T.held(F.col("t"), I.LITERALS)})
    read = T.Read(F.col("t"), F.col("n"), F.col("h"), I.LITERALS)
    both = [F.struct(I.kind_of(x).alias("kind"), I.family_of(x).alias("family"), *(c.alias(g) for g, c in I.attributes_of(x).items())) for x in (F.col("t"), read)]
    found = rows.select(*both).collect()
    assert all(a == b for a, b in found) and all(any(a[g] for a, _ in found) for g in ("kind", "family", "colors", "platformVariants", "editions", "gpuModels", "voltages"))


def test_words_far_behind_count(spark):
    far = "the of " * 300 + "Sony Alpha " + "and for " * 300 + "beta, AB-12 x1 16GB the " + "one two six ten " * 100 + "XY-99 2TB"
    rows, values = I.identity_of(spark.createDataFrame([(far,)], "t string"), "t")
    row = rows.select(*(values[x].alias(x) for x in ("brand", "model", "model2", "sizes", "tokens"))).first()
    assert row["brand"] == "Sony" and row["model"] == "AB-12" and row["model2"] == "XY-99" and row["sizes"] == ["16GB", "2TB"]
    assert row["tokens"] == ["Sony", "Alpha", "beta", "AB-12", "x1", "16GB", "one", "two", "six", "ten", "one", "two"]


def test_a_name_is_put_in_plain_signs_once(spark):
    plan = catalog.queries()["q_identity_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("translate(") <= 6
