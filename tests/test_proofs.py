"""Photo manifests from files, listings read to their end, category trees: planted faults and their reasons."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lotwright.operators import containment, hierarchy, pager, photos, quarantine

MANIFEST = "listing string, position int, path string, sha256 string, bytes long, expected int"


def test_photos_against_their_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    content = {f"a/{k}.jpg": f"photo {k}".encode() for k in range(14)} | {"a/b/x.webp": b"w"}
    for path, raw in content.items():
        (tmp_path / path).write_bytes(raw)
    sha = lambda p: hashlib.sha256(content[p]).hexdigest()
    row = lambda listing, k, of, n, **other: (listing, k, other.get("path", of), other.get("sha", sha(of)), other.get("size", len(content[of])), n)
    rows = [row("good", k, f"a/{k}.jpg", 2) for k in (0, 1)] + [row("many", k, f"a/{k}.jpg", 14) for k in range(14)] + [row("short", 0, "a/0.jpg", 3)]
    rows += [row("hash", 0, "a/0.jpg", 1, sha="0" * 64), row("size", 0, "a/0.jpg", 1, size=99_999), row("gone", 0, "a/0.jpg", 1, path="a/none.jpg"), row("upper", 0, "a/b/x.webp", 1, sha=sha("a/b/x.webp").upper())]
    rows += [row("out", 0, "a/0.jpg", 1, path="../../a/0.jpg"), row("root", 0, "a/0.jpg", 1, path="/a/0.jpg"), row("text", 0, "a/0.jpg", 1, path="a/0.txt"), row("null", 0, "a/0.jpg", 1, path=None)]
    rows += [row("twice", k, "a/0.jpg", 2) for k in (0, 1)] + [row("late", k, f"a/{k}.jpg" if k < 10 else "a/0.jpg", 11) for k in range(11)]
    checked = photos.checked(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), MANIFEST), photos.archived(spark, str(tmp_path)))
    got = {r["listing"]: (r["reason"], r["valid"], r["uploads"], r["capped"]) for r in photos.listings(checked).collect()}
    fault = lambda why: (why, False, 0, False)
    assert got == {
        "good": (None, True, 2, False), "many": (None, True, 10, True), "short": fault("incomplete"), "hash": fault("hash"), "size": fault("bytes"), "gone": fault("missing"), "upper": (None, True, 1, False),
        "out": fault("path"), "root": fault("path"), "text": fault("path"), "null": fault("path"), "twice": fault("duplicate"), "late": fault("duplicate"),
    }
    assert sorted((r["position"], r["place"]) for r in photos.uploads(checked).where("listing = 'many'").collect()) == [(k, k + 1) for k in range(10)]


PAGE = "scope string, page int, links array<int>, items int, total long"


def test_listings_read_to_their_end(spark):
    rows = [("one", 1, None, 1, 80), ("two", 1, [2], 1, 80), ("two", 2, [], 1, 80), ("loop", 1, [2], 5, 10), ("loop", 2, [1, 2], 5, 10), ("hole", 1, [2], 5, 15), ("hole", 3, [], 5, 15), ("ahead", 1, [2, 3], 5, None), ("ahead", 2, [], 5, None)]
    rows += [("apart", 1, [], 5, 5), ("apart", 2, [], 5, 5), ("late", 2, [3], 5, 5), ("late", 3, [], 5, 5), ("leap", 1, [3], 2, 4), ("leap", 3, [2], 2, 4), ("two", 2, [], 1, 80)]
    rows += [("long", k, [k + 1] if k < 300 else [1, 299], 1, 300) for k in range(1, 301)]
    got = {r["scope"]: (r["last"], r["pages"], r["items"], r["missing"], r["unlinked"], r["broader"], r["reason"]) for r in pager.exhaustion(spark.createDataFrame(rows, PAGE)).collect()}
    done, gap = pager.EXHAUSTED, "missing-page"
    assert got == {
        "one": (1, 1, 1, 0, 0, True, done), "two": (2, 2, 2, 0, 0, True, done), "loop": (2, 2, 10, 0, 0, False, done), "hole": (1, 1, 5, 1, 1, True, gap), "ahead": (2, 2, 10, 1, 0, False, gap), "apart": (1, 1, 5, 0, 1, False, done),
        "late": (None, 0, 0, 0, 2, False, "no-first-page"), "leap": (3, 2, 4, 1, 0, False, gap), "long": (300, 300, 300, 0, 0, False, done),
    }


def brute_tree(links):
    up = {}
    for child, parent in links:
        if child is not None and parent is not None:
            up[child] = min(parent, up.get(child, parent))
    out = {}
    for node in {*up, *up.values()}:
        path = [node]
        while path[-1] in up and len(path) <= len(up) + 1:
            path.append(up[path[-1]])
        out[node] = path if len(path) <= len(up) + 1 else None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trees_with_orphans_and_cycles(spark, seed):
    own = random.Random(seed)
    links = [(f"n{own.randrange(60)}", f"n{own.randrange(60)}") for _ in range(45)] + [(f"c{k}", f"c{k + 1}") for k in range(40)] + [("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(links, "child string, parent string")
    want = brute_tree(links)
    assert {r["node"]: (r["root"], r["depth"], r["cyclic"]) for r in hierarchy.placed(df).collect()} == {n: (p[-1], len(p) - 1, False) if p else (None, None, True) for n, p in want.items()}
    assert sorted((r["node"], r["ancestor"], r["distance"]) for r in hierarchy.ancestors(df).collect()) == sorted((n, a, d) for n, p in want.items() if p for d, a in enumerate(p))


def test_rolled_up_categories(spark):
    links = spark.createDataFrame([("computers", "electronics"), ("laptops", "computers"), ("video games", "entertainment"), ("x", "y"), ("y", "x")], "child string, parent string")
    facts = spark.createDataFrame([("laptops",), ("laptops",), ("computers",), ("video games",), ("tools",), (None,), ("x",)], "k string")
    assert {r["ancestor"]: r["n"] for r in hierarchy.rolled_up(facts, links, "k").collect()} == {"laptops": 2, "computers": 3, "electronics": 3, "video games": 1, "entertainment": 1, "tools": 1, None: 1, "x": 1}
    assert hierarchy.placed(links.limit(0)).count() == 0 and hierarchy.ancestors(links.limit(0)).count() == 0


def test_rejected_rows_keep_their_reasons(spark):
    rows = [("7529", "6883", "7529", "6883"), ("7529", "9999", "7529", "6883"), ("9999", "6883", "7529", "6883"), ("7529", None, "7529", "6883"), ("", "5", None, None), (" 8 ", "5", None, None), (None, None, "1", "2")]
    df = spark.createDataFrame(rows, "account string, asset string, wa string, wi string").withColumn("a b, c", F.lit(1))
    c = F.col
    accepted, rejected = quarantine.separated(df, quarantine.identity_faults(c("account"), c("asset"), c("wa"), c("wi")))
    assert accepted.columns == df.columns and rejected.columns == [*df.columns, "reasons"]
    assert sorted(r["id"] for r in accepted.select(quarantine.composite_id(c("account"), c("asset")).alias("id")).collect()) == ["7529:6883", "8:5"]
    assert sorted((r["account"] or "-", r["asset"] or "-", r["reasons"]) for r in rejected.collect()) == [
        ("-", "-", ["asset-identity-missing"]), ("-", "5", ["asset-identity-missing"]), ("7529", "-", ["asset-identity-missing"]), ("7529", "9999", ["asset-identity-mismatch"]), ("9999", "6883", ["asset-identity-mismatch"]),
    ]


def test_fingerprints_ignore_page_and_session_only(spark):
    first = '{"page":1,"sessionId":"a","displayRows":24,"zipcode":"07008","proximityWithinDistance":"50","searchText":"*","accountIds":[]}'
    bodies = [first, '{"accountIds":[], "searchText":"*","zipcode":"07008","proximityWithinDistance":"50","displayRows":24,"SessionID":"other","page":19}']
    bodies += [first.replace('"50"', '"25"'), first.replace('"*"', '"laptop"'), first.replace("[]", "[7529]"), "[1]", "broken", None]
    got = [r["f"] for r in spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, b string").select("k", quarantine.request_fingerprint(F.col("b")).alias("f")).orderBy("k").collect()]
    assert got[0] == got[1] and len({*got[1:5]}) == 4 and None not in got[:5] and got[5:] == [None, None, None]


def test_searches_whose_results_lack_their_terms(spark):
    rows = [("toys", 1, "LeBron James Jersey"), ("toys", 2, "Kids Toy"), ("all", 1, "Red wool, RED!"), ("all", 2, "wool red"), ("none", 5, None), ("all", 2, "wool red"), ("blank", 1, "x"), ("other", 1, "x"), (None, 1, "x")]
    table = spark.createDataFrame(rows, "scope string, id long, text string").withColumn("term", F.lit("x"))
    searches = spark.createDataFrame([("toys", "lebron"), ("all", "Red"), ("all", "wool red"), ("none", "thing two"), ("blank", " ... "), ("empty", "word"), ("toys", None)], "scope string, phrase string")
    assert sorted((r["scope"], r["id"], r["missing"]) for r in containment.unmatched(table, searches).collect()) == [("none", 5, 2), ("toys", 2, 1)]
    got = {r["scope"]: (r["rows"], r["unmatched"], r["reason"]) for r in containment.refusals(table, searches).collect()}
    assert got == {"toys": (2, 1, containment.REASON), "all": (2, 0, None), "none": (1, 1, containment.REASON), "blank": (1, 0, None), "empty": (0, 0, None)}
