"""Two-level quantised search against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lotwright.llm import lexical

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(rows, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    for item, own in wanted.items():
        found = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total if total else 0
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found(spark, rows, items, k=10):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("terms", F.lit(1)).withColumn("a b, c", F.lit(1)).repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    got = lexical.search(lexical.index(docs), bench, k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


VOCABULARY = [f"w{k}" for k in range(60)] + ["Ünï", "ünï", "ABC", "x9", "中文"]


@pytest.mark.parametrize(("k", "docs", "block"), [(10, 2048, 1 << 18), (3, 2, 40)])
def test_search_equals_brute_force(spark, monkeypatch, k, docs, block):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", docs)
    monkeypatch.setattr(lexical, "ITEM_BYTES", block)
    random.seed(9)
    text = lambda n: " ".join(random.choices(VOCABULARY, [1 / (i + 1) for i in range(len(VOCABULARY))], k=n))
    rows = [(i, text(random.choice((1, 5, 40, 300)))) for i in range(-60, 140)]
    rows += [(900 + i, "w1 w2 w3 W3 abc") for i in range(40)]  # ties
    rows += [(7, "w1 w2"), (7, "w1 w2"), (None, "w5 w5 x9"), (901, None), (902, ""), (903, "... ! _ "), (904, "w7 " * 60_000)]
    items = [(i, text(random.choice((1, 4, 30)))) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w1 w1 W1"), (33, "w9"), (None, "x9 中文"), (34, "w1"), (34, "w1")]
    assert found(spark, rows, items, k) == brute(rows, items, k)


def test_few_and_no_documents(spark):
    items = [(1, "a b"), (2, "c")]
    for rows in ([(5, "a")], [(5, "a"), (4, "b a")], [(1, None)], []):
        assert found(spark, rows, items) == brute(rows, items)
    assert found(spark, [(1, "a"), (2, "b")], []) == []


def test_a_few_documents_are_rescored():
    """The bounds leave out nearly all documents that share terms with an item."""
    import numpy as np
    import pyarrow as pa

    random.seed(2)
    texts = [" ".join(random.choices(VOCABULARY, [1 / (i + 1) for i in range(len(VOCABULARY))], k=random.randint(20, 200))) for _ in range(2000)]
    items = lexical.items_of([(0, "w3 w17 w40 x9 w58")])
    data, offsets = lexical.text_bytes(pa.array(texts))
    ids, lengths, hashes, ends, docs, tf, n, total = lexical._segment(list(range(2000)), data, offsets)
    ends, lengths = np.frombuffer(ends, "<u4"), np.frombuffer(lengths, "<i8")
    docs, tf = lexical.widened(docs, int(ends[-1])), lexical.widened(tf, int(ends[-1]))
    t = lexical.saturated(tf, lexical.norms(lengths, n, total)[docs])
    impact = -(-t // lexical.UNIT)
    assert (impact * lexical.UNIT >= t).all() and ((impact - 1) * lexical.UNIT < t).all() and impact.max() <= 255
    items.weights = np.full(len(items.terms), 3000)
    one = lexical.Searcher(items, 10, n, total)
    one.add(ids, lengths, np.frombuffer(hashes, np.uint64), ends, docs, tf, impact.astype(np.uint8))
    assert len(one.best[0]) == 10 and 10 <= one.rescored < 60


def test_the_query_equals_its_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    got = lexical.op12_lexical_search(spark, data)
    assert len(rows := got.collect()) > 100
    assert sorted(tuple(r) for r in rows) == sorted(duck.execute(lexical.OP12_SQL).fetchall())
