"""The prefix trie against plain recursion over all beginnings."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lotwright.llm import conversation_trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {c: tuple(own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + own[c][h:]) for c in own}
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == p))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def found(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("owner", F.lit(1)).withColumn("a b, c", F.lit(1))
    out = conversation_trie.trie(table)
    assert out.columns == NAMES and {t for n, t in out.dtypes if n != "ends_sha256"} == {"bigint"}
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("seed", "conversations", "turns", "ids"), [(1, 80, 6, 4096), (2, 200, 3, 7), (3, 12, 40, 4096)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, conversations, turns, ids):
    monkeypatch.setattr(conversation_trie, "IDS", ids)
    own = random.Random(seed)
    rows = [(c, t, own.choice(("u", "a")), own.choice(("x", "x", "y z", "long  text\tof words"))) for c in range(conversations) if c % 20 or own.random() < 0.7 for t in range(own.randint(1, turns))]
    own.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None, None, None), (5, 0, "u", None), (5, None, "u", "q"), (7, 3, "u", "same"), (7, 3, "u", "same"), (7, 3, "a", "tie"), (None, 0, "u", "lost"), (40, 0, "u", "x" * 200_000), (41, 0, "u", "a b"), (41, 1, "u", "a b")]
    rows += [(c, 0, "u", "w") for c in range(100, 104)]  # turnless where h is over 0 and 100's turn is the only one
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == Counter()
    assert found(spark, [(21, 0, "u", "only")]) == brute([(21, 0, "u", "only")])


def test_many_copies_and_long_conversations(spark, monkeypatch):
    """A third of all are the same, and pieces of a conversation are carried on."""
    from lotwright.operators import sequences

    monkeypatch.setattr(sequences, "BLOCK", 16)
    monkeypatch.setattr(conversation_trie, "IDS", 10)
    rows = [(c, t, "u", f"t{t}") for c in range(0, 900, 20) for t in range(3)] + [(3, t, "u", f"m{t // 7} w") for t in range(150)] + [(4, t, "u", f"m{t // 7} w" if t < 120 else "other") for t in range(140)]
    assert found(spark, rows) == brute(rows)


def test_the_query_equals_its_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    got = duck.execute(conversation_trie.OP13_SQL)
    assert [d[0] for d in got.description] == NAMES
    assert Counter(tuple(r) for r in conversation_trie.op13_conversation_trie(spark, data).collect()) == Counter(got.fetchall())
