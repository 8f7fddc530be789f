"""Best-fit decreasing into windows: the byte-level encoder, the plan, and packed documents against the library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lotwright.llm import byte_tokens, window_packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(5, None), (3, ""), (3, "Hello, world's 10 'S don't"), (None, "null id"), (9, "naïve Ünïcode 中文 😀 <|endoftext|>"), (7, "word " * 3000), (3, ""), (-4, "\t tab\n\n é\x85x  İΣ\xa0"), (8, "x" * 9000)]


def test_byte_encoder_equals_the_library():
    random.seed(3)
    letters = "abcXYZ  \n'.,!?-0123éÉßñ sdtll\t\r²¼µİ"
    texts = ["".join(random.choices(letters, k=200)) for _ in range(200)] + [x or "" for _, x in ODD]
    own = byte_tokens.ByteEncoder(VOCABULARY, keep=50)
    for part in (texts[:50], texts[50:], texts, [], [""]):
        got = own.encode(part)
        assert len(got) == len(part)
        for text, ids in zip(part, got):
            assert ids.tolist() == own.whole.encode(text, add_special_tokens=False).ids


def test_words_are_those_of_the_pattern():
    import regex

    word = regex.compile(byte_tokens.WORD)
    signs = "".join(c for c in map(chr, range(0x180)) if regex.fullmatch(byte_tokens.PLAIN, c))
    random.seed(12)
    texts = [*signs, "", "'", "'re", "don'tis '", *("".join(random.choices(signs + "'stvrelmd  ab\n" * 9, k=40)) for _ in range(3000)), *("".join(random.choices("''strelv \n!1", k=12)) for _ in range(20000))]
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    want = [a + m.start() for a, x in zip(bounds.tolist(), texts) for m in word.finditer(x)]
    assert byte_tokens.word_starts(chars, bounds[bounds < len(chars)]).tolist() == want


def contents(plan):
    """Window -> (offset, size) of its slices; every slice must come once."""
    seen, windows = set(), defaultdict(list)
    for group in plan.done:
        for part in group.parts:
            for k in range(group.n * part.per):
                windows[group.base + k // part.per].append((part.offset + k % part.per * part.size, part.size))
                own = {(part.length, part.rank + k, at) for at in range(part.start, part.start + part.size)}
                assert not own & seen
                seen |= own
    return seen, windows


@pytest.mark.parametrize("seed", range(60))
def test_plan_holds_everything_without_padding(seed):
    own = random.Random(seed)
    capacity = own.choice((7, 16, 64, 100))
    counts = {own.randint(1, capacity): own.randint(1, 30) for _ in range(own.randint(0, 12))}
    seen, windows = contents(window_packing.Plan(counts, capacity))
    assert seen == {(length, rank, at) for length, n in counts.items() for rank in range(n) for at in range(length)}
    for slices in windows.values():
        place = 0
        for offset, size in sorted(slices):
            assert offset == place
            place += size
        assert place == capacity or place < capacity and place & (place - 1) == 0


def test_rooms_find_the_tightest_and_the_widest():
    own, rooms, there = random.Random(5), window_packing.Rooms(100), []
    for _ in range(2000):
        if there and own.random() < 0.5:
            there.remove(room := own.choice(there))
            assert rooms.take(room).room == room
        else:
            there.append(own.randint(1, 100))
            rooms.add(window_packing.Windows(0, 1, there[-1], []))
        least = own.randint(1, 100)
        assert rooms.tightest(least) == min((x for x in there if x >= least), default=None)
        assert rooms.widest() == max(there, default=None)


def test_whole_documents_are_not_cut_where_they_fit():
    plan = window_packing.Plan({600: 5, 424: 5, 512: 2, 1024: 9})
    assert not plan.cut() and len(contents(plan)[1]) == 5 + 1 + 9


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packed_documents(spark, capacity):
    rows = ODD + [(100 + k, "some words here " * (k % 37)) for k in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("length", F.lit(1)).withColumn("a b, c", F.lit(1)).repartition(7)
    got = [r.asDict() for r in window_packing.pack(table, VOCABULARY, capacity).collect()]
    whole = byte_tokens.ByteEncoder(VOCABULARY).whole
    ids = defaultdict(list)
    for i, text in rows:
        ids[i].append(np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    assert sum(r["length"] for r in got) == sum(len(x) for own in ids.values() for x in own)
    covered = defaultdict(int)
    for r in got:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        covered[r["doc_id"], r["doc_tokens"]] += r["length"]
    for i, own in ids.items():
        for x in own:
            assert covered[i, len(x)] == len(x) * sum(len(y) == len(x) for y in own)
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in windows.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place == capacity or place < capacity and place & (place - 1) == 0
    assert len(windows) <= sum(r["length"] for r in got) // capacity + 10


def test_packing_of_an_empty_table(spark):
    assert window_packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
