"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import page_maker

from lotwright.llm import chat, common, decontaminate, embeddings, graph, html_content, html_layouts, language_id, minhash, packing, quality, token_files, tokens, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, score string, _text string, row int"


def docs(spark, rows):
    """rows: (doc_id, text[, lang]); further columns have names that the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), "h", "s", "t", 1) for r in rows], DOCS).withColumn("a b, c", F.struct(F.lit(1).alias("x y")))


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def low(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# ---- shared helpers


def test_words_equal_a_pattern():
    texts = ["", "A b\tc", None, "  x ", "ß Ünï-x 10", "\n", "one"]
    for inside, pattern in ((minhash.INSIDE, r"[^\x20\x09-\x0D]+"), (decontaminate.INSIDE, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, offsets = common.text_bytes(pa.array(texts))
        hashes, starts, ends, at = common.words(data, offsets, inside, common.LOWER)
        got = [[low(bytes(data[starts[k] : ends[k]]).decode()) for k in range(a, b)] for a, b in zip(at, at[1:])]
        assert got == [re.findall(pattern, low(t or "")) for t in texts]
        again = common.words(*common.text_bytes(pa.array(["c b a"])), inside, common.LOWER)[0]
        assert again[0] == hashes[2] and again[2] == hashes[0]


def test_components(spark):
    random.seed(4)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, k) for k in range(4000, 4100)] + [(7, 7), (None, 3)]
    got = {r["vertex"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for x in sorted(near):
        if x in seen:
            continue
        todo, group = [x], set()
        while todo:
            y = todo.pop()
            if y not in group:
                group.add(y)
                todo += near[y]
        seen |= group
        want |= dict.fromkeys(group, min(group))
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 language ID


def test_language_id(spark):
    random.seed(1)
    alphabets = {"aa": "abcd efgh ", "zz": "wxyz uvst "}
    rows = [(i, "".join(random.choices(alphabets[k], k=random.choice((20, 200, 900)))), k) for i, k in enumerate(["aa", "zz"] * 60)]
    rows += [(900, None, "aa"), (901, "", "zz"), (902, "123 ### !!", "aa"), (None, "abcd abcd efgh", None), (903, "wxyz " * 30_000, None), (3, rows[3][1], "zz")]
    net = language_id.fit(docs(spark, rows))
    got = {(r["doc_id"], r["text"]): r for r in dicts(language_id.predict(docs(spark, rows), net, ["doc_id", "text"]))}
    for i, text, lang in rows:
        r = got[i, text]
        assert 0 <= r["score"] <= 1
        if text and re.search("[a-z]", text):
            assert r["lang_pred"] == ("aa" if set(text) & set("abcdefgh") else "zz")
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    kept = language_id.stage(spark, docs(spark, rows), "")
    assert kept.columns == docs(spark, []).columns and kept.count() == len(rows) - 3


def test_language_id_without_labels(spark):
    assert language_id.fit(docs(spark, [(1, "abc"), (2, None)])) is None
    assert [r["lang_pred"] for r in dicts(language_id.predict(docs(spark, [(1, "abc")]), None, ["doc_id"]))] == ["und"]
    assert language_id.predict(docs(spark, []), None, ["doc_id"]).count() == 0


def test_windows_cover_every_byte():
    data, offsets = common.text_bytes(pa.array(["", "x" * 300, "ab"]))
    padded, number = language_id.windows_of(data, offsets, 128)
    assert number.tolist() == [1, 3, 1] and (padded != 0).sum() == 302


# ---- 2 decontamination


def brute_hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, item in items:
            own = words(item)
            n = min(10, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in windows and i is not None:
                    hit |= set(range(k, k + n))
                    found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "PATTERN_BYTES", block)
    random.seed(2)
    vocabulary = ["ab", "cd", "éf", "10", "gh"]
    phrase = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(i, phrase(random.choice((3, 9, 10, 14, 30)))) for i in range(12)] + [(2, phrase(12)), (None, phrase(11)), (50, None), (51, "..."), (52, "zz")]
    texts = [phrase(60), None, "", "!!", phrase(400), items[4][1].upper().replace(" ", " - "), "x " + items[6][1] + ", y", "zz", "ab " * 9000, *[phrase(k) for k in range(1, 14)]]
    got = dicts(decontaminate.search(docs(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]))
    got = [tuple(r[k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in sorted(got, key=lambda r: r["doc_id"])]
    assert got == brute_hits(texts, items)


def test_decontamination_by_items_without_id(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    table = docs(spark, [(1, "a " + item), (2, "clean text"), (3, "zz " + item + " named item")])
    spark.createDataFrame([(None, item), (7, "named item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in dicts(decontaminate.op2_decontamination(spark, str(tmp_path))))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == [(1, 11, 0, sha(""), True), (2, 0, 0, sha(""), False), (3, 13, 1, sha("7"), True)]
    assert [r["doc_id"] for r in dicts(decontaminate.stage(spark, table, str(tmp_path)))] == [2]


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in dicts(decontaminate.search(docs(spark, [(1, "a b")]), none, ["doc_id"]))] == [0]
    assert decontaminate.search(docs(spark, []), none, ["doc_id"]).count() == 0


# ---- 3 packing, 4 token files


ODD = [(5, None), (3, ""), (3, "Hello, world's 10 'S don't"), (None, "null id"), (9, "naïve Ünïcode 中文 😀 <|endoftext|>"), (7, "word " * 5000), (3, ""), (-4, "\t tab\n\n é\x85x  İΣ")]


def token_lists(rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for _, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    random.seed(3)
    letters = "abcXYZ  \n'.,!?-0123éÉßñ sdtll"
    texts = ["".join(random.choices(letters, k=200)) for _ in range(100)] + [x or "" for _, x in ODD]
    own = tokens.Encoder(packing.vocabulary_path(), keep=50)
    for part in (texts[:50], texts[50:], texts):
        for text, raw in zip(part, own.encode(part)):
            assert np.frombuffer(raw, "<u4").tolist() == own.whole.encode(text, add_special_tokens=False).ids


def test_words_are_those_of_the_vocabulary():
    import regex

    word = regex.compile(tokens.WORD)
    signs = "".join(c for c in map(chr, range(0x180)) if regex.fullmatch(tokens.PLAIN, c)).lower()
    random.seed(12)
    texts = [*signs, "", "'", "'re", "don'tis '", *("".join(random.choices(signs + "'stvrelmd  ab" * 9, k=40)) for _ in range(2000)), *("".join(random.choices("''strelv \n!1", k=12)) for _ in range(20000))]
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    want = [a + m.start() for a, x in zip(bounds.tolist(), texts) for m in word.finditer(x)]
    assert np.flatnonzero(tokens.word_starts(chars, bounds[bounds < len(chars)])).tolist() == want
    own, texts = tokens.Encoder(packing.vocabulary_path(), keep=2000), random.sample(texts, 3000)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in own.whole.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark):
    rows = ODD + [(100 + k, "some words here " * (k % 37)) for k in range(120)]
    got = dicts(packing.pack(docs(spark, rows), packing.vocabulary_path(), capacity=64))
    want = sorted((i if i is not None else -99, p, 64 * p, len(c), crc(c)) for (i, _), ids in zip(rows, token_lists(rows, 0)) for p, c in enumerate(ids[k : k + 64] for k in range(0, len(ids), 64)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack(docs(spark, []), packing.vocabulary_path()).count() == 0


def test_crossover_and_mutation_keep_all_pieces():
    random_ = np.random.default_rng(0)
    counts = {int(x): int(random_.integers(1, 9)) for x in random_.integers(1, 65, 40)}
    total = lambda bins: {x: sum(n * k.count(x) for k, n in bins.items()) for x in counts}
    a, b = packing.best_fit(counts, 64), packing.start(counts, 64, random_)
    for _ in range(30):
        a, b = packing.crossed(a, b, counts, 64, random_), packing.mutated(b, 64, random_)
        for bins in (a, b):
            assert total(bins) == counts and all(sum(k) <= 64 for k in bins)


def test_islands_evolve_from_random_starts(spark):
    """Crossover and migration, not the greedy individual, close the gap to the lower bound."""
    random_ = np.random.default_rng(2)
    counts = {int(x): int(n) for x, n in zip(range(1, 2049), 3000 / np.arange(1, 2049) ** 0.7 * random_.uniform(0, 2, 2048)) if int(n)}
    starts = [packing.fitness(packing.start(counts, 2048, random_), 2048)[0] for _ in range(6)]
    found = packing.packed(spark, counts, rounds=3, generations=6)
    total = {x: sum(n * k.count(x) for k, n in found.bins.items()) for x in counts}
    assert total == counts and all(sum(k) <= 2048 for k in found.bins)
    assert found.generations > 0 and found.least <= found.rounds[-1] <= packing.fitness(packing.best_fit(counts, 2048), 2048)[0] and found.rounds[0] < min(starts)


def test_migration_loses_nothing(spark):
    """With elites moving on, later rounds are at least as good as the first one without."""
    counts = {40: 40, 30: 40, 25: 60, 13: 30, 7: 20}
    alone = packing.packed(spark, counts, capacity=64, islands=3, rounds=3, generations=1, size=2, elites=0)
    moved = packing.packed(spark, counts, capacity=64, islands=3, rounds=3, generations=1, size=2, elites=2)
    assert moved.rounds[-1] <= alone.rounds[0] and moved.least <= moved.rounds[-1]


def test_token_files(spark):
    got = dicts(token_files.round_trip(docs(spark, ODD * 3), packing.vocabulary_path()))
    rows = ODD * 3
    want = sorted(((i is not None, i or 0), len(ids), crc(ids)) for (i, _), ids in zip(rows, token_lists(rows, 1)))
    got.sort(key=lambda r: r["start"])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys) and sorted((k, r["n_tokens"], r["ids_crc32"]) for k, r in zip(keys, got)) == want
    place = 0
    for r in got:
        assert r["start"] == place
        place += r["n_tokens"]
    assert token_files.round_trip(docs(spark, []), packing.vocabulary_path()).count() == 0


def test_token_files_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 300)
    rows = [(k * 3 - 50, "some words " * (k % 9)) for k in range(60)]
    got = sorted(dicts(token_files.round_trip(docs(spark, rows), packing.vocabulary_path())), key=lambda r: r["start"])
    want = [(i, len(ids), crc(ids)) for (i, _), ids in zip(rows, token_lists(rows, 1))]
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    assert [r["start"] for r in got] == [sum(n for _, n, _ in want[:k]) for k in range(60)]


@pytest.mark.parametrize("n,bound", [(70_000, 2**40), (0, 1), (1, 1), (1, 10**15), (5000, 6000), (5000, 10**12), (700, 700)])
def test_elias_fano(n, bound):
    random_ = np.random.default_rng(n)
    values = np.sort(random_.integers(0, bound, n)).astype(np.uint64)
    ef = token_files.EliasFano.read(token_files.EliasFano.of(values).raw())
    assert ef.select(0, n).tolist() == values.tolist()
    for _ in range(20):
        i, j = sorted(random_.integers(0, n + 1, 2).tolist())
        assert ef.select(i, j).tolist() == values[i:j].tolist()
    if n > 1000:
        assert len(ef.raw()) * 8 < n * (3 + np.log2(bound / n)) + 64 * n / token_files.SAMPLE + 1000


# ---- 5 HTML extraction


WEIGHTS = html_content.train(html_layouts.pages())


def main_text(page):
    return html_content.main_text(page, WEIGHTS)


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><main><article><header><h1>The &amp; title</h1></header><p>First   paragraph of the <b>story</b>.<br>More.<script>var x = "<p>no</p>";</script></p>
    <aside>Related links</aside><div class="ad">Buy now, a very long and convincing sentence of an advert.</div><p>Second &eacute;&#233; paragraph, with enough words to be prose.</p><form><input value=x>Sign up</form>
    <section id="comments"><p>A reader comment that goes on for a while, too.</p></section></article></main><div class="sidebar"><p>Popular posts of the week are here.</p></div><footer>&copy; 2024</footer>"""
    assert main_text(page) == "The & title First paragraph of the story . More. Second éé paragraph, with enough words to be prose.".replace("story .", "story.")
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "Long text here. " * 50_000 + "</p>"), (5, "u", "<!-- open"), (6, "u", "<nav><a>x</a>"), (None, "u", "a < b and <b unclosed")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = dicts(html_content.extracted(df.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1)).withColumn("_html", F.lit("x"))))
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[2] == by[3] == by[5] == by[6] == "" and len(by[4]) == 800_000 - 1
    assert html_content.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PROSE = "The first paragraph of the article, with enough words to be prose."


@pytest.mark.parametrize("name", ["button", "select", "svg", "video", "audio", "canvas", "object"])
def test_html_without_an_end_tag(name):
    for rest in ("", "<button>ok</button><select><option>x</select>"):
        assert main_text(f"<main><p>{PROSE}</p><{name}>x<p>{PROSE}</p></main>{rest}") == f"{PROSE} {PROSE}"


def test_html_with_an_open_head():
    assert main_text(f"<html><head><title>No</title><meta charset=utf-8><p>{PROSE}</p>") == PROSE
    assert main_text(f"<main><p>{PROSE}</p></main><script>no <p>{PROSE}</p>") == PROSE


@pytest.mark.parametrize("wrap", ["<div class='content-sidebar-wrap'>", "<div id='content has-sidebar'>", "<form>", "<div class='post comments-open'>", "<article class='post comments-open'>"])
def test_html_inside_a_wrapper(wrap):
    away = "<div class=sidebar><p>Popular posts are here.</p></div><section id=comments><p>A comment by a reader.</p></section>"
    assert main_text(f"<body>{wrap}<p>{PROSE}</p><p>{PROSE}</p>{away}") == f"{PROSE} {PROSE}"
    assert main_text(f"<body>{wrap}<main><p>{PROSE}</p></main>{away}") == PROSE
    assert main_text(f"<main>{wrap}<p>{PROSE}</p><p>{PROSE}</p>{away}</main>") == f"{PROSE} {PROSE}"


@pytest.mark.parametrize(
    "page,want",
    [
        ('<ul><li class="comment"><p>A long comment by a reader, it is.</p></li></ul>', ""),
        (f'<main><p>{PROSE}</p></main><ul><li class="comment"><p>A comment by a reader, it is.</p></li></ul>', PROSE),
        (f'<table><tr><td class="sidebar"><p>Popular posts of the week are here.</p><td><p>{PROSE}</table>', PROSE),
        (f'<article class="post side-by-side"><p>{PROSE}</p></article>', PROSE),
        ("<body>Hello world</body>", "Hello world"),
    ],
)
def test_html_of_plain_pages(page, want):
    assert main_text(page) == want


def block_labels(pages):
    """F1 of the blocks, the share whose label the cut changes, and the share that is right by the cut and by the sign of the score."""
    hits = found = wanted = changed = cut = sign = total = 0
    for source, says in pages:
        blocks, scores, content = html_content.labelled(source, WEIGHTS)
        for b, score, inside in zip(blocks, scores, content):
            if b.text in says:
                want = says[b.text]
                hits, found, wanted, total = hits + (inside and want), found + inside, wanted + want, total + 1
                changed, cut, sign = changed + ((score > 0) != inside), cut + (inside == want), sign + ((score > 0) == want)
    return 2 * hits / (found + wanted), changed / total, cut / total, sign / total


def test_html_on_other_generated_pages():
    """Held-out layouts, half of them with random, missing or misleading names."""
    f1, changed, _, _ = block_labels(html_layouts.pages(10_000, 300))
    assert f1 > 0.955 and changed > 0.01


def test_html_on_pages_made_apart():
    """Another generator, names in four languages or none: the cut decides some blocks, and better than scores alone."""
    f1, changed, cut, sign = block_labels(page_maker.pages(0, 400))
    assert f1 >= 0.97 and changed > 0.01 and cut > sign


FIRST_TEXT, MORE_TEXT = "The first paragraph of the article, with enough words to be prose.", "A second paragraph follows it, and it has some more words in it."


@pytest.mark.parametrize("mark", ['class="post social"', 'class="menu"', 'class="legal"', 'id="related"', 'class="post type-post tag-social category-news"', 'class="search"', 'class="promo widget"'])
def test_names_do_not_remove_articles(mark):
    story = f"<h1>A title</h1><p>{FIRST_TEXT}</p><p>{MORE_TEXT}</p>"
    away = "<nav><a href=/>Home</a></nav>"
    for page in (f"{away}<article {mark}>{story}</article><footer>(c)</footer>", f"<main><article {mark}>{story}</article></main>", f"{away}<div {mark}>{story}</div>", f"<main><div {mark}>{story}</div></main>"):
        assert main_text(page) == f"A title {FIRST_TEXT} {MORE_TEXT}"
    assert main_text(f"<main><p>Follow us on all the networks.</p><article {mark}>{story}</article></main>").endswith(f"A title {FIRST_TEXT} {MORE_TEXT}")


@pytest.mark.parametrize("tail", ['<div id="seitenleiste"><p>Beliebte Texte der Woche sind hier.</p></div>', '<div class="kommentare"><p>A comment by a reader of this page, who disagrees.</p></div>', "<div><p>A comment by a reader of this page, who disagrees with it all.</p></div>", '<div class="pie-de-pagina"><p>Todos los derechos.</p></div>'])
def test_what_follows_an_article_goes(tail):
    assert main_text(f"<article><h1>A title</h1><p>{FIRST_TEXT}</p><p>{MORE_TEXT}</p></article>{tail}") == f"A title {FIRST_TEXT} {MORE_TEXT}"


@pytest.mark.parametrize("part", ["<p><a href=/1>One link here</a> and <a href=/2>another link there</a></p>", '<div class="notice-board"><p>What the board says today is this.</p></div>', "<p>Short.</p>", "<blockquote>Said who?</blockquote>"])
def test_parts_of_an_article_stay(part):
    text = re.sub("<[^>]*>", "", part)
    assert main_text(f"<article><h1>A title</h1><p>{FIRST_TEXT}</p>{part}<p>{MORE_TEXT}</p></article>") == f"A title {FIRST_TEXT} {text} {MORE_TEXT}"


def test_html_of_a_short_note_and_deep_markup():
    assert main_text("<article><h1>Note</h1><p>Closed on Monday.</p></article><footer>&copy; 2024 x</footer>") == "Note Closed on Monday."
    assert main_text("<div>" * 20_000 + f"<p>{FIRST_TEXT}</p>") == FIRST_TEXT


def test_the_cut_changes_single_labels():
    """A short neutral block between paragraphs is content by the cut alone; scores and edges are of one size."""
    nodes = [html_content.Node("", 0, 0, False, False, False, False, ())] + [html_content.Node("p", 0, 1, False, False, False, False, ()) for _ in range(3)]
    edges = html_content.smoothness([html_content.Block("x", 0, k) for k in (1, 2, 3)], nodes)
    assert html_content.min_cut([2.0, -0.5, 2.0], edges) == [True] * 3 and html_content.min_cut([2.0, -5.0, 2.0], edges) == [True, False, True]


def test_html_of_the_given_pages():
    import duckdb

    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()
    for (page,) in rows:
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        article = re.sub(r"(?s)<script.*?</script>|</?[bi]>", "", article).replace("<br>", " ")
        assert main_text(page) == " ".join(" ".join(re.sub("<[^>]*>", " \n ", html.unescape(article)).split()).split())


def test_min_cut_is_minimal():
    random.seed(5)
    for _ in range(60):
        n = random.randint(1, 8)
        scores = [random.uniform(-2, 2) for _ in range(n)]
        edges = [(random.randrange(n), random.randrange(n), random.uniform(0, 1.5)) for _ in range(random.randint(0, 12))]
        edges = [e for e in edges if e[0] != e[1]]
        cost = lambda side: sum(max(0, s) if not x else max(0, -s) for s, x in zip(scores, side)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023,E731
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(cost(html_content.min_cut(scores, edges)) - best) < 1e-6


# ---- 6 URL filter


def test_url_filter(spark):
    urls = ["https://example.com/en/1", "http://WWW.Example.com/en/", "https://a.www.example.com/en/x?y#z", "https://x.com", "https://x.com/", "http://q.net/es/1", "http://q.net/de/1", None, "no scheme", "://com/", "http://com.org/en/", ""]
    rows = [(i, u) for i, u in enumerate(urls)] + [(2, urls[2])] + [(100 + i, f"http://s{i}.net/{'es' if i % 2 else 'fr'}/{i}") for i in range(40)]
    got = {r["page_id"]: r for r in dicts(url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")))}
    fits = [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(12)]
    assert fits[:6] == [("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("a.www.example.com", "/en/x", "www.example.com/en/"), ("x.com", "", None), ("x.com", "/", "com/"), ("q.net", "/es/1", "net/es/")]
    assert fits[6:] == [("q.net", "/de/1", None), ("", "", None), ("", "", None), ("com", "/", "com/"), ("com.org", "/en/", None), ("", "", None)]
    assert [got[i]["verdict"] for i in (0, 1, 4, 5)] == ["block", "allow", "allow", "block"] and {r["verdict"] for r in got.values()} <= {"allow", "block"}
    alone = dicts(url_filter.judged(spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")))
    assert alone[0]["verdict"] == "allow" and url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_trees_on_held_out_urls(spark):
    """Learned from labelled URLs alone; judged on others, of hosts and suffixes that no labelled URL has."""
    random.seed(11)

    def url(bad, tld):
        word = lambda n: "".join(random.choices("abcdefghilmnoprstu", k=n))
        if bad:
            return f"http://{word(5)}-{word(4)}{random.randint(100, 9999)}.{tld}/{word(3)}{random.randint(10, 99)}/?" + "&".join(f"{word(2)}={random.randint(1, 10**6)}" for _ in range(random.randint(2, 6)))
        return f"https://{word(8)}.{tld}/{word(6)}/{word(7)}-{word(5)}" + random.choice(("", ".html", "?page=2"))

    rows = [(url(k % 3 == 0, random.choice(("aa", "bb", "cc"))), k % 3 == 0) for k in range(600)]
    labelled = spark.createDataFrame([*rows, (None, True), ("http://x.y/", None)], "url string, blocked boolean")
    held = [(k, url(k % 2 == 0, random.choice(("aa", "dd")))) for k in range(200)] + [(900, "http://x.y/" + "z" * 300_000)]
    table = spark.createDataFrame(held, "page_id long, url string")
    for name in ("host", "rule", "verdict", "suffix", "fold", "blocked", "x", "prediction"):
        table = table.withColumn(name, F.lit("x"))
    got = {r["page_id"]: r["verdict"] for r in dicts(url_filter.judged(table, [], labelled))}
    assert len(got) == 201 and sum(got[k] == ("block" if k % 2 == 0 else "allow") for k, _ in held[:200]) >= 190


def test_url_verdicts_of_the_given_pages(spark):
    rows = dicts(url_filter.op6_url_filter(spark, "/root/testdata/sf0.1"))
    assert {r["verdict"] for r in rows if r["rule"] is None} == {"allow", "block"}


# ---- 7 MinHash


def brute_groups(rows, percent, width=5):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, len(s), least.get(g) if s else i, i is not None and (i == least.get(g) if s else True)) for g, (i, _), s in zip(group, rows, sets)]


def test_minhash(spark):
    random.seed(6)
    words = [f"w{k}" for k in range(400)]
    rows = [(1000 + k, None) for k in range(3)] + [(2000, "  \n"), (2001, "one two"), (2002, "One  two"), (None, "one two"), (2003, "one two three four five"), (2001, "one two")]
    for base in range(12):
        text = random.choices(words, k=random.choice((30, 80, 300)))
        for _ in range(14):
            copy = list(text)
            for _ in range(random.randint(0, len(copy) // 30)):
                copy[random.randrange(len(copy))] = random.choice(words)
            rows.append((len(rows) * 7 % 1999, " ".join(copy)))
    key = lambda r: tuple((x is not None, x) for x in r)
    for percent in (80, 85):
        got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in dicts(minhash.near_duplicates(docs(spark, rows), percent))]
        want = [(i, n, c, k and c is not None) for i, n, c, k in brute_groups(rows, percent)]
        assert sorted(got, key=key) == sorted(want, key=key)
    stay = dicts(minhash.stage(spark, docs(spark, rows), ""))
    assert len(stay) == len({(i, t) for (i, t), r in zip(rows, brute_groups(rows, 80)) if r[3] or i is None or not r[1]})
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_minhash_of_mixed_keys(spark):
    """Families whose members are linked to some of their family only, so that band keys hold several groups; every link by brute force."""
    random.seed(16)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for family in range(6):
        text = random.choices(words, k=120)
        for _ in range(50):
            copy, at = list(text), random.randrange(60)
            for k in range(random.randint(1, 14)):  # a run of changed words: similarities on both sides of the threshold
                copy[(at + k) % 120] = random.choice(words)
            rows.append((len(rows) * 7 % 2003, " ".join(copy)))
    want = brute_groups(rows, 80)
    assert 6 < len({c for _, _, c, _ in want}) < 300
    for block in (1024, 4):
        got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in dicts(minhash.near_duplicates(docs(spark, rows), 80, block=block))]
        assert sorted(got) == sorted(want)


def test_super_minhash_estimates_similarity():
    random_ = np.random.default_rng(1)
    for share in (0.5, 0.85):
        pool = random_.integers(0, 1 << 63, 2000).astype(np.uint64)
        n = int(2000 * share)
        sets = [np.unique(pool[:n]), np.unique(np.concatenate([pool[:n], pool[n:]]))]
        sets = [x for x in sets]
        values = minhash.super_minhash(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), 256)
        assert abs((values[0] == values[1]).mean() - len(sets[0]) / len(sets[1])) < 0.1
    small = minhash.super_minhash(np.array([3, 9], np.uint64), np.array([0, 0, 2]), 64)
    assert np.isinf(small[0]).all() and (small[1] < 64).all()


# ---- 8 chat formatting


CHAT = "conv_id long, turn long, role string, text string"


def wrap(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def test_chat(spark):
    rows = [
        (0, 0, "user", "Hi <|end|>"), (0, 1, "assistant", "Hello"), (0, 2, "user", "Bye"),
        (1, 10, "user", "Hi <|end|>"), (1, 11, "assistant", "What?"), (1, 11, "assistant", "What?"),  # other turn numbers, a repeated row
        (2, 0, "user", "Hi <|end|>"), (2, 1, "assistant", "Hello"),  # the beginning of 0
        (4, 0, "user", "same"), (5, 0, "user", "same"), (6, None, None, None), (7, None, "x|>y", "b"), (7, None, "a", "c"), (9, 3, "user", "alone"), (None, 0, "user", "lost"),
        (20, 0, "user", "q"), (20, 1, "assistant", "z" * 200_000), (21, 0, "user", "q"), (21, 1, "assistant", "no"),
    ]
    table = spark.createDataFrame(rows, CHAT).withColumn("side", F.lit("x")).withColumn("cut", F.lit(1)).withColumn("pos", F.lit(1)).withColumn("pair_id", F.lit(1))
    pairs = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (1, 0, 2), (2, 4, 5), (3, 6, 7), (4, 8, 9), (5, 20, 21), (None, 0, 1), (6, None, 1)], "pair_id long, chosen_id long, rejected_id long").withColumn("pos", F.lit(1))
    got = sorted((r["pair_id"], r["part"], r["pos"], r["role"], r["text"], r["loss"]) for r in dicts(chat.preference_pairs(table, pairs)))
    assert got == [
        (0, "chosen", 1, "assistant", wrap("assistant", "Hello"), True), (0, "chosen", 2, "user", wrap("user", "Bye"), False), (0, "prompt", 0, "user", wrap("user", "Hi <||end|>"), False),
        (0, "rejected", 1, "assistant", wrap("assistant", "What?"), True),
        (3, "chosen", 0, "unknown", wrap("unknown", ""), False), (3, "rejected", 0, "a", wrap("a", "c"), False), (3, "rejected", 1, "x|>y", wrap("x||>y", "b"), False),
        (5, "chosen", 1, "assistant", wrap("assistant", "z" * 200_000), True), (5, "prompt", 0, "user", wrap("user", "q"), False), (5, "rejected", 1, "assistant", wrap("assistant", "no"), True),
    ]
    assert chat.preference_pairs(table.limit(0), pairs).count() == 0 and chat.preference_pairs(table, pairs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "<|", "<||", "a<|end|>b", "<||||<|", "||>", "<<|>"])
def test_rendered_texts_can_be_restored(spark, text):
    got = spark.range(1).select(chat.rendered(F.lit("r"), F.lit(text)).alias("x")).first()["x"]
    inner = got[len("<|r|>\n") : -len("<|end|>\n")]
    assert "<|end|>" not in inner and inner.replace("<||", "<|") == text


@pytest.mark.parametrize("same", [0, 1, 3])
def test_prefixes_of_none_some_and_all_turns(spark, same):
    turns = [(k, ("user", "assistant")[k % 2], f"m{k}") for k in range(3)]
    rows = [(0, *t) for t in turns] + [(1, k, role, text if k < same else text + "!") for k, role, text in turns]
    got = dicts(chat.preference_pairs(spark.createDataFrame(rows, CHAT), spark.createDataFrame([(0, 0, 1)], "pair_id long, chosen_id long, rejected_id long")))
    count = lambda part: sum(r["part"] == part for r in got)
    assert [count(p) for p in ("prompt", "chosen", "rejected")] == ([0, 0, 0] if same == 3 else [same, 3 - same, 3 - same])


def test_reply_pairs_share_their_history(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "b <|"), (5, 0, "user", "q"), (5, 1, "assistant", "b <|"), (7, None, None, None), (None, 0, "user", "lost")]
    table = spark.createDataFrame(rows, CHAT).withColumn("part", F.lit("x"))
    got = [(r["part"], r["conv_id"], r["pos"], r["text"].split("\n")[1], r["loss"]) for r in dicts(chat.reply_pairs(table))]
    prompt = [(0, 0, "q"), (0, 1, "a"), (0, 2, "more"), (0, 3, "b <||"), (5, 0, "q"), (5, 1, "b <||"), (7, 0, "")]
    want = [("prompt", c, t, x + "<|end|>", False) for c, t, x in prompt]
    for c, t, chosen, rejected in ((0, 1, "a", "b <||"), (5, 1, "b <||", "a")):  # (0, 3) equals the reply after it
        want += [("chosen", c, t, chosen + "<|end|>", True), ("rejected", c, t, rejected + "<|end|>", True)]
    assert sorted(got) == sorted(want)
    assert chat.reply_pairs(table.limit(0)).count() == 0


def same_by_sql(rows, sql, data="/root/testdata/sf0.001", tables=("conversations",)):
    from collections import Counter

    import duckdb

    duck = duckdb.connect()
    for name in tables:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(rows[0]) and Counter(tuple(r[k] for k in names) for r in rows) == Counter(got.fetchall())


def test_chat_queries_equal_their_sql(spark):
    data = "/root/testdata/sf0.001"
    rows = dicts(chat.op8_chat_formatting(spark, data))
    same_by_sql(rows, chat.OP8_SQL)
    same_by_sql(dicts(chat.op8_reply_pairs(spark, data)), chat.OP8_REPLIES_SQL)
    whole = dicts(chat.messages(spark.read.parquet(f"{data}/conversations.parquet")))
    own = {(r["pair_id"], r["pos"]): r["role"] for r in rows if r["part"] != "rejected"}
    assert own == {(r["conv_id"], r["pos"]): r["role"] for r in whole}  # every message, once
    turns = lambda part: max(sum(r["pair_id"] == p and r["part"] == part for r in rows) for p in own for p in [p[0]])
    assert turns("chosen") > 1 and turns("rejected") > 1 and any(r["loss"] for r in rows)


def brute_pairs(rows):
    """Pair -> (chosen, rejected) as lists of (role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, set()).add((turn is None, turn or 0, role or "unknown", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    place = {c: min((hashlib.md5(f"{c}:{k}".encode()).hexdigest(), k) for k, (role, _) in enumerate(v) if role == "assistant")[1] if any(r == "assistant" for r, _ in v) else len(v) - 1 for c, v in own.items()}
    order = sorted(own)
    return {c: (own[c], own[c][: place[c]] + own[d][place[d] :]) for c, d in zip(order, order[1:] + order[:1])}


@pytest.mark.parametrize("seed", range(3))
def test_pairs_share_what_they_have_in_common(spark, seed):
    """Few texts, so prefixes go beyond the drawn place, end before it, and cover whole conversations."""
    random.seed(seed)
    rows = [(c * (1 if c % 2 else 40_000), t, ("user", "assistant", None)[(t + (c % 5 == 0)) % 2 if c % 7 else 0], random.choice(("a", "a", "b", None))) for c in range(-20, 40) for t in range(random.randint(1, 6))]
    rows += [rows[3], (None, 0, "user", "lost"), (9, None, None, None), (9, None, "assistant", "last")]
    got = {}
    for r in dicts(chat.formatted(chat.continued_pairs(spark.createDataFrame(rows, CHAT).withColumn("place", F.lit(1)).withColumn("other", F.lit(1))), unpaired=True)):
        got.setdefault(r["pair_id"], []).append((r["part"], r["pos"], r["role"], r["text"], r["loss"]))
    want = {}
    for p, (chosen, rejected) in brute_pairs(rows).items():
        cut = next((k for k, (x, y) in enumerate(zip(chosen, rejected)) if x != y), min(len(chosen), len(rejected)))
        paired = cut < min(len(chosen), len(rejected))
        want[p] = [("prompt", k, role, wrap(role, text), False) for k, (role, text) in enumerate(chosen[:cut])]
        for part, side in (("chosen", chosen), ("rejected", rejected)):
            want[p] += [(part, k, role, wrap(role, text), paired and role == "assistant") for k, (role, text) in enumerate(side) if k >= cut]
    assert {p: sorted(v) for p, v in got.items()} == {p: sorted(v) for p, v in want.items()}
    assert any(all(x[0] == "prompt" or not x[4] for x in v) for v in got.values())


def test_pairs_of_one_and_no_conversation(spark):
    one = spark.createDataFrame([(3, 0, "user", "a"), (3, 1, "assistant", "b")], CHAT)
    assert sorted((r["part"], r["loss"]) for r in dicts(chat.formatted(chat.continued_pairs(one), unpaired=True))) == [("prompt", False)] * 2
    assert chat.formatted(chat.continued_pairs(one.limit(0)), unpaired=True).count() == 0


# ---- 9 quality


def test_quality(spark):
    random.seed(8)
    rows = [(i, ("good words and sentences. " if i % 3 else "$$$ ### %%% ") * random.randint(1, 90)) for i in range(150)] + [(500, None), (501, ""), (502, "good words and sentences. " * 20_000), (None, "x"), (3, "$$$ ###")]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(120)] + [(7, 0, 0), (None, 1, 0), (9, None, 0), (120, 5, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs(spark, rows), labels)
    got = {(r["doc_id"], r["text"]): r for r in dicts(quality.score(docs(spark, rows), net, ["doc_id", "text"]))}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all((got[r]["score"] > 0.5) == bool(r[0] % 3) for r in rows[:150])
    assert quality.fit(docs(spark, rows), labels.limit(0)) is None
    assert [r["score"] for r in dicts(quality.score(docs(spark, [(1, "a")]), None, ["doc_id"]))] == [0.5]


def test_quality_gradient():
    random_ = np.random.default_rng(0)
    x = random_.normal(size=(60, 256 + quality.PAIRS + 2)).astype(np.float32)
    number = np.array([1, 4, 5] * 6)
    y = (np.add.reduceat(x[:, 0], np.cumsum(number) - number) > 0).astype(np.float32)
    net = quality.train(x, number, y, epochs=60)
    assert ((net.forward(x, number)["p"] > 0.5) == (y > 0.5)).mean() > 0.9


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    good = np.array(labels, bool)
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / max(1, good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    """op1 and op9 on rows that they did not learn from."""
    data = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    said = [r for r in dicts(language_id.op1_language_id(spark, data)) if r["held_out"] and r["lang_pred"] != "und" and langs[r["doc_id"]]]
    assert len(said) > 200 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in said) / len(said) > 0.95
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    scored = [r for r in dicts(quality.op9_quality(spark, data)) if r["held_out"] and r["doc_id"] in marks]
    assert len(scored) > 50 and auc([r["score"] for r in scored], [marks[r["doc_id"]] for r in scored]) > 0.95


def test_score_of_an_empty_table_and_too_many_languages(spark):
    net = quality.fit(docs(spark, [(k, "a b c " * (k + 1)) for k in range(20)]), spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int"))
    assert quality.score(docs(spark, []), net, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        language_id.fit(docs(spark, [(k, "abc", f"l{k}") for k in range(5)]), most_labels=4)


# ---- 10 embeddings


def brute_vectors(rows, least):
    x = []
    for _, v in rows:
        ok = v is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)
        a = np.array(v, np.float64) if ok else None
        x.append(a / np.linalg.norm(a) if ok else None)
    group, links = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(x):
        for j in range(i):
            if a is not None and x[j] is not None and (a @ x[j] >= least or rows[i][1] == rows[j][1]):
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least_id = {g: min(i for (i, _), h in zip(rows, group) if h == g) for g in set(group)}
    return sorted((i, n, least_id[g], i == least_id[g]) for (i, _), n, g in zip(rows, links, group))


@pytest.mark.parametrize("tile", [4096, 7])
def test_embeddings(spark, tile):
    random_ = np.random.default_rng(9)
    rows = []
    for _ in range(12):
        center = random_.normal(size=16)
        for spread in (0.0, 0.0, 0.05, 0.1, 0.15, 0.2, 0.3):
            rows.append((center + spread * random_.normal(size=16)).astype(np.float32).tolist())
    rows += [None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1e-30] * 16, [1e30] * 16]
    rows = [(int(k), v) for k, v in zip(random_.permutation(len(rows)), rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("c", F.lit("x")).withColumn("n_links", F.lit(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in dicts(embeddings.near_duplicates(df, 0.9, tile)))
    assert got == brute_vectors(rows, 0.9)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_null_and_repeated_ids(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v), (1, v), (None, v), (4, [1.0, 2.0]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"] or -1), r["n_links"], r["component_id"], r["kept"]) for r in dicts(embeddings.near_duplicates(df)) if r["vec_id"] or r["n_links"])
    assert got == [(-1, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (4, 0, 4, True)]


def test_embeddings_of_several_lengths(spark):
    random_ = np.random.default_rng(3)
    rows = []
    for d in (16, 16, 5, 1, 24):
        center = random_.normal(size=d)
        rows += [(center + s * random_.normal(size=d)).astype(np.float32).tolist() for s in (0.0, 0.0, 0.05, 0.1, 0.2)]
    rows += [None, [], [0.0] * 5]
    rows = [(int(k), v) for k, v in zip(random_.permutation(len(rows)), rows)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in dicts(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))))
    want = []
    for d in {len(v or ()) for _, v in rows}:
        want += brute_vectors([(i, v) for i, v in rows if len(v or ()) == d], 0.9)
    assert got == sorted(want)


@pytest.mark.parametrize("most", [0, 200_000])
def test_embeddings_of_many_lengths_in_one_join(spark, monkeypatch, most):
    """Sixty lengths take one chain of jobs; cells beyond the bound are joined without a broadcast."""
    monkeypatch.setattr(embeddings, "BROADCAST_ROWS", most)
    random_ = np.random.default_rng(8)
    rows = []
    for d in range(1, 61):
        center = random_.normal(size=d)
        rows += [(len(rows) + k, (center + s * random_.normal(size=d)).tolist()) for k, s in enumerate((0.0, 0.1, 1.0))]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in dicts(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))))
    want = []
    for d in range(1, 61):
        want += brute_vectors([(i, v) for i, v in rows if len(v) == d], 0.9)
    assert got == sorted(want)
