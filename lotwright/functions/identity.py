"""Product identity from a title and a description, and the evaluation of retail candidates against it.

Attributes are computed once per title, before any join with candidates. Functions of a DataFrame keep intermediate
results as columns (names begin with ``_i_``), so that no expression is repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V
from .listing import LINE_ENDS, SPACES, ends_with, first_present, has, labelled_in, normalised, normalised_column, phrase_of, trimmed, trimmed_ends
from .text import BETWEEN, B, Read, ascii_words, bare_tokens, compact_tokens, fits, held, identity_tokens, may_fit, numbered, roots, source

_N = r"\b(\d+(?:\.\d+)?)"
# What attributes look like in titles (pattern on the lower-cased title, canonical form of a match).
RULES: dict[str, list[tuple[str, str]]] = {
    "resolutions": [(r"\b2160p\b", "4k"), (r"\b(8k|5k|4k|1440p|1080p|720p)\b", "$1")],
    "dimensions": [(_N + r'[\s-]*(?:inch(?:es)?|in\.?|\")(?=\s|$|[),/])', "$1in"), (_N + r"[\s-]*(?:feet|foot|ft\.?)\b", "$1ft")],
    "platformVariants": [
        (r"\b(?:playstation|ps)\s*([2-6])\b", "playstation:$1"), (r"\bxbox\s+one\b", "xbox:one"), (r"\bxbox\s+series\s*([sx])\b", "xbox:series$1"),
        (r"\bnintendo\s+switch\s+(2|oled|lite)\b", "switch:$1"), (r"\bnintendo\s+switch\b(?!\s+(?:2|oled|lite)\b)", "switch:standard"),
    ],
    "memoryTypes": [(r"\b(ddr[345](?:l|x)?)\b", "$1")],
    "frequencies": [(_N + r"[\s-]*(mhz|ghz)\b", "$1$2")],
    "refreshRates": [(r"\b(\d{2,3})[\s-]*hz\b", "$1hz")],
    "storageTypes": [(r"\b(nvme|ssd|hdd)\b", "$1"), (r"\bnvme\b", "ssd")],
    "networkStandards": [(r"\bwi[\s-]*fi\s*(5|6e?|7)\b", "wifi:$1"), (r"\b(?:bluetooth|bt)\s*(\d+(?:\.\d+)?)\b", "bluetooth:$1")],
    "editions": [(r"\b(?:all[\s-]*digital|digital\s+edition)\b", "digital"), (r"\bdisc\s+(?:edition|version)\b", "disc"), (r"\b(oled|lite|slim)\s+(?:edition|model|console)\b", "$1")],
    "voltages": [(_N + r"[\s-]*(?:v|volts?)\b", "$1v")],
    "wattages": [(_N + r"[\s-]*(?:w|watts?)\b", "$1w")],
    "batteryCapacities": [(_N + r"[\s-]*(?:ah|amp[\s-]*hours?)\b", "$1ah")],
    "lensRanges": [(_N + r"\s*-\s*(\d+(?:\.\d+)?)[\s-]*mm\b", "$1-$2mm"), (r"(?<![\d.-])(?<!- )(\d+(?:\.\d+)?)[\s-]*mm\b", "$1mm")],
    "gpuModels": [
        (r"\b(rtx|gtx)\s*(\d{3,4})\s*ti\s*super\b", "nvidia:$1:$2:ti-super"), (r"\b(rtx|gtx)\s*(\d{3,4})\s*(ti|super)\b(?!\s*super\b)", "nvidia:$1:$2:$3"), (r"\b(rtx|gtx)\s*(\d{3,4})\b(?!\s*(?:ti|super)\b)", "nvidia:$1:$2:base"),
        (r"\bradeon\s+rx\s*(\d{3,4})\s*(xtx|xt)\b", "amd:rx:$1:$2"), (r"\bradeon\s+rx\s*(\d{3,4})\b(?!\s*(?:xtx|xt)\b)", "amd:rx:$1:base"),
    ],
    "cpuModels": [
        (r"\bcore\s+i([3579])[\s-]*(\d{4,5})([a-z]{1,2})\b", "intel:i$1:$2:$3"), (r"\bcore\s+i([3579])[\s-]*(\d{4,5})\b", "intel:i$1:$2:base"),
        (r"\bryzen\s+([3579])\s+(\d{4})([a-z]{1,3})\b", "amd:ryzen$1:$2:$3"), (r"\bryzen\s+([3579])\s+(\d{4})\b", "amd:ryzen$1:$2:base"),
        (r"\bapple\s+m([1-9])\s*(pro|max|ultra)\b", "apple:m$1:$2"), (r"\bapple\s+m([1-9])\b(?!\s*(?:pro|max|ultra)\b)", "apple:m$1:base"),
    ],
    "packageCounts": [
        (r"\b0*(\d{1,4})[\s-]*(?:pack|pk|count|ct|pcs?|pieces?)\b", "$1"), (r"\b(?:pack|set)\s+of\s+0*(\d{1,4})\b", "$1"),
        (r"\b0*(\d{1,4})\s*[x×]\s*\d+(?:\.\d+)?\s*(?:" + "|".join(V.VOLUMES.values()) + r")\b", "$1"),
    ],
    "variantLabels": [(r"\b(?:unit|model|style|size)\s*[-:#]?\s*([a-z0-9][a-z0-9-]{0,15})\b", "$1")],
    "volumes": [(rf"{_N}[\s-]*(?:{u})\b", f"$1{name}") for name, u in V.VOLUMES.items()] + [(rf"\b\d{{1,4}}\s*[x×]\s*(\d+(?:\.\d+)?)\s*(?:{u})\b", f"$1{name}") for name, u in V.VOLUMES.items()],
    "modeCounts": [(r"\b0*(\d{1,2})[\s-]*(?:speeds?|modes?|settings?)\b", "$1")],
    "featureCounts": [(r"\b0*(\d{1,2})[\s-]*in[\s-]*1\b", "$1")],
}
#: All groups of attributes.
GROUPS = ["capacities", *RULES, "seriesSignatures", "colors", "materials", "productFamilies"]
#: Groups whose shared values count twice, and those that a candidate must state if the lot does.
DOUBLE, CRITICAL = ("platformVariants", "seriesSignatures"), ("packageCounts", "volumes")


def _empty() -> Column:
    return F.array().cast("array<string>")


#: Patterns of colours by name, and that of balls of any kind.
COLOR_PATTERNS = {c: rf"\b{c}\b" for c in V.COLORS}
BALL = r"\bballs?\b"
#: Literals of which a word begins with one wherever a pattern that needs no digit fits.
LITERALS = roots(tuple(p for group in (V.KINDS, V.FAMILIES, V.MATERIALS, V.BRANDS, COLOR_PATTERNS) for p in group.values()) + tuple(p for rules in RULES.values() for p, _ in rules if not numbered(p)) + (BALL,))


def _plain(text: Column | Read) -> Column:
    return text.text if isinstance(text, Read) else text


def _all(text: Column | Read, pattern: str) -> Column:
    """Every match of a pattern in a lower-cased text."""
    return F.when(may_fit(text, pattern), F.regexp_extract_all(source(text, pattern), F.lit(ascii_words(pattern)), F.lit(0))).when(_plain(text).isNotNull(), _empty())


def _form(pattern: str, form: str):
    """The canonical form of a match: a constant, or its groups put into a template."""
    bare = pattern.replace(r"\b", "").replace(r"(?=\s|$|[),/])", "")  # the match stands alone: what must be around it is not there
    return (lambda m: F.regexp_replace(m, bare, form)) if "$" in form else (lambda m: F.lit(form))


def _named(text: Column | Read, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(fits(text, p), F.lit(n)) for n, p in patterns.items())))


def _series(text: Column) -> Column:
    """Members of known series: name, number and the variant words after it, joined by colons; read from the words around each number."""
    words = F.regexp_extract_all(text, F.lit(r"[a-z]+\d+[a-z]*|\d+(?:\.\d+)?[a-z]+|\d+(?:st|nd|rd|th)?|[a-z]+"), F.lit(0))
    # every word with the two before and the three after it
    at = lambda k: F.concat(F.array_repeat(F.lit(""), max(0, -k)), F.slice(words, 1 + max(0, k), F.greatest(F.size(words), F.lit(1)))) if k else words
    around = F.arrays_zip(*(at(k).alias(n) for k, n in ((-2, "b2"), (-1, "b1"), (0, "t"), (1, "a1"), (2, "a2"), (3, "a3"))))
    is_variant = lambda w: F.coalesce(w.isin(V.VARIANTS), F.lit(False))

    def member(w: Column) -> Column:
        family = F.when(~is_variant(w["b1"]) & (w["b1"] != ""), w["b1"]).when(~is_variant(w["b2"]), w["b2"])
        number = w["t"].rlike(r"^\d+(?:st|nd|rd|th)?$") | (w["t"].rlike(r"^[a-z]+\d+[a-z]*$") & ~w["t"].rlike(r"^(?:ddr|wifi|bt)\d"))
        other = F.coalesce(w["a1"].isin(V.UNIT_WORDS), F.lit(False)) | w["t"].rlike(r"^(?:720p|1080p|1440p|2160p|[458]k)$")
        one, two, three = is_variant(w["a1"]), is_variant(w["a1"]) & is_variant(w["a2"]), is_variant(w["a1"]) & is_variant(w["a2"]) & is_variant(w["a3"])
        parts = F.array_compact(F.array(family, w["t"], F.when(one, w["a1"]), F.when(two, w["a2"]), F.when(three, w["a3"])))
        return F.when(number & ~other & family.isin(V.SERIES), F.array_join(parts, ":"))

    named = reduce(Column.__or__, (F.contains(text, F.lit(s)) for s in V.SERIES))
    return F.when(named, F.array_sort(F.array_distinct(F.array_compact(F.transform(around, member))))).when(text.isNotNull(), _empty())


def attributes(title: Column) -> dict[str, Column]:
    """Sorted array of distinct canonical values for each attribute group of a title."""
    return attributes_of(F.lower(normalised(title)))


def attributes_of(text: Column | Read) -> dict[str, Column]:
    """The same for text that is lower-cased and in plain signs: a column, so that this is done once and not for each pattern."""
    out: dict[str, Column] = {}
    for name, rules in RULES.items():
        found = [F.transform(_all(text, p), _form(p, form)) for p, form in rules]
        some = reduce(Column.__or__, (may_fit(text, p) for p, _ in rules))
        out[name] = F.when(some, F.array_sort(F.array_distinct(F.concat(*found)))).when(_plain(text).isNotNull(), _empty())
    series = _series(text.numbers if isinstance(text, Read) else text)  # every member has a number
    out["seriesSignatures"] = F.when(F.size(out["platformVariants"]) > 0, _empty()).otherwise(series)
    families = _named(text, V.FAMILIES)
    ball = fits(text, BALL) & ~F.arrays_overlap(families, F.array(*map(F.lit, V.EXCLUSIVE[0])))
    out["productFamilies"] = F.array_sort(F.when(ball, F.array_append(families, F.lit("other-ball"))).otherwise(families))
    units = {"kb": 0, "mb": 1, "gb": 2, "tb": 3}
    sizes = _all(text, _N + r"[\s-]*(?:tb|gb|mb|kb)\b")
    weighed = F.transform(sizes, lambda m: F.struct((F.regexp_extract(m, r"(\d+(?:\.\d+)?)", 1).cast("double") * sum((F.when(F.right(m, F.lit(2)) == u, 1024.0**k).otherwise(0.0) for u, k in units.items()), F.lit(0.0))).alias("n"), F.regexp_replace(m, r"[\s-]", "").alias("v")))
    out["capacities"] = F.when(F.size(weighed) > 0, F.array(F.array_max(weighed)["v"])).otherwise(_empty())  # the largest alone
    colors = F.array_distinct(F.transform(_named(text, COLOR_PATTERNS), lambda c: F.when(c == "gray", "grey").otherwise(c)))
    out["colors"] = F.array_sort(F.when(F.size(colors) > 1, F.array_remove(colors, "clear")).otherwise(colors))  # clear glass in a colour has that colour
    out["materials"] = F.array_sort(_named(text, V.MATERIALS))
    return {g: out[g] for g in GROUPS}


def kind(title: Column) -> Column:
    return kind_of(F.lower(normalised(title)))


def kind_of(text: Column | Read) -> Column:
    return F.coalesce(*(F.when(fits(text, p), k) for k, p in V.KINDS.items()))


def kind_position(title: Column, of: Column) -> Column:
    """Where in a title a kind's pattern first fits, from 1; 0 if it does not, or without a kind."""
    text = F.lower(title)
    return F.coalesce(*(F.when(of == k, F.regexp_instr(text, F.lit(ascii_words(p)))) for k, p in V.KINDS.items()), F.lit(0))


def brand_family(title: Column) -> Column:
    return family_of(F.lower(normalised(title)))


def family_of(text: Column | Read) -> Column:
    return F.coalesce(*(F.when(fits(text, p), k) for k, p in V.BRANDS.items()))


def looks_like_model(x: Column) -> Column:
    v = trimmed(F.coalesce(x, F.lit("")))
    return F.length(v).between(2, 24) & (v.rlike(r"\d") | v.rlike(V.STATED_MODEL)) & ~v.rlike(V.GENERIC_MODEL)  # the costly test last


def model(title: Column) -> Column:
    """The first token of a title that is shaped like a model."""
    return _model(identity_tokens(title))


def _model(tokens: Column) -> Column:
    fits = lambda shape: F.try_element_at(F.filter(tokens, lambda t: t.rlike(shape) & ~t.rlike(V.GENERIC_MODEL)), F.lit(1))
    return F.coalesce(fits(V.MODEL), fits(V.TITLE_MODEL))


def model_matches(title: Column, wanted: Column) -> Column:
    """Whether some run of the title's tokens, joined, is the model: TX SR304 is TXSR304."""
    target = F.regexp_replace(F.lower(wanted), "[^a-z0-9]", "")
    joined = F.concat(F.lit(" "), F.array_join(compact_tokens(normalised(title)), " "), F.lit(" "))
    spaced = F.concat(F.lit(" "), F.regexp_replace(target, "(.)(?=.)", "$1 ?"), F.lit(" "))  # its signs with or without a space between any two
    return F.coalesce((target != "") & F.rlike(joined, spaced), F.lit(False))


#: Fixed value: words of a name that are read first when its first twelve telling ones are looked for.
FIRST_WORDS = 48
#: What a word holds that is shaped like a model or a capacity: a digit, or a hyphen behind a capital.
SHAPED = r"\d|[A-Z]-[A-Z+.]"


def _without(rows: DataFrame, name: str, begins: str, pattern: str) -> DataFrame:
    """rows with a column without what a pattern fits at its beginning; ``begins`` is what the column must begin with for that, white space aside."""
    x = F.col(name)
    return rows.withColumn(name, F.when(F.left(x, F.lit(12)).rlike(rf"(?i)^(?:\s|{begins})"), F.regexp_replace(x, "(?i)" + pattern, "")).otherwise(x))


def _worded(rows: DataFrame) -> DataFrame:
    """rows with ``_i_tokens``, the first twelve words of ``_i_name`` that say something, and ``_i_shaped``, all of its words that may be models or capacities."""
    telling = lambda words: F.filter(bare_tokens(words), lambda t: ~F.lower(t).isin(V.NOISE) & ~t.rlike(r"^\$?[\d.,]+$"))
    rows = rows.withColumn("_i_words", F.split("_i_name", BETWEEN, FIRST_WORDS + 1))  # the last is the rest of the name, if it has more
    rows = rows.withColumn("_i_tokens", telling(F.slice("_i_words", 1, FIRST_WORDS)))
    enough = (F.size("_i_words") <= FIRST_WORDS) | (F.size("_i_tokens") >= 12)
    rows = rows.withColumn("_i_tokens", F.slice(F.when(enough, F.col("_i_tokens")).otherwise(telling(F.split("_i_name", BETWEEN))), 1, 12))
    shaped = bare_tokens(F.filter(F.split("_i_name", BETWEEN), lambda t: t.rlike(SHAPED)))  # no word of NOISE and no plain number has such a shape
    return rows.withColumn("_i_shaped", F.when(F.col("_i_name").rlike(r"\d") | (F.contains("_i_name", F.lit("-")) & F.col("_i_name").rlike(SHAPED)), shaped).otherwise(_empty()))


def _titled(rows: DataFrame, title: str, text: Column) -> DataFrame:
    """rows with ``_i_name``, the product's name, and ``_i_fields``, what the labelled lines of a description say."""
    rows = normalised_column(rows, "_i_lead", F.col(title).cast("string"))
    rows = rows.withColumns({"_i_lead": trimmed_ends(F.col("_i_lead")), "_i_labelled": F.contains(text, F.lit(":")) | F.contains(text, F.lit("?"))})
    rows = normalised_column(rows, "_i_said", F.when(F.col("_i_labelled") | (F.col("_i_lead") == ""), text))  # without labels it only stands in for a title
    fields, free = labelled_in(F.col("_i_said"))
    rows = rows.withColumn("_i_fields", F.when(F.col("_i_labelled"), fields).otherwise(F.map_from_arrays(_empty(), _empty())))
    prose = trimmed(F.regexp_replace(F.get(F.split(free, r"\n\s*\*{2,}"), F.lit(0)), r"\n+", " "))  # needed without a title only
    rows = rows.withColumn("_i_head", F.when(F.col("_i_lead") != "", F.col("_i_lead")).otherwise(F.coalesce(prose, F.lit(""))))
    several = F.contains("_i_head", F.lit("|"))
    rows = rows.withColumn("_i_sections", F.when(several, F.filter(F.transform(F.split("_i_head", r"\|"), trimmed), lambda p: p != "")))
    telling = F.filter("_i_sections", lambda p: ~p.rlike(r"(?i)^lot\s*#?\s*[a-z0-9-]+$|^(?:retail|msrp|est\.?|value)?\s*\$?\s*[\d,]+(?:\.\d+)?\s*$"))
    named = F.coalesce(F.get(telling, F.lit(0)), F.try_element_at("_i_sections", F.lit(-1)), F.lit(""))
    named = F.when(F.size("_i_sections") > 1, named).otherwise(F.coalesce(F.get("_i_sections", F.lit(0)), F.lit("")))
    rows = rows.withColumn("_i_name", F.when(several, named).otherwise(trimmed_ends(F.col("_i_head"))))
    rows = _without(rows, "_i_name", "retail|msrp|est|value", r"^\s*(?:retail|msrp|est\.?\s*retail(?:\s*price)?|value)\s*[:\-]?\s*\$?\s*[\d,]+(?:\.\d+)?\s*")
    rows = _without(rows, "_i_name", r"\$", r"^\s*\$\s*[\d,]+(?:\.\d+)?\s*")
    rows = rows.withColumn("_i_name", F.regexp_replace("_i_name", r"\s{2,}", " "))
    rows = rows.withColumn("_i_name", trimmed_ends(F.col("_i_name")))
    dashed = ends_with(F.col("_i_name"), ("-", *SPACES, *LINE_ENDS))
    rows = rows.withColumn("_i_name", F.when(dashed, F.regexp_replace("_i_name", r"\s*-\s*$", "")).otherwise(F.col("_i_name")))
    for begins, pattern in zip(("lot", "av|inv|sku|stock|item", "brand|new|open|used|refurbished|renewed"), V.PREFIXES, strict=True):
        rows = _without(rows, "_i_name", begins, pattern)
    first = trimmed(F.get(F.split("_i_said", "\n"), F.lit(0)))
    rows = rows.withColumn("_i_name", trimmed_ends(F.col("_i_name")))
    return rows.withColumn("_i_name", F.when(F.length("_i_name") >= 3, F.col("_i_name")).when(F.col("_i_lead") != "", F.col("_i_lead")).otherwise(first))


def identity_of(rows: DataFrame, title: str, description: str | None = None, stated: str | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """rows with further columns, and what ``identified`` says of them in terms of these, by name.

    The title names the product; labelled lines of the description add brand and model. ``tokens`` are the first twelve
    words that say something, ``telling`` those that titles are compared by, ``evidence`` counts attribute values, ``asks``
    is what ``evaluated`` looks for in a candidate's title.
    """
    text = F.col(description).cast("string") if description else F.lit(None).cast("string")
    rows = _worded(_titled(rows, title, text))  # the name is in plain signs
    said = lambda *names: trimmed(F.coalesce(first_present(F.col("_i_fields"), list(names)), F.lit("")))
    rows = rows.withColumns({"_i_first": F.coalesce(F.get("_i_tokens", F.lit(0)), F.lit("")), "_i_stated": said("brand", "manufacturer", "make"), "_i_number": said("model", "model #", "model number", "mpn")})
    stated_brand, number = F.col("_i_stated"), F.col("_i_number")
    appears = F.rlike(F.col("_i_name"), F.concat(F.lit("(?i)" + B), literal(stated_brand), F.lit(B)))
    brand = F.when((stated_brand != "") & ((F.col("_i_first") == "") | F.col("_i_first").rlike(V.GENERIC_BRAND) | appears), stated_brand).otherwise(F.col("_i_first"))
    good = F.when(looks_like_model(number), number)
    found = F.coalesce(F.when(model_matches(F.col("_i_name"), number), good), _model(F.col("_i_shaped")), good)
    rows = rows.withColumns({"_i_brand": brand, "_i_model": found, "_i_text": F.lower("_i_name")})
    rows = rows.withColumns({"_i_family": F.concat(F.lower("_i_brand"), F.lit(" "), F.col("_i_text")), "_i_numbers": F.when(F.col("_i_text").rlike(r"\d"), F.col("_i_text")).otherwise("")})
    rows = rows.withColumn("_i_held", held(F.col("_i_family"), LITERALS))
    read = Read(F.col("_i_text"), F.col("_i_numbers"), F.col("_i_held"), LITERALS)
    rows = rows.withColumns({f"_i_g_{g}": c for g, c in attributes_of(read).items()})
    own = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("_i_model", "_i_brand")]
    second = F.filter("_i_shaped", lambda t: (F.lower(t) != own[0]) & (F.lower(t) != own[1]) & t.rlike(V.TITLE_MODEL) & ~t.rlike(V.GENERIC_MODEL))
    certain = F.col("_i_model").isNotNull() | (F.size("_i_g_gpuModels") > 0) | (F.size("_i_g_cpuModels") > 0)
    rows = rows.withColumn("_i_g_seriesSignatures", F.when(certain, _empty()).otherwise(F.col("_i_g_seriesSignatures")))
    tokens = F.col("_i_tokens")
    small = F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]+", ""))
    retail = F.col(stated).cast("double") if stated else F.lit(None).cast("double")
    values = {
        "name": F.col("_i_name"), "query": phrase_of(F.col("_i_name")), "brand": F.col("_i_brand"), "model": F.col("_i_model"), "model2": F.get(second, F.lit(0)),
        "kind": kind_of(read), "sizes": F.array_distinct(F.filter("_i_shaped", lambda t: t.rlike(V.CAPACITY))), "tokens": tokens,
        "stated_retail": F.when((retail > 0) & (retail < float("inf")), retail), "family": family_of(read._replace(text=F.col("_i_family"))),
        "evidence": sum((F.size(f"_i_g_{g}") for g in GROUPS), F.lit(0)),
        "telling": F.array_distinct(F.filter(small, lambda t: (F.length(t) > 2) & ~t.isin(V.RETAIL_NOISE) & ~t.rlike("^[0-9]+$"))),
        "asks": _asks({"name": F.col("_i_name"), "brand": F.col("_i_brand"), "model": F.col("_i_model"), "model2": F.get(second, F.lit(0)), "tokens": tokens} | {g: F.col(f"_i_g_{g}") for g in GROUPS}),
        **{g: F.col(f"_i_g_{g}") for g in GROUPS},
    }
    return rows, values


def identified(rows: DataFrame, title: str, description: str | None = None, stated: str | None = None, out: str = "identity") -> DataFrame:
    """rows with struct(name, query, brand, model, model2, kind, capacities, tokens, stated_retail, family, evidence, telling, asks, and every attribute group)."""
    rows, values = identity_of(rows, title, description, stated)
    kept = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("_i_") and c != out]
    return rows.select(*kept, F.struct(*(c.alias(n) for n, c in values.items())).alias(out))


def offered(rows: DataFrame, title: str, out: str = "offer") -> DataFrame:
    """rows with struct(title, kind, family, words, signs, and every attribute group) of a candidate's title; ``signs`` is what ``evaluated`` needs of the title whatever the lot."""
    rows = rows.withColumn("_i_title", F.coalesce(F.col(title).cast("string"), F.lit("")))
    rows = rows.withColumns({"_i_text": F.lower(normalised(F.col("_i_title"))), "_i_lower": F.lower(F.col("_i_title"))})
    rows = rows.withColumns({"_i_kind": kind_of(F.col("_i_text")), "_i_words": compact_tokens(F.col("_i_text")), **{f"_i_g_{g}": c for g, c in attributes_of(F.col("_i_text")).items()}})
    at = lambda pattern: F.regexp_instr(F.col("_i_lower"), F.lit(ascii_words(pattern)))  # noqa: E731  from 1; 0 where it does not occur
    rows = rows.withColumns({"_i_noun": at(V.ACCESSORY), "_i_marker": at(V.LATER_MARKER), "_i_at": kind_position(F.col("_i_title"), F.col("_i_kind"))})
    between = F.substring(F.col("_i_lower"), F.col("_i_at"), F.greatest(F.col("_i_noun") - F.col("_i_at"), F.lit(0)))
    signs = F.struct(
        F.col("_i_lower").alias("lower"), F.array_join("_i_words", "").alias("joined"), F.concat(F.lit(" "), F.array_join("_i_words", " "), F.lit(" ")).alias("spaced"), F.col("_i_noun").alias("noun"), F.col("_i_marker").alias("marker"),
        F.col("_i_lower").rlike(ascii_words(V.NOT_WHOLE)).alias("not_whole"), F.col("_i_lower").rlike(ascii_words(V.MARKER)).alias("marked"), F.col("_i_lower").rlike(rf"(?:{V.FOR_VERBS})\s").alias("for_something"),
        F.col("_i_at").alias("kind_at"), between.rlike(ascii_words(r"\b(?:with|includes?|bundle)\b")).alias("bundled"), F.regexp_extract(F.regexp_replace("_i_lower", V.TITLE_PREFIX, ""), r"[a-z0-9][a-z0-9.&'-]*", 0).alias("first"),
        F.map_from_entries(_said({g: F.col(f"_i_g_{g}") for g in GROUPS})).alias("said"),
    )
    result = F.struct(F.col("_i_title").alias("title"), F.col("_i_kind").alias("kind"), family_of(F.col("_i_text")).alias("family"), F.col("_i_words").alias("words"), signs.alias("signs"), *(F.col(f"_i_g_{g}").alias(g) for g in GROUPS))
    kept = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("_i_") and c != out]
    return rows.select(*kept, result.alias(out))


def literal(x: Column) -> Column:
    """A pattern that fits x and nothing else."""
    return F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def sufficient(lot: Column) -> Column:
    """Whether a lot says enough to be compared at all."""
    return lot["model"].isNotNull() | (F.size(lot["telling"]) >= 3) | (lot["kind"].isNotNull() & (lot["evidence"] > 0))


def _said(groups: dict[str, Column]) -> Column:
    """Array of struct(group, values) of the attribute groups that have any, in order."""
    return F.filter(F.array(*(F.struct(F.lit(g).alias("group"), groups[g].alias("values")) for g in GROUPS)), lambda x: F.size(x["values"]) > 0)


def _asks(lot: dict[str, Column]) -> Column:
    """What a lot looks for in candidates' titles, of which nothing depends on the candidate: attributes, models in one word, patterns of brand, model and use, words."""
    brand = F.lower(lot["brand"])
    loose = lambda x: F.regexp_replace(literal(F.lower(x)), r"[-\s]", r"[-\\s]?")
    known = F.array_join(F.transform(F.filter(F.array(lot["brand"], lot["model"], lot["model2"]), lambda x: F.coalesce(x != "", F.lit(False))), loose), "|")
    squeezed = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return F.struct(
        _said(lot).alias("said"), squeezed(lot["model"]).alias("model"), squeezed(lot["model2"]).alias("model2"), brand.alias("brand"),
        ((lot["brand"] != "") & ~lot["brand"].rlike(V.GENERIC_BRAND) & ~lot["brand"].rlike(V.CAPACITY) & lot["brand"].rlike("(?i)[a-z]")).alias("credible"),
        F.concat(F.lit(r"(?:^|[^a-z0-9])"), F.regexp_replace(literal(brand), r"\s+", r"\\s+"), F.lit(r"(?:$|[^a-z0-9])")).alias("named"),
        F.when(known != "", F.concat(F.lit(B + rf"(?:{V.FOR_VERBS})\s+(?:the\s+)?[^,;.]{{0,40}}?(?:"), known, F.lit(")"))).alias("use"),
        F.when(lot["model"].isNotNull(), loose(lot["model"])).when(brand != "", F.concat(F.lit(B), literal(brand), F.lit(B))).alias("own"),
        F.lower(lot["name"]).rlike(ascii_words(V.ACCESSORY)).alias("accessory"), F.filter(F.transform(lot["tokens"], F.lower), lambda t: F.length(t) > 2).alias("long"),
    )


def _states(offer: Column, model: Column) -> Column:
    """``model_matches`` of a candidate's title and a model in one word: its signs with or without a space between any two."""
    return F.contains(offer["signs"]["joined"], model) & F.rlike(offer["signs"]["spaced"], F.concat(F.lit(" "), F.regexp_replace(model, "(.)(?=.)", "$1 ?"), F.lit(" ")))


def _accessory(lot: Column, offer: Column, exact: Column, branded: Column) -> Column:
    """Whether a candidate is a part or accessory of a product like the lot's, by rules in order over positions in its title."""
    asks, signs = lot["asks"], offer["signs"]
    title, brand, own, noun, marker = signs["lower"], asks["brand"], asks["own"], signs["noun"], signs["marker"]
    about = asks["use"].isNotNull() & signs["for_something"] & F.rlike(title, asks["use"])
    shared = F.arrays_overlap(lot["platformVariants"], offer["platformVariants"]) | F.arrays_overlap(lot["seriesSignatures"], offer["seriesSignatures"])
    own_at = F.regexp_instr(title, own)
    return (
        F.when(lot["kind"].eqNullSafe("game-console") & ~offer["kind"].eqNullSafe("game-console"), True)
        .when(signs["not_whole"], True)
        .when((noun == 0) | asks["accessory"], False)
        .when(signs["marked"] | about, True)
        .when((marker > noun) & (F.coalesce(shared, F.lit(False)) | branded | exact), True)
        .when(offer["kind"].eqNullSafe(lot["kind"]) & (signs["kind_at"] > 0) & (signs["kind_at"] < noun) & (exact | signs["bundled"]), False)
        .when(exact & (marker == 0), False)
        .when((brand != "") & (signs["first"] != "") & (signs["first"] != brand) & ~branded, True)
        .when(own.isNull(), noun < 21)
        .when(own_at == 0, True)
        .otherwise(noun < own_at)
    )


def _say(what: str, g: str, lot: Column, offer: Column) -> Column:
    return F.concat(F.lit(f"{what}:{g}:"), F.array_join(F.array_except(lot[g], offer[g]), ","))


def _contradicted(lot: Column, offer: Column) -> list[Column]:
    return [F.when((F.size(F.array_except(lot[g], offer[g])) > 0) & (F.size(offer[g]) > 0), _say("attribute-conflict", g, lot, offer)) for g in GROUPS]


def _lacking(lot: Column, offer: Column) -> list[Column]:
    return [F.when((F.size(F.array_except(lot[g], offer[g])) > 0) & (F.size(offer[g]) == 0), _say("attribute-missing", g, lot, offer)) for g in CRITICAL]


def compared(lot: Column, offer: Column) -> Column:
    """struct(shared, evidence, conflicts, missing) of two structs that have an array for each of GROUPS.

    ``shared`` counts values in both, those of DOUBLE twice; ``evidence`` all values of the lot. A group conflicts if the offer
    states values of it and lacks one of the lot's; a group of CRITICAL is missing if the offer states none.
    """
    shared = sum((F.size(F.array_intersect(lot[g], offer[g])) * (2 if g in DOUBLE else 1) for g in GROUPS), F.lit(0))
    evidence = sum((F.size(lot[g]) for g in GROUPS), F.lit(0))
    return F.struct(shared.alias("shared"), evidence.alias("evidence"), F.array_compact(F.array(*_contradicted(lot, offer))).alias("conflicts"), F.array_compact(F.array(*_lacking(lot, offer))).alias("missing"))


def evaluated(rows: DataFrame, lot: str, offer: str, out: str = "evaluation") -> DataFrame:
    """rows with struct(accepted, score, reasons, evidence, donor_score) of a candidate (``offered``) for a lot (``identified``).

    Reasons: too little identity, an accessory, contradicted or critical missing attributes, another brand, kind or model,
    weak overlap of words. Without any, the score adds 5 for the model, 2 each for a second model, brand and kind, the
    shared attributes and 4 times the share of words. The donor score is that of plain words behind the same hard
    conflicts, and the higher of the two. Values within a reason are sorted.
    """
    l, o = F.col(lot), F.col(offer)
    asks, signs = l["asks"], o["signs"]
    title = signs["lower"]
    named = F.contains(title, F.regexp_extract(asks["brand"], r"^\S*", 0)) & F.rlike(title, asks["named"])
    branded = asks["credible"] & F.when(l["family"].isNotNull(), o["family"].eqNullSafe(l["family"])).otherwise(named)
    against = lambda x: F.coalesce(signs["said"][x["group"]], _empty())  # noqa: E731  what the candidate says of a group that the lot says something of
    groups = F.transform(
        asks["said"],
        lambda x: F.struct(
            x["group"].alias("group"), F.array_except(x["values"], against(x)).alias("gone"), (F.size(against(x)) > 0).alias("stated"),
            (F.size(F.array_intersect(x["values"], against(x))) * F.when(x["group"].isin(*DOUBLE), 2).otherwise(1)).alias("shared"),
        ),
    )
    hits = F.size(F.array_intersect(l["telling"], o["words"]))
    rows = rows.withColumns(
        {
            "_i_exact": l["model"].isNotNull() & (asks["model"] != "") & _states(o, asks["model"]), "_i_second": l["model2"].isNotNull() & (asks["model2"] != "") & _states(o, asks["model2"]), "_i_credible": F.coalesce(asks["credible"], F.lit(False)),
            "_i_branded": F.coalesce(branded, F.lit(False)), "_i_same": l["kind"].isNotNull() & o["kind"].eqNullSafe(l["kind"]), "_i_groups": groups, "_i_hits": hits, "_i_total": F.size(l["telling"]), "_i_share": F.coalesce(F.try_divide(hits, F.size(l["telling"])), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("_i_shared", F.aggregate("_i_groups", F.lit(0), lambda n, x: n + x["shared"])).withColumn("_i_gone", F.filter("_i_groups", lambda x: F.size(x["gone"]) > 0))
    exact, second, branded, same, shared, hits, total, share = (F.col(f"_i_{x}") for x in ("exact", "second", "branded", "same", "shared", "hits", "total", "share"))
    say = lambda what, test: F.transform(F.filter("_i_gone", test), lambda x: F.concat(F.lit(f"{what}:"), x["group"], F.lit(":"), F.array_join(x["gone"], ",")))
    conflicts, lacks = say("attribute-conflict", lambda x: x["stated"]), say("attribute-missing", lambda x: ~x["stated"] & x["group"].isin(*CRITICAL))
    rivals = []
    for names in V.EXCLUSIVE:
        mine = F.get(F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(l["productFamilies"], n)), F.lit(0))
        wrong = F.filter(F.array(*map(F.lit, names)), lambda n: (n != mine) & F.array_contains(o["productFamilies"], n))  # noqa: B023
        rivals.append(F.when(mine.isNotNull() & (F.size(wrong) > 0), F.concat(F.lit("attribute-conflict:productFamilies:"), mine, F.lit("!="), F.array_join(wrong, ","))))
    rivals = F.when((F.size(l["productFamilies"]) > 0) & (F.size(o["productFamilies"]) > 0), F.array_compact(F.array(*rivals))).otherwise(_empty())
    structured = exact | branded | same | (shared > 0)
    weak = (~structured & ((hits < 3) | (share < 0.6))) | (structured & ~exact & ((hits < 2) | (share <= 0.5)) & (shared == 0))
    other_family = l["family"].isNotNull() & o["family"].isNotNull() & (l["family"] != o["family"])
    some = lambda test, text: F.when(test, F.array(text)).otherwise(_empty())
    reasons = F.array_distinct(
        F.concat(
            some(~sufficient(l), F.lit("insufficient-source-identity")),
            some(_accessory(l, o, exact, branded), F.lit("accessory-or-component")),
            F.when(F.size("_i_gone") > 0, conflicts).otherwise(_empty()), rivals, F.when(F.size("_i_gone") > 0, lacks).otherwise(_empty()),
            some(~exact & other_family, F.concat(F.lit("brand-mismatch:"), l["family"])),
            some(~exact & l["family"].isNull() & F.col("_i_credible") & ~branded, F.concat(F.lit("brand-mismatch:"), asks["brand"])),
            some(~exact & (l["kind"] != o["kind"]), F.concat(F.lit("kind-mismatch:"), l["kind"], F.lit(":"), o["kind"])),
            some(l["model"].isNotNull() & ~exact, F.concat(F.lit("model-mismatch:"), l["model"])),
            some(weak, F.concat(F.lit("weak-title-overlap:"), hits, F.lit("/"), total)),
        )
    )
    rows = rows.withColumn("_i_reasons", F.when(o["title"] == "", F.array(F.lit("empty-title"))).otherwise(reasons))
    score = F.when(exact, 5).otherwise(0) + F.when(second, 2).otherwise(0) + F.when(branded, 2).otherwise(0) + F.when(same, 2).otherwise(0) + shared + share * 4
    accepted = (F.size("_i_reasons") == 0) & (score > 0)
    evidence = F.concat(
        some(exact, F.concat(F.lit("model:"), l["model"])), some(second, F.concat(F.lit("model2:"), l["model2"])), some(branded, F.concat(F.lit("brand:"), F.coalesce(l["family"], asks["brand"]))),
        some(shared > 0, F.concat(F.lit("attributes:"), shared)), some(hits > 0, F.concat(F.lit("tokens:"), hits, F.lit("/"), total)), some(same, F.concat(F.lit("kind:"), l["kind"])),
    )
    long = asks["long"]
    plain = F.when(l["model"].isNotNull(), 5).otherwise(0) + F.when(second, 2).otherwise(0) + F.when((l["brand"] != "") & F.contains(title, asks["brand"]), 2).otherwise(0)
    plain = plain + F.coalesce(F.try_divide(F.size(F.filter(long, lambda t: F.contains(title, t))), F.size(long)), F.lit(0.0)) * 3
    hard = F.exists("_i_reasons", lambda r: r.rlike("^(?:accessory-or-component|attribute-conflict|attribute-missing|kind-mismatch|model-mismatch|brand-mismatch|empty-title)"))
    scored = F.when(accepted, score).otherwise(F.lit(0.0))
    result = F.struct(accepted.alias("accepted"), scored.alias("score"), F.col("_i_reasons").alias("reasons"), F.when(accepted, evidence).otherwise(_empty()).alias("evidence"), F.when(hard, F.lit(0.0)).otherwise(F.greatest(plain, scored)).alias("donor_score"))
    kept = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("_i_") and c != out]
    return rows.select(*kept, result.alias(out))
