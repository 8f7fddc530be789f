"""What a listing says: title prefixes, search phrases, labelled lines, condition, mixed lots, retail prices, currency.

Functions of a DataFrame keep intermediate results as columns (names begin with ``_l_``), so that a description is
read once however many questions are asked of it.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V
from .text import ascii_words, may_fit


def has(x: Column, pattern: str, lowered: Column | None = None) -> Column:
    """Whether the pattern occurs in x, whatever the case; false for null. ``lowered`` is x in lower case, where that is at hand."""
    return F.coalesce(may_fit(F.lower(x) if lowered is None else lowered, pattern) & x.rlike("(?i)" + ascii_words(pattern)), F.lit(False))


#: Fixed value: quotes, dashes and spaces that have plain forms.
SIGNS = "‘’ʼ′“”–—   "


def normalised(x: Column) -> Column:
    """x in plain signs: line ends as LF, quotes, dashes and special spaces as those of ASCII; null is empty."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n")
    return F.translate(x, SIGNS, "''''\"\"--   ")


def normalised_column(rows: DataFrame, name: str, x: Column) -> DataFrame:
    """rows with ``normalised`` of x as a column, where only texts that hold such signs are rewritten."""
    some = lambda signs: reduce(Column.__or__, (F.contains(F.col(name), F.lit(s)) for s in signs))
    rows = rows.withColumn(name, F.coalesce(x, F.lit(""))).withColumn(name, F.when(some("\r"), F.regexp_replace(name, "\r\n?", "\n")).otherwise(F.col(name)))
    return rows.withColumn(name, F.when((F.length(name) != F.octet_length(name)) & some(SIGNS), F.translate(name, SIGNS, "''''\"\"--   ")).otherwise(F.col(name)))


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s(?:\s+|(?<! ))", " "))  # single spaces stay as they are


def without_prefix(x: Column) -> Column:
    """A title without lot numbers, stock marks and condition in front, each taken away once, in this order."""
    for pattern in V.PREFIXES:
        x = F.regexp_replace(x, "(?i)" + pattern, "")
    return trimmed(x)


def trimmed(x: Column) -> Column:
    """x without white space of any kind at its ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


#: Fixed value: line ends that are no white space to patterns, but may stand behind their $.
LINE_ENDS = ("\u0085", "\u2028", "\u2029")
#: Fixed value: what is white space to patterns.
SPACES = tuple(" \t\n\x0b\f\r")


def ends_with(x: Column, signs: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.endswith(x, F.lit(s)) for s in signs))


def trimmed_ends(x: Column) -> Column:
    """``trimmed`` of a column, of which only the ends are looked at."""
    loose = reduce(Column.__or__, (F.startswith(x, F.lit(s)) for s in SPACES), ends_with(x, SPACES))
    return F.when(ends_with(x, LINE_ENDS), trimmed(x)).when(loose, F.trim(x, F.lit("".join(SPACES)))).otherwise(x)


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters that their decompositions begin with."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and base.isascii():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()


def _once(x: Column, f) -> Column:
    """f of x, where f uses x more than once and x is costly."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def research_query(title: Column) -> Column:
    """A search phrase from a title: lower-case words without marks, lot phrases and auction words, 120 signs at most.

    Titles that leave fewer than two words give their own first 120 signs.
    """
    return phrase_of(normalised(title))


#: Fixed value: of longer titles the beginning is tried first.
LONG = 300


def phrase_of(plain: Column) -> Column:
    """``research_query`` of a title in plain signs.

    The beginning of a long title decides its phrase if it begins with no lot number, holds no digit and no auction, which all
    that is taken out needs, and gives more than the phrase's signs before its last four words, which what follows may
    change. Otherwise the whole title is read.
    """
    whole = lambda x: _once(F.when(F.length(x) <= LONG, x).otherwise(_once(collapsed(F.left(x, F.lit(LONG))), lambda begun: F.when(_decides(begun), begun).otherwise(x))), collapsed)
    return _once(_once(plain, whole), _phrase)


def _decides(begun: Column) -> Column:
    enough = lambda words: F.length(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 4, F.lit(0))), " ")) >= 140
    return _once(F.lower(F.translate(begun, ACCENTED, PLAIN)), lambda x: ~x.rlike(r"^\s*lot|\d|auct") & _once(_phrase_words(x), enough))


def _phrase_words(x: Column) -> Column:
    """The words of a phrase without signs at their ends, and without those that say nothing."""
    return F.filter(F.regexp_extract_all(x, F.lit(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"), F.lit(0)), lambda t: ~t.isin("x", *V.QUERY_NOISE))


def _phrase(original: Column) -> Column:
    x = F.lower(F.translate(original, ACCENTED, PLAIN))
    x = F.regexp_replace(x, r"^\s*lot\s*#?\s*[\w-]+\s*[-:|]\s*", " ")
    x = F.regexp_replace(x, r"[()\[\]{}]", " ")
    for pattern in (r"\b(?:lot|pair|set|group)\s+of\s+\d+\b", r"\bx\s*\d+\b", r"\b\d+\s*pcs?\b", r"\b(?:online\s+)?auction\s+(?:item|lot)\b.*$"):
        x = F.regexp_replace(x, ascii_words(pattern), " ")
    x = F.regexp_replace(x, r"^\s*(?:av|inv(?:entory)?|sku)\s*[-:|]\s*", " ")
    shortened = lambda phrase: F.when(F.length(phrase) <= 120, phrase).otherwise(F.left(F.regexp_replace(F.left(phrase, F.lit(121)), r"\s+\S*$", ""), F.lit(120)))
    return _once(_phrase_words(x), lambda words: F.when(F.size(words) >= 2, _once(F.array_join(words, " "), shortened)).otherwise(F.left(original, F.lit(120))))


#: Fixed value: a line that says something under a name: name, sign, value.
LINE = r"^[ \t]*([^:?\n]{2,60}?)[ \t]*([:?])[ \t]*(.*)$"


def labelled_lines(text: Column) -> tuple[Column, Column]:
    """(map of what a description's labelled lines say, its other lines): of a repeated label the last line counts.

    A question without an answer is one of the other lines.
    """
    return labelled_in(normalised(text))


def labelled_in(plain: Column) -> tuple[Column, Column]:
    """``labelled_lines`` of a text in plain signs."""
    lines = F.split(plain, "\n")
    signed = lambda v: F.contains(v, F.lit(":")) | F.contains(v, F.lit("?"))  # noqa: E731  no other line can be a labelled one
    cut = lambda v, i: F.struct(v.alias("v"), i.alias("at"), *(F.when(signed(v), trimmed(F.regexp_extract(v, LINE, k))).otherwise("").alias(n) for k, n in ((1, "name"), (2, "sign"), (3, "answer"))))
    parsed = F.transform(lines, cut)  # every line is cut once
    says = lambda e: (e["name"] != "") & ((e["sign"] != "?") | (e["answer"] != ""))
    said = F.array_sort(F.transform(F.filter(parsed, says), lambda e: F.struct(collapsed(F.lower(e["name"])).alias("key"), e["at"].alias("at"), e["answer"].alias("value"))))
    later = F.concat(F.transform(F.slice(said, 2, F.greatest(F.size(said), F.lit(1))), lambda e: e["key"]), F.array(F.lit(None).cast("string")))
    last = F.filter(F.zip_with(said, later, lambda e, k: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.coalesce(k != e["key"], F.lit(True)).alias("last"))), lambda e: e["key"].isNotNull() & e["last"])
    free = F.array_join(F.transform(F.filter(parsed, lambda e: (trimmed(e["v"]) != "") & ~says(e)), lambda e: e["v"]), "\n")
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))), trimmed(free)


def first_present(fields: Column, names: list[str]) -> Column:
    """What the first of the labels that occurs says; null if none does."""
    return F.coalesce(*(fields[n] for n in names))


def yes_no(x: Column) -> Column:
    """True, false, or null where an answer is neither."""
    v = F.lower(trimmed(x))
    yes = v.rlike(ascii_words(r"^(?:y|yes|true|1)$|^yes\b"))
    no = v.rlike(ascii_words(r"^(?:n|no|false|0|none)$|^no\b"))
    return F.when(v.rlike(V.UNSURE), F.lit(None).cast("boolean")).when(yes, True).when(no, False)


def _some(*parts: Column) -> Column:
    """An array of the parts that are not null."""
    return F.array_compact(F.array(*parts))


def _joined(sep: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda p: p != ""), sep)


def _found(x: Column, patterns: dict[str, str]) -> Column:
    return _once(x, lambda text: _once(F.lower(text), lambda lowered: _some(*(F.when(has(text, p, lowered), F.lit(label)) for label, p in patterns.items()))))


def assessed(rows: DataFrame, text: str, out: str = "condition") -> DataFrame:
    """rows with struct(parts_only, parts_reasons, damaged, damage_reasons, cautions, positive, condition, fields, free_text).

    Answers of labelled lines count, their questions do not; a null text says nothing.
    """
    fields, free = labelled_lines(F.col(text))
    rows = rows.withColumns({"_l_fields": fields, "_l_free": free})
    say = lambda names: F.coalesce(first_present(F.col("_l_fields"), names), F.lit(""))
    ask = lambda names: yes_no(first_present(F.col("_l_fields"), names))
    rows = rows.withColumns(
        {
            "_l_condition": say(["condition"]), "_l_damage": say(V.DAMAGE_TEXT), "_l_missing": say(V.MISSING_TEXT), "_l_notes": _joined(" ", F.col("_l_fields")["notes"], F.col("_l_fields")["note"]),
            "_l_damaged": ask(V.DAMAGED), "_l_lacks": ask(V.MISSING), "_l_works": ask(V.FUNCTIONAL),
        }
    )
    condition, free = F.col("_l_condition"), F.col("_l_free")
    rows = rows.withColumns({"_l_good": has(condition, V.GOOD) & ~has(condition, V.PARTS), "_l_evidence": _joined("\n", F.col("_l_damage"), F.col("_l_missing"), F.col("_l_notes"), free)})
    parts = F.concat(_some(F.when(has(condition, V.PARTS), F.concat(F.lit("Condition: "), trimmed(condition)))), _found(F.col("_l_evidence"), V.PARTS_REASONS))
    stated = _some(
        F.when(F.col("_l_damaged"), F.when(F.col("_l_damage") != "", F.concat(F.lit('auctioneer reports damage: "'), trimmed(F.col("_l_damage")), F.lit('"'))).otherwise("structured field: Is Item Damaged? = Yes")),
        F.when(F.col("_l_lacks"), F.when(F.col("_l_missing") != "", F.concat(F.lit('parts missing: "'), trimmed(F.col("_l_missing")), F.lit('"'))).otherwise("structured field: Missing Major Parts? = Yes")),
    )
    rows = rows.withColumns({"_l_parts": F.array_distinct(parts), "_l_stated": stated})
    broken = (~F.col("_l_works")) & ((F.size("_l_stated") > 0) | (F.size("_l_parts") > 0) | ~F.col("_l_good"))
    positive = has(condition, V.GOOD) | has(F.concat_ws("\n", "_l_notes", "_l_free"), V.POSITIVE) | F.coalesce(F.col("_l_works"), F.lit(False))
    rows = rows.withColumns({"_l_reasons": F.concat("_l_stated", _some(F.when(broken, F.lit("structured field: Is Item Functional? = No")))), "_l_positive": positive, "_l_only": F.size("_l_parts") > 0})
    cautions = _found(_joined("\n", condition, F.col("_l_evidence")), V.CAUTIONS)
    cautions = F.when(F.col("_l_positive"), F.filter(cautions, lambda c: ~c.isin("untested", "not tested", "used"))).otherwise(cautions)
    odd = (condition != "") & ~F.col("_l_good") & ~has(condition, V.PARTS)
    cautions = F.concat(_some(F.when(odd, F.concat(F.lit("condition: "), F.lower(trimmed(condition))))), cautions)
    softened = (F.size("_l_reasons") > 0) & (F.col("_l_good") | F.col("_l_only"))
    cautions = F.array_distinct(F.when(softened, F.concat("_l_reasons", cautions)).otherwise(cautions))
    damaged = ~F.col("_l_only") & (F.size("_l_reasons") > 0) & ~F.col("_l_good")
    result = F.struct(
        F.col("_l_only").alias("parts_only"), F.col("_l_parts").alias("parts_reasons"), damaged.alias("damaged"), F.when(damaged, F.array_distinct("_l_reasons")).otherwise(F.array().cast("array<string>")).alias("damage_reasons"),
        cautions.alias("cautions"), F.col("_l_positive").alias("positive"), condition.alias("condition"), F.col("_l_fields").alias("fields"), free.alias("free_text"),
    )
    kept = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("_l_") and c != out]
    return rows.select(*kept, result.alias(out))


def mixed_lot(title: Column, description: Column) -> Column:
    """struct(mixed, reasons, components): whether a lot is of several goods, why, and the parts of its text that may name them."""
    texts = _once(F.struct(normalised(title).alias("title"), normalised(description).alias("description")), lambda x: F.struct(x["title"].alias("title"), x["description"].alias("description"), F.lower(x["title"]).alias("low_title"), F.lower(x["description"]).alias("low_description")))
    return _once(texts, lambda x: _once(_some(*(F.when(has(x[where], p, x[f"low_{where}"]), F.lit(why)) for where, p, why in V.MIXED)), lambda reasons: _mixed(x["title"], x["description"], reasons)))


def _mixed(title: Column, description: Column, reasons: Column) -> Column:
    parts = F.split(_joined("\n", title, labelled_lines(description)[1]), r"\n|;|\s+-\s+|\s*•\s*")
    parts = F.transform(parts, lambda p: trimmed(F.regexp_replace(p, r"(?i)^\s*(?:retail|msrp|value)\s*[:\-]?\s*\$?[\d,.]+\s*\|?\s*", "")))
    parts = F.filter(parts, lambda p: (F.length(p) >= 3) & ~p.rlike("(?i)" + ascii_words(r"^(?:untested|tested|working|condition\b|notes?\b)|^group\s+of\s+\d+$")))
    some = F.size(reasons) > 0
    return F.struct(some.alias("mixed"), reasons.alias("reasons"), F.when(some, F.array_distinct(parts)).otherwise(F.array().cast("array<string>")).alias("components"))


def _amount(x: Column) -> Column:
    value = F.replace(x, F.lit(","), F.lit("")).try_cast("double")
    return F.when(value > 0, value)


def stated_retail(lead: Column, description: Column, estimate: Column) -> Column:
    """The retail price that a listing states: the first pattern that gives one, else the highest number of the estimate."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(estimate, F.lit("")), F.lit(r"[\d,]+(?:\.\d{1,2})?"), F.lit(0)), _amount)
    stated = _once(normalised(_joined("\n", lead, description)), lambda text: _once(F.lower(text), lambda lowered: F.coalesce(*(F.when(may_fit(lowered, p), _once(F.regexp_extract(text, ascii_words(p), 1), _amount)) for p in V.RETAIL))))
    return F.coalesce(stated, F.array_max(F.array_compact(numbers)))


def comparison_currency(raw: Column, premium: Column) -> Column:
    """CAD where the text or the premium names Canadian dollars, else USD."""
    said = F.concat_ws(" ", F.coalesce(raw, F.lit("")), F.coalesce(premium, F.lit("")))
    return F.when(said.rlike(ascii_words(V.CAD[0])) | said.rlike(ascii_words(V.CAD[1])), "CAD").otherwise("USD")


def needs_quantity(quantity: Column, mixed: Column, confirmed: Column) -> Column:
    """Whether a lot of several pieces, or a mixed one, has no confirmed quantity of one or more."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return (F.coalesce(finite(quantity) & (quantity > 1), F.lit(False)) | F.coalesce(mixed, F.lit(False))) & ~F.coalesce(finite(confirmed) & (confirmed >= 1), F.lit(False))


def description_labels(description: Column) -> Column:
    """Map of what a description says under the labels of the catalogue, wherever they begin a line or a part after a bar."""
    found = [F.struct(F.lit(n).alias("key"), trimmed(F.regexp_extract(description, r"(?i)(?:^|\n|\|)\s*" + n.replace("?", r"\?") + r"\s*:?\s*([^\n|]+)", 1)).alias("value")) for n in V.LABELS]
    return F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"] != ""))


# The rates of a premium that are believed, and the sizes that titles and descriptions name.
LEAST_RATE, MOST_RATE, SIZE = 0, 30, r"\bsize:?\s*(xs|s|m|l|xl|xxl)\b"


def stated_premium(text: Column) -> Column:
    """The highest buyer's premium from 0 to 30 % that a text states in a sentence about premiums; null if none."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s"), lambda s: F.lower(s).contains("premium"))
    rates = F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1))))
    return F.array_max(F.filter(F.transform(rates, lambda r: r.cast("double")), lambda r: r.between(LEAST_RATE, MOST_RATE)))


def size_conflict(title: Column, description: Column) -> Column:
    """Whether title and description both name sizes and none of them is the same."""
    sizes = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(SIZE), F.lit(1)))
    a, b = sizes(title), sizes(description)
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) == 0)
