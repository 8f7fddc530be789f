"""Text, markup and identity expressions over listing titles and descriptions."""

from __future__ import annotations

from functools import cache, reduce
from re import _constants as C
from re import _parser, error, escape
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary on ASCII letters, digits and underscore only, whatever the engine thinks of accents.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


#: The same where the next sign, or the one before, is known to be of a word; to the engine \w is ASCII, and one test instead of four.
BEGIN, END = r"(?<!\w)", r"(?!\w)"


def _of_words(op, arg) -> bool:
    """Whether a sign of a pattern is an ASCII letter, digit or underscore, whatever it fits."""
    if op is C.LITERAL:
        return arg < 128 and (chr(arg).isalnum() or chr(arg) == "_")
    if op is C.RANGE:
        return any(low <= arg[0] and arg[1] <= high for low, high in ((48, 57), (65, 90), (97, 122)))
    return op is C.CATEGORY and arg in (C.CATEGORY_DIGIT, C.CATEGORY_WORD)


def _edge_of_words(parsed, way: int) -> bool:
    """Whether all that a pattern fits begins (way 1) or ends (-1) with a sign of a word; False where that is not certain."""
    for op, arg in list(parsed)[::way]:
        if op is C.SUBPATTERN:
            return _edge_of_words(arg[3], way)
        if op is C.BRANCH:
            return all(_edge_of_words(x, way) for x in arg[1])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            if not _edge_of_words(arg[2], way):
                return False
            if arg[0] == 0:  # may be absent: what follows must be of a word too
                continue
            return True
        return all(_of_words(*x) for x in arg) if op is C.IN else _of_words(op, arg)
    return False


@cache
def ascii_words(pattern: str) -> str:
    """The pattern with each \\b on ASCII words; at its ends by one look instead of four, where what stands inside is of a word."""
    flags, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    begin = end = ""
    if bare.startswith(r"\b") or bare.endswith(r"\b"):
        try:
            parsed = list(_parser.parse(bare))
        except error:  # signs that only the other engine knows
            parsed = []
        border = (C.AT, C.AT_BOUNDARY)
        if bare.startswith(r"\b") and parsed[:1] == [border] and _edge_of_words(parsed[1:], 1):
            begin, bare = BEGIN, bare[2:]
        if bare.endswith(r"\b") and parsed[-1:] == [border] and _edge_of_words(parsed[:-1], -1):
            end, bare = END, bare[:-2]
    return flags + begin + bare.replace(r"\b", B) + end


def _best(sets: list[frozenset[str]]) -> list[frozenset[str]]:
    """The set whose shortest literal is longest, of these the smallest."""
    return sorted(sets, key=lambda s: (-min(map(len, s)), len(s)))[:1]


def _lead(parsed) -> str:
    """The literal that a pattern begins with."""
    lead = ""
    for op, arg in parsed:
        if op is not C.LITERAL:
            break
        lead += chr(arg).lower()
    return lead


def _needed(parsed) -> list[frozenset[str]]:
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is C.LITERAL:
            run += chr(arg).lower()
            continue
        if run:  # alternatives with a common beginning are parsed as that and their rests
            found.append(frozenset(run + _lead(way) for way in arg[1]) if op is C.BRANCH else frozenset([run]))
        run = ""
        if op is C.SUBPATTERN:
            found += _needed(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            found += _needed(arg[2])
        elif op is C.BRANCH:
            ways = [_needed(way) for way in arg[1]]
            found += [frozenset().union(*(w[0] for w in ways))] if all(ways) else []
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            found.append(frozenset(chr(a).lower() for _, a in arg))
    return _best(found)


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every text that the pattern fits holds one, whatever the case; none if there are no such literals."""
    return tuple(sorted(*_needed(_parser.parse(pattern)))) if _needed(_parser.parse(pattern)) else ()


@cache
def _loose(pattern: str) -> str | None:
    """For patterns that begin with a number: what fits wherever they do, and is tried at digits only."""
    return pattern.replace(r"\b", "") if pattern.startswith(r"\b(\d") and "(?!" not in pattern and "(?<" not in pattern else None


def _of_digits(op, arg) -> bool:
    """Whether a sign of a pattern is an ASCII digit, whatever it fits."""
    if op is C.LITERAL:
        return 48 <= arg <= 57
    if op is C.RANGE:
        return 48 <= arg[0] and arg[1] <= 57
    return all(_of_digits(*x) for x in arg) if op is C.IN else op is C.CATEGORY and arg is C.CATEGORY_DIGIT


def _numbered(parsed) -> bool:
    for op, arg in parsed:
        if op is C.SUBPATTERN:
            found = _numbered(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            found = arg[0] > 0 and _numbered(arg[2])
        else:
            found = all(_numbered(way) for way in arg[1]) if op is C.BRANCH else _of_digits(op, arg)
        if found:
            return True
    return False


@cache
def numbered(pattern: str) -> bool:
    """Whether all that the pattern fits holds a digit; False where that is not certain."""
    return _numbered(_parser.parse(pattern))


def _begun(parsed) -> set[str] | None:
    """Literals of which all that is parsed, if it stands at the beginning of a word, begins with one; None if that is not certain."""
    found: set[str] = set()
    for k, (op, arg) in enumerate(parsed):
        if op is C.LITERAL:
            lead = _lead(parsed[k:])
            after = parsed[k + len(lead) :]
            ways = after[0][1][1] if after and after[0][0] is C.BRANCH else [[]]
            return found | {lead + _lead(way) for way in ways}
        optional = op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == 0
        ways = [arg[3]] if op is C.SUBPATTERN else arg[1] if op is C.BRANCH else [arg[2]] if op in (C.MAX_REPEAT, C.MIN_REPEAT) else []
        begun = [_begun(list(way)) for way in ways]
        if not begun or None in begun:
            return None
        found = found.union(*begun)
        if not optional:
            return found
    return None


@cache
def begins(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which one stands at the beginning of an ASCII word in every text that the pattern fits; none if there are no such literals of two signs or more."""
    parsed = list(_parser.parse(pattern))
    found = _begun(parsed[1:]) if parsed[:1] == [(C.AT, C.AT_BOUNDARY)] else None
    return tuple(sorted(found)) if found and all(len(x) > 1 and _of_words(C.LITERAL, ord(x[0])) for x in found) else ()


@cache
def roots(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """Of the literals that words begin with where the patterns fit, those that begin with no other one."""
    literals = {x for p in patterns for x in begins(p)}
    return tuple(sorted(x for x in literals if not any(x != y and x.startswith(y) for y in literals)))


def _tree(words: list[str], most: int = 5) -> str:
    """A pattern that fits any of the words, of which none begins with another: what they begin with is tried once, and by sets of signs where these are many."""
    rests: dict[str, list[str]] = {}
    for w in words:
        rests.setdefault(w[0], []).append(w[1:])
    ways = [escape(c) + (_tree(rest) if any(rest) else "") for c, rest in rests.items()]
    if len(ways) > most:
        signs = list(rests)
        ways = [f"(?=[{''.join(map(escape, signs[k : k + most]))}])(?:{'|'.join(ways[k : k + most])})" for k in range(0, len(ways), most)]
    return "(?:" + "|".join(ways) + ")"


def held(lowered: Column, literals: tuple[str, ...]) -> Column:
    """Which of the literals (none begins with another) ASCII words of a lower-cased text begin with, all found in one pass."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(BEGIN + f"(?=({_tree(list(literals))}))"), F.lit(1)))


class Read(NamedTuple):
    """A lower-cased text, and what was read off it once for many patterns: columns, so that it is not done for each."""

    text: Column
    #: The text if it holds a digit, else empty: for patterns that need one.
    numbers: Column
    #: Which of the literals its words begin with.
    held: Column
    literals: tuple[str, ...]


def source(lowered: Column | Read, pattern: str) -> Column:
    """Where a pattern is looked for."""
    if isinstance(lowered, Read):
        return lowered.numbers if numbered(pattern) else lowered.text
    return lowered


def may_fit(lowered: Column | Read, pattern: str) -> Column:
    """Whether the pattern may fit a lower-cased text, by a cheap test: never false where it does fit."""
    begun = {x: [r for r in lowered.literals if x.startswith(r)] for x in begins(pattern)} if isinstance(lowered, Read) else {}
    first = reduce(Column.__or__, (F.array_contains(lowered.held, r) for r in sorted({r for found in begun.values() for r in found}))) if begun and all(begun.values()) else None
    literals, lowered = needed(pattern), source(lowered, pattern)
    test = reduce(Column.__or__, (F.contains(lowered, F.lit(x)) for x in literals)) if literals else F.lit(True)
    test = test if first is None else first & test
    loose = _loose(pattern)
    return test & lowered.rlike(loose) if loose and min(map(len, literals), default=0) < 3 else test


def fits(lowered: Column | Read, pattern: str) -> Column:
    """Whether the pattern occurs in a lower-cased text, with each \\b on ASCII words."""
    return may_fit(lowered, pattern) & source(lowered, pattern).rlike(ascii_words(pattern))


def squeezed(x: Column) -> Column:
    """White space, no-break spaces included, to single spaces, and trimmed."""
    return F.trim(F.regexp_replace(x, r"[\s\x{00A0}]+", " "))


def typographic(x: Column) -> Column:
    """Curly quotes, dashes and no-break spaces to their plain forms; CRLF to LF."""
    return F.regexp_replace(F.translate(x, "‘’“”–— ", "''\"\"-- "), "\r\n?", "\n")


def compact_tokens(x: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: t != "")


#: What stands between the words of a name.
BETWEEN = r"[\s,;/]+"


def bare_tokens(words: Column) -> Column:
    """Words trimmed of signs, but of + . - only in front; those of signs alone are left out."""
    return F.filter(F.transform(words, lambda t: F.regexp_extract(t, r"(?s)[A-Za-z0-9](?:.*[A-Za-z0-9+.\-])?", 0)), lambda t: t != "")


def identity_tokens(x: Column) -> Column:
    """Tokens between spaces, commas, semicolons and slashes, trimmed of other signs but + . - at the end."""
    return bare_tokens(F.split(x, BETWEEN))


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def csv_cell(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def escaped_html(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def unescaped_html(x: Column) -> Column:
    """The named references of listing pages to their characters, & last but for what it yields."""
    for name, sign in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def visible_text(x: Column) -> Column:
    """Page text by patterns: without scripts, styles, comments and tags; block ends become line ends."""
    x = F.regexp_replace(x, r"(?is)<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)\s*>", "\n")
    return squeezed(unescaped_html(F.regexp_replace(x, r"<[^>]*>", " ")))


def first_fit(x: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that occurs in x, whatever the case; null if none does."""
    return F.coalesce(*(F.when(may_fit(F.lower(x), p) & x.rlike("(?i)" + ascii_words(p)), name) for name, p in patterns))


def all_fits(x: Column, patterns: dict[str, str]) -> Column:
    """The names of all patterns that occur in x, in order."""
    return F.array_compact(F.array(*(F.when(may_fit(F.lower(x), p) & x.rlike("(?i)" + ascii_words(p)), name) for name, p in patterns.items())))
