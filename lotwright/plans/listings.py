"""Queries about listings: over all parts, each under one of the titles and descriptions below, and (as ``…_all``) over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import identity as I
from lotwright.functions import listing as L
from lotwright.functions import values as V
from lotwright.operators import match
from lotwright.sources.shared import written

from .registry import query, spread, table

TITLES = [
    "Lot 41 | Apple iPhone 15 Pro Max 256GB Phone", "Corsair Vengeance DDR5 32GB 6000MHz Memory Kit", "Samsung 27 inch 1440p 144Hz Monitor", "AV - PLAYSTATION 5 CONSOLE", "DeWalt 20V 5Ah Cordless Impact Driver",
    "Canon RF 24-70mm Camera Lens", "ASUS GeForce RTX 4070 Graphics Card", "AMD Ryzen 7 5800X Processor", "Onkyo TX-SR304 Multi-Channel AV Receiver", "RODE NT-USB+ USB CONDENSER MICROPHONE", "$650 | CORSAIR Vengeance 2x16GB",
    "Brand New: Pampers Swaddlers Newborn Diapers, 84 ct", "Group of 3 - Sony WH-1000XM4 - Bose speakers", "Lot of assorted cables x 12", "SKU #77: Used - Café crème maker, 5 quarts", "ZMOWIPDL 6x12oz Clear Blue Hobnail Glass Cups Set",
    "JISULIFE Neck Fan - 4000mAh, USB, 3 Speeds", "Rack with mixed items", "ORICO 9-in-1 USB-C Hub with NVMe Enclosure", "Retail: $120 | Leather sofa grey", "  ", "NERF Mega Ball outdoor toy online auction lot 12",
    "Protective case for Onkyo TX-SR304 receiver",
]
DESCRIPTIONS = [
    "Condition: BRAND NEW - OPEN BOX\nModel: NT-USB+\nIs Item Functional? Yes\nIs Item Damaged? No\nMissing Major Parts? No", "Condition: FAIR\nIs Item Damaged? Yes\nDamage Desct: Fully stained\nworn", "Condition: FOR PARTS ONLY\nIs Item Damaged? No",
    "Est. Retail Price: 251.00\r\nBrand: Acme\r\nModel: AB-12\r\nmodel: AB-13", "untested, as is no returns; cracked", "Retail $1,299.99\nHigh Bid: 20.00 CAD", "MSRP 89\nHigh Bid: 20.00 Can", "", "Is Item Functional? No\nWhy?\nused - returned, assorted items",
    "Condition: EXCELLENT\nIs Item Functional? N/A\nNotes: tested and working", "Missing parts? yes\nMissing parts desc: lid",
]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, description: every part under one of the titles, and one of the descriptions."""
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts) + 1).cast("int"))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("id"), F.concat(pick(TITLES), F.lit(" "), F.col("p_name")).alias("title"), pick(DESCRIPTIONS).alias("description"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a listing: its text is title and description."""
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return texts.select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("text").alias("description"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


def _sql_pick(texts: list[str]) -> str:
    return f"list_extract([{', '.join(map(_sql_text, texts))}], CAST(p_partkey % {len(texts)} + 1 AS INT))"


PARTS_SQL = f"listings AS (SELECT p_partkey AS id, {_sql_pick(TITLES)} || ' ' || p_name AS title, {_sql_pick(DESCRIPTIONS)} AS description FROM part)"
DOCUMENTS_SQL = "listings AS (SELECT doc_id AS id, text AS title, text AS description FROM documents)"


def listing_query(sql: str | None = None) -> Callable:
    """Registers a function of rows (id, title, description) over all parts, and over all documents as name_all; ``sql`` reads ``listings``."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        for name, source, cte in ((f.__name__, listings, PARTS_SQL), (f"{f.__name__}_all", documents, DOCUMENTS_SQL)):
            run = lambda spark, sf_dir, source=source: f(source(spark, sf_dir))
            run.__name__ = name
            query(f"WITH {cte}{sql}" if sql else None)(run)
        return f

    return add


def plain(x: str) -> str:
    """SQL of x in plain signs."""
    return f"translate(regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g'), '‘’ʼ′“”–—' || chr(160) || chr(8199) || chr(8239), repeat('''', 4) || '\"\"--   ')"


def flags(x: str, patterns: dict[str, str]) -> str:
    """SQL of the array of names whose pattern occurs in x."""
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '{p}', 'i') THEN '{n}' END" for n, p in patterns.items()) + "], lambda f: f IS NOT NULL)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@listing_query(f" SELECT id, CASE {' '.join(f"WHEN regexp_matches(lower({plain('title')}), '{p}') THEN '{n}'" for n, p in V.KINDS.items())} END AS kind FROM listings")
def q_kind(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("t", F.lower(L.normalised(F.col("title"))))  # once, and not for each literal
    return rows.select("id", I.kind_of(F.col("t")).alias("kind"))


#: Groups whose patterns DuckDB can read too (no lookarounds).
SIMPLE = ["resolutions", "memoryTypes", "frequencies", "refreshRates", "storageTypes", "networkStandards", "editions", "voltages", "wattages", "batteryCapacities", "packageCounts", "variantLabels", "volumes", "modeCounts", "featureCounts"]


def _rules_sql(group: str) -> str:
    one = lambda p, form: f"list_transform(regexp_extract_all(t, '{p}'), lambda m: " + (f"regexp_replace(m, '{p}', '{form.replace('$', chr(92))}')" if "$" in form else f"'{form}'") + ")"
    return f"list_sort(list_distinct(flatten([{', '.join(one(p, form) for p, form in I.RULES[group])}]))) AS {group}"


@listing_query(f""", n AS (SELECT id, lower({plain('title')}) AS t FROM listings),
w AS (SELECT *, {flags('t', V.FAMILIES)} AS f, list_distinct(list_transform({flags('t', {c: f'{chr(92)}b{c}{chr(92)}b' for c in V.COLORS})}, lambda c: CASE WHEN c = 'gray' THEN 'grey' ELSE c END)) AS c FROM n)
SELECT id, {', '.join(map(_rules_sql, SIMPLE))}, list_sort({flags('t', V.MATERIALS)}) AS materials,
       list_sort(CASE WHEN len(c) > 1 THEN list_filter(c, lambda x: x <> 'clear') ELSE c END) AS colors,
       list_sort(CASE WHEN regexp_matches(t, '\\bballs?\\b') AND NOT list_has_any(f, ['kickball', 'football', 'soccer-ball', 'bounce-ball']) THEN list_append(f, 'other-ball') ELSE f END) AS "productFamilies"
FROM w""")
def q_discriminators(rows: DataFrame) -> DataFrame:
    found = I.attributes_of(F.col("t"))
    return rows.withColumn("t", F.lower(L.normalised(F.col("title")))).select("id", *(found[g].alias(g) for g in (*SIMPLE, "materials", "colors", "productFamilies")))


@listing_query()
def q_discriminators_rest(rows: DataFrame) -> DataFrame:
    """The groups whose patterns look around their matches; tested on titles with known outcomes."""
    found = I.attributes_of(F.col("t"))
    return rows.withColumn("t", F.lower(L.normalised(F.col("title")))).select("id", *(found[g].alias(g) for g in I.GROUPS if g not in (*SIMPLE, "materials", "colors", "productFamilies")))


#: Labelled lines (k: id, key, value of the last one) and other lines (r: id, free).
_LINES_SQL = f""", l AS (SELECT id, unnest(string_split({plain('description')}, chr(10))) AS line, generate_subscripts(string_split({plain('description')}, chr(10)), 1) AS pos FROM listings),
x AS (SELECT id, pos, line, {strip("regexp_extract(line, '^[ \\t]*([^:?\\n]{2,60}?)[ \\t]*([:?])[ \\t]*(.*)$', 1)")} AS name, regexp_extract(line, '^[ \\t]*([^:?\\n]{{2,60}}?)[ \\t]*([:?])[ \\t]*(.*)$', 2) AS sign, {strip("regexp_extract(line, '^[ \\t]*([^:?\\n]{2,60}?)[ \\t]*([:?])[ \\t]*(.*)$', 3)")} AS answer FROM l),
s AS (SELECT *, name <> '' AND (sign <> '?' OR answer <> '') AS says FROM x),
k AS (SELECT id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS key, arg_max(answer, pos) AS value FROM s WHERE says GROUP BY ALL),
r AS (SELECT id, {strip("string_agg(line, chr(10) ORDER BY pos)")} AS free FROM s WHERE NOT says AND {strip('line')} <> '' GROUP BY id)"""


@listing_query(f"{_LINES_SQL} SELECT id, key, value FROM k")
def q_structured_desc(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.explode(L.labelled_lines(F.col("description"))[0]))


def _yes_sql(x: str) -> str:
    v = f"lower({strip(x)})"
    return f"CASE WHEN regexp_matches({v}, '{V.UNSURE}') THEN NULL WHEN regexp_matches({v}, '^(?:y|yes|true|1)$|^yes\\b') THEN true WHEN regexp_matches({v}, '^(?:n|no|false|0|none)$|^no\\b') THEN false END"


@listing_query(f"{_LINES_SQL} SELECT i.id, key, {_yes_sql('value')} AS said FROM listings i LEFT JOIN k ON k.id = i.id AND key IN ('is item functional', 'is item damaged', 'missing parts')")
def q_tristate(rows: DataFrame) -> DataFrame:
    said = rows.select("id", F.explode_outer(F.map_filter(L.labelled_lines(F.col("description"))[0], lambda k, v: k.isin("is item functional", "is item damaged", "missing parts"))))
    return said.select("id", "key", L.yes_no(F.col("value")).alias("said"))


def _say_sql(names: list[str]) -> str:
    return "coalesce(" + ", ".join(f"m['{n}']" for n in names) + ")"


_AND_SQL = lambda *xs: "array_to_string(list_filter([" + ", ".join(f"coalesce({x}, '')" for x in xs) + "], lambda p: p <> ''), chr(10))"
_HAS_SQL = lambda x, p: f"regexp_matches({x}, '{p}', 'i')"


@listing_query(f"""{_LINES_SQL},
m AS (SELECT i.id, coalesce(map_from_entries(list(struct_pack(k := key, v := value)) FILTER (WHERE key IS NOT NULL)), MAP {{}}) AS m, coalesce(any_value(free), '') AS free FROM listings i LEFT JOIN k ON k.id = i.id LEFT JOIN r ON r.id = i.id GROUP BY i.id),
a AS (SELECT id, free, coalesce(m['condition'], '') AS c, coalesce({_say_sql(V.DAMAGE_TEXT)}, '') AS damage, coalesce({_say_sql(V.MISSING_TEXT)}, '') AS lack,
             array_to_string(list_filter([coalesce(m['notes'], ''), coalesce(m['note'], '')], lambda p: p <> ''), ' ') AS notes,
             {_yes_sql(_say_sql(V.DAMAGED))} AS damaged, {_yes_sql(_say_sql(V.MISSING))} AS lacks, {_yes_sql(_say_sql(V.FUNCTIONAL))} AS works FROM m),
b AS (SELECT *, {_HAS_SQL('c', V.GOOD)} AND NOT {_HAS_SQL('c', V.PARTS)} AS good, {_AND_SQL('damage', 'lack', 'notes', 'free')} AS evidence, {_AND_SQL('c', 'damage', 'lack', 'notes', 'free')} AS scan FROM a),
d AS (SELECT *, list_concat(CASE WHEN {_HAS_SQL('c', V.PARTS)} THEN ['Condition: ' || {strip('c')}] ELSE [] END, {flags('evidence', V.PARTS_REASONS)}) AS parts,
             list_filter([CASE WHEN damaged THEN CASE WHEN damage <> '' THEN 'auctioneer reports damage: "' || {strip('damage')} || '"' ELSE 'structured field: Is Item Damaged? = Yes' END END,
                          CASE WHEN lacks THEN CASE WHEN lack <> '' THEN 'parts missing: "' || {strip('lack')} || '"' ELSE 'structured field: Missing Major Parts? = Yes' END END], lambda x: x IS NOT NULL) AS stated,
             {_HAS_SQL('c', V.GOOD)} OR {_HAS_SQL("notes || chr(10) || free", V.POSITIVE)} OR coalesce(works, false) AS positive FROM b),
e AS (SELECT *, CASE WHEN NOT works AND (len(stated) > 0 OR len(parts) > 0 OR NOT good) THEN list_append(stated, 'structured field: Is Item Functional? = No') ELSE stated END AS reasons,
             list_concat(CASE WHEN c <> '' AND NOT good AND NOT {_HAS_SQL('c', V.PARTS)} THEN ['condition: ' || lower({strip('c')})] ELSE [] END,
                         list_filter({flags('scan', V.CAUTIONS)}, lambda x: NOT (positive AND x IN ('untested', 'not tested', 'used')))) AS cautions FROM d)
SELECT id, len(parts) > 0 AS parts_only, parts AS parts_reasons, len(parts) = 0 AND len(reasons) > 0 AND NOT good AS damaged, positive,
       CASE WHEN len(reasons) > 0 AND (good OR len(parts) > 0) THEN list_concat(reasons, cautions) ELSE cautions END AS cautions FROM e""")
def q_cautions(rows: DataFrame) -> DataFrame:
    return L.assessed(rows, "description").select("id", "condition.parts_only", "condition.parts_reasons", "condition.damaged", "condition.positive", "condition.cautions")


@listing_query(f" SELECT id, CASE WHEN regexp_matches(coalesce(description, '') || ' ', '{V.CAD[0]}') OR regexp_matches(coalesce(description, '') || ' ', '{V.CAD[1]}') THEN 'CAD' ELSE 'USD' END AS currency FROM listings")
def q_currency(rows: DataFrame) -> DataFrame:
    return rows.select("id", L.comparison_currency(F.col("description"), F.lit(None).cast("string")).alias("currency"))


@listing_query(f"""{_LINES_SQL},
t AS (SELECT i.id, {plain('title')} AS t, {plain('description')} AS d, free FROM listings i LEFT JOIN r ON r.id = i.id),
q AS (SELECT id, list_filter([{', '.join(f"CASE WHEN regexp_matches({'t' if w == 'title' else 'd'}, '{p}', 'i') THEN '{why}' END" for w, p, why in V.MIXED)}], lambda x: x IS NOT NULL) AS reasons, {_AND_SQL('t', 'free')} AS whole FROM t),
p AS (SELECT id, unnest(string_split_regex(whole, '\\n|;|\\s+-\\s+|\\s*•\\s*')) AS part FROM q WHERE len(reasons) > 0),
o AS (SELECT id, count(DISTINCT part) AS components FROM (SELECT id, {strip("regexp_replace(part, '(?i)^\\s*(?:retail|msrp|value)\\s*[:\\-]?\\s*\\$?[\\d,.]+\\s*\\|?\\s*', '')")} AS part FROM p)
      WHERE length(part) >= 3 AND NOT regexp_matches(part, '(?i)^(?:untested|tested|working|condition\\b|notes?\\b)|^group\\s+of\\s+\\d+$') GROUP BY id)
SELECT q.id, len(reasons) > 0 AS mixed, reasons, coalesce(components, 0) AS components FROM q LEFT JOIN o ON o.id = q.id""")
def q_mixed_lot(rows: DataFrame) -> DataFrame:
    rows = rows.select("id", L.mixed_lot(F.col("title"), F.col("description")).alias("m"))
    return rows.select("id", "m.mixed", "m.reasons", F.size("m.components").cast("long").alias("components"))


def _amount_sql(x: str) -> str:
    return f"CASE WHEN TRY_CAST(replace({x}, ',', '') AS DOUBLE) > 0 THEN TRY_CAST(replace({x}, ',', '') AS DOUBLE) END"


@listing_query(f", h AS (SELECT id, {plain(_AND_SQL('title', 'description'))} AS h, title FROM listings) SELECT id, coalesce({', '.join(_amount_sql(f"regexp_extract(h, '{p}', 1)") for p in V.RETAIL)}) AS stated FROM h")
def q_stated_retail(rows: DataFrame) -> DataFrame:
    return rows.select("id", L.stated_retail(F.col("title"), F.col("description"), F.lit(None).cast("string")).alias("stated"))


@listing_query(f" SELECT id, {strip(f"regexp_replace(regexp_replace(regexp_replace(title, '{V.PREFIXES[0]}', '', 'i'), '{V.PREFIXES[1]}', '', 'i'), '{V.PREFIXES[2]}', '', 'i')")} AS name FROM listings")
def q_inventory_prefix(rows: DataFrame) -> DataFrame:
    return rows.select("id", L.without_prefix(F.col("title")).alias("name"))


_QUERY_SQL = f"lower(strip_accents(trim(regexp_replace({plain('title')}, '\\s+', ' ', 'g'))))"
for _p, _flag in ((r"^\s*lot\s*#?\s*[\w-]+\s*[-:|]\s*", ""), (r"[()\[\]{}]", "g"), (r"\b(?:lot|pair|set|group)\s+of\s+\d+\b", "g"), (r"\bx\s*\d+\b", "g"), (r"\b\d+\s*pcs?\b", "g"), (r"\b(?:online\s+)?auction\s+(?:item|lot)\b.*$", ""), (r"^\s*(?:av|inv(?:entory)?|sku)\s*[-:|]\s*", ""), (r"[^a-z0-9.+-]+", "g")):
    _QUERY_SQL = f"regexp_replace({_QUERY_SQL}, '{_p}', ' ', '{_flag}')"


@listing_query(f""", o AS (SELECT id, trim(regexp_replace({plain('title')}, '\\s+', ' ', 'g')) AS original,
  list_filter(list_transform(string_split({_QUERY_SQL}, ' '), lambda t: regexp_replace(t, '^[.+-]+|[.-]+$', '', 'g')), lambda t: t NOT IN ('', 'x', {', '.join(f"'{w}'" for w in V.QUERY_NOISE)})) AS w FROM listings),
p AS (SELECT *, array_to_string(w, ' ') AS s FROM o)
SELECT id, CASE WHEN len(w) < 2 THEN left(original, 120) WHEN length(s) <= 120 THEN s ELSE left(regexp_replace(left(s, 121), '\\s+\\S*$', ''), 120) END AS phrase FROM p""")
def q_research_query(rows: DataFrame) -> DataFrame:
    return rows.select("id", L.research_query(F.col("title")).alias("phrase"))


@listing_query()
def q_identity(rows: DataFrame) -> DataFrame:
    """Name, brand, models, kind, words and evidence of every listing; tested on titles with known outcomes."""
    asked = ("name", "query", "brand", "model", "model2", "kind", "family", "sizes", "tokens", "telling", "evidence")
    rows, values = I.identity_of(rows, "title", "description")
    return rows.select("id", *(values[x].alias(x) for x in asked))  # from a struct, all of it would be made


@listing_query(f""", k AS (SELECT id, lower(title) AS t FROM listings)
SELECT id, CASE {' '.join(f"WHEN regexp_matches(t, '{p}') THEN length(regexp_extract(t, '(?s)^(.*?)(?:{p})', 1)) + 1" for p in V.KINDS.values())} ELSE 0 END AS at FROM k""")
def q_kind_position(rows: DataFrame) -> DataFrame:
    """Where a listing's title names its kind."""
    rows = rows.withColumn("t", F.lower(L.normalised(F.col("title")))).withColumn("kind", I.kind_of(F.col("t")))  # once, and not for each kind
    return rows.select("id", I.kind_position(F.col("title"), F.col("kind")).cast("long").alias("at"))


@listing_query(f""", w AS (SELECT DISTINCT id, unnest(string_split_regex(title, '[\\s,;/]+')) AS w FROM listings)
SELECT id, w AS token, length(w) BETWEEN 2 AND 24 AND NOT regexp_matches(w, '{V.GENERIC_MODEL}') AND (regexp_matches(w, '\\d') OR regexp_matches(w, '{V.STATED_MODEL}')) AS shaped FROM w""")
def q_model_shape(rows: DataFrame) -> DataFrame:
    """Which words of a listing's title are shaped like a model."""
    rows = rows.select("id", F.explode(F.array_distinct(F.split("title", r"[\s,;/]+"))).alias("token")).distinct()  # what a title repeats does not reach the table of distinct rows
    return rows.select("id", "token", I.looks_like_model(F.col("token")).alias("shaped"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order as a candidate for the part of the order's first line.

    Each content of a part is read once as a lot and once as an offer, each pair of contents is compared once; up to there, and from there
    on, rows hold the digests of the contents instead of them.
    """
    parts = listings(spark, sf_dir)
    digest = lambda x: F.unhex(F.left(F.sha2(F.to_json(x), 256), F.lit(32)))
    lots = written(I.identified(parts.select("title", "description").distinct(), "title", "description", out="lot"), "lots").withColumn("lot_key", digest(F.col("lot")))  # both are used twice
    offers = written(I.offered(parts.select("title").distinct(), "title").select("title", "offer"), "offers").select("offer", digest(F.struct("title")).alias("offer_key"))
    lot_of = parts.join(lots.select(F.col("title").alias("_t"), F.col("description").alias("_d"), "lot_key"), F.col("title").eqNullSafe(F.col("_t")) & F.col("description").eqNullSafe(F.col("_d"))).select(F.col("id").alias("of"), "lot_key")
    offer_of = parts.select(F.col("id").alias("part"), digest(F.struct("title")).alias("offer_key"))
    lines = table(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("k"))
    keyed = first.join(lot_of, F.col("k") == F.col("of")).select(F.col("l_orderkey").alias("id"), "lot_key")
    lines = lines.join(offer_of, F.col("l_partkey") == F.col("part")).select("l_orderkey", F.col("l_linenumber").alias("pos"), "l_partkey", F.col("l_extendedprice").alias("price"), "offer_key")
    lines = keyed.join(lines, F.col("id") == F.col("l_orderkey")).drop("l_orderkey")
    pairs = spread(lines.select("lot_key", "offer_key").distinct(), "offer_key")
    lots = lots.groupBy("lot_key").agg(F.any_value("lot").alias("lot"))
    compared = I.evaluated(pairs.join(lots, "lot_key").join(offers, "offer_key"), "lot", "offer").select("lot_key", "offer_key", "evaluation")
    return lines.join(compared, ["lot_key", "offer_key"])


@query()
def q_candidate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each line's part could be sold in place of the order's first part, and why not; tested on pairs with known outcomes."""
    return _pairs(spark, sf_dir).select("id", "pos", "l_partkey", "evaluation.accepted", F.round("evaluation.score", 9).alias("score"), "evaluation.reasons", "evaluation.evidence")


@query()
def q_donor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines in the top score band of each order, the cheapest."""
    rows = _pairs(spark, sf_dir).select("id", "pos", "l_partkey", "price", F.col("evaluation.donor_score").alias("score")).where("score > 0")
    return match.band_choice(rows, "id", "score", "price", ["pos", "l_partkey"], 1.5).select("id", "pos", "l_partkey", "price")
