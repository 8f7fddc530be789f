"""Queries about models and kinds of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwright.functions import identity as I

from .registry import query, spread, table


@query("SELECT p_partkey, contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), lower(split_part(p_name, ' ', 1))) AS joined FROM part")
def q_model_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", I.model_matches(F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("joined"))


#: Attributes of a part, as columns have them; those that are not named are empty.
_OWN = {"colors": "split_part(p_name, ' ', 1)", "materials": "lower(p_type)", "packageCounts": "'' || p_size % 7", "volumes": "p_size % 5 || 'l'", "platformVariants": "p_brand", "seriesSignatures": "'s' || p_partkey % 3"}
#: What of these a part says at all, by its key.
_SAYS = {"colors": "true", "materials": "p_partkey % 2 = 0", "packageCounts": "p_partkey % 3 > 0", "volumes": "p_partkey % 4 = 1", "platformVariants": "p_partkey % 5 < 2", "seriesSignatures": "p_partkey % 5 = 4"}
_LISTS_SQL = ", ".join(f"CASE WHEN {_SAYS[g]} THEN [{x}] ELSE [] END AS {g}" for g, x in _OWN.items())
_GONE = {g: f"list_filter(a.{g}, lambda x: NOT list_contains(b.{g}, x))" for g in _OWN}
_CONFLICTS_SQL = ", ".join(f"CASE WHEN len({_GONE[g]}) > 0 AND len(b.{g}) > 0 THEN 'attribute-conflict:{g}:' || array_to_string({_GONE[g]}, ',') END" for g in I.GROUPS if g in _OWN)
_MISSING_SQL = ", ".join(f"CASE WHEN len({_GONE[g]}) > 0 AND len(b.{g}) = 0 THEN 'attribute-missing:{g}:' || array_to_string({_GONE[g]}, ',') END" for g in I.CRITICAL)
_SHARED_SQL = " + ".join(f"len(list_intersect(a.{g}, b.{g}))" + " * 2" * (g in I.DOUBLE) for g in _OWN)


@query(f"""
WITH p AS (SELECT p_partkey, p_size, {_LISTS_SQL} FROM part)
SELECT a.p_partkey AS lot, b.p_partkey AS offer, CAST({_SHARED_SQL} AS INT) AS shared, CAST({' + '.join(f'len(a.{g})' for g in _OWN)} AS INT) AS evidence,
  list_filter([{_CONFLICTS_SQL}], lambda x: x IS NOT NULL) AS conflicts, list_filter([{_MISSING_SQL}], lambda x: x IS NOT NULL) AS missing
FROM p a JOIN p b ON b.p_partkey BETWEEN a.p_partkey + 1 AND a.p_partkey + 4
""")
def q_attribute_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part against the next four: shared and contradicted attributes, and critical ones that the offer does not state."""
    empty = F.array().cast("array<string>")
    groups = [F.when(F.expr(_SAYS[g]), F.array(F.expr(_OWN[g]))).otherwise(empty).alias(g) if g in _OWN else empty.alias(g) for g in I.GROUPS]
    parts = table(spark, sf_dir, "part").select("p_partkey", F.struct(*groups).alias("says"))
    lots = parts.select(F.col("p_partkey").alias("lot"), F.col("says").alias("l"), F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + 4)).alias("offer"))
    pairs = lots.join(parts.select(F.col("p_partkey").alias("offer"), F.col("says").alias("o")), "offer")
    return pairs.select("lot", "offer", I.compared(F.col("l"), F.col("o")).alias("c")).select("lot", "offer", "c.*")


#: Titles by key, and what each must give: capacities, volumes, resolutions, dimensions, series, platforms, processors and graphics, colours, packages.
_TITLES = [
    ("' portable drive 512GB and 2 TB'", {"capacities": ["2tb"]}),
    ("' lotion 16 fl oz, 2 pack'", {"volumes": ["16oz"], "packageCounts": ["2"]}),
    ("' television 2160p 55 inch'", {"resolutions": ["4k"], "dimensions": ["55in"]}),
    ("' iPhone 13 Pro Max'", {"seriesSignatures": ["iphone:13:pro:max"]}),
    ("' PlayStation 5 digital edition'", {"platformVariants": ["playstation:5"], "editions": ["digital"]}),
    ("' desktop Core i7-9700K, RTX 3080 Ti'", {"cpuModels": ["intel:i7:9700:k"], "gpuModels": ["nvidia:rtx:3080:ti"]}),
    ("' pitcher 2 quarts'", {"volumes": ["2qt"]}),
    ("' Galaxy 21 Ultra 128 GB 65 W'", {"seriesSignatures": ["galaxy:21:ultra"], "capacities": ["128gb"], "wattages": ["65w"]}),
    ("' router Wi-Fi 6E, bluetooth 5.2'", {"networkStandards": ["bluetooth:5.2", "wifi:6e"]}),
    ("' blender 3 speeds 12 V'", {"modeCounts": ["3"], "voltages": ["12v"]}),
]
_SHOWN = ["capacities", "volumes", "resolutions", "dimensions", "seriesSignatures", "platformVariants", "editions", "cpuModels", "gpuModels", "packageCounts", "networkStandards", "modeCounts", "voltages", "wattages"]
_TITLE_SQL = f"p_name || CASE p_partkey % {len(_TITLES)} " + " ".join(f"WHEN {k} THEN {t}" for k, (t, _) in enumerate(_TITLES)) + " END"


def _outcome_sql(group: str) -> str:
    return f"CASE p_partkey % {len(_TITLES)} " + " ".join(f"WHEN {k} THEN '{','.join(said[group])}'" for k, (_, said) in enumerate(_TITLES) if group in said) + " ELSE '' END"


@query(f"SELECT p_partkey, {', '.join(f'{_outcome_sql(g)} AS {g}' for g in _SHOWN)} FROM part")
def q_canonical_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of every part's title with a product of known attributes behind it, in their canonical forms."""
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.lower(F.expr(_TITLE_SQL)).alias("t"))
    found = I.attributes_of(F.col("t"))
    return rows.select("p_partkey", *(F.array_join(found[g], ",").alias(g) for g in _SHOWN))


#: Candidates for a lot of one model by key, with M for the model, and what each must give: reasons (none: accepted), score and donor score.
_CANDIDATES = [
    ("Acme M Cordless Drill 18V Black Kit", "", 15.0, 15.0), ("Acme M9 Cordless Drill 18V Black", "model-mismatch:M", 0.0, 0.0), ("Case for Acme M Cordless Drill", "accessory-or-component", 0.0, 0.0),
    ("Acme M Cordless Drill 12V Black", "attribute-conflict:voltages:18v", 0.0, 0.0), ("Acme M Cordless Drill 18V White", "attribute-conflict:colors:black", 0.0, 0.0), ("M Drill", "", 6.6, 6.6), ("", "empty-title", 0.0, 0.0),
]
_OFFER = f"CASE p_partkey % {len(_CANDIDATES)} " + " ".join(f"WHEN {k} THEN replace('{t}', 'M', 'AX' || (1000 + p_partkey))" for k, (t, *_) in enumerate(_CANDIDATES)) + " END"


def _given(column: int) -> str:
    return f"CASE p_partkey % {len(_CANDIDATES)} " + " ".join(f"WHEN {k} THEN " + (f"replace('{c[column]}', 'M', 'AX' || (1000 + p_partkey))" if column == 1 else f"{c[column]}") for k, c in enumerate(_CANDIDATES)) + " END"


@query(f"SELECT p_partkey, {_given(1)} = '' AS accepted, {_given(1)} AS reasons, CAST({_given(2)} AS DOUBLE) AS score, CAST({_given(3)} AS DOUBLE) AS donor_score FROM part")
def q_candidate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for every part as a lot of its own model: accepted, or why not."""
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.expr("'Acme AX' || (1000 + p_partkey) || ' Cordless Drill 18V Black'").alias("a"), F.expr(_OFFER).alias("b"))
    rows = I.evaluated(I.offered(I.identified(rows, "a", out="lot"), "b"), "lot", "offer")
    return rows.select("p_partkey", "evaluation.accepted", F.array_join("evaluation.reasons", ";").alias("reasons"), F.round("evaluation.score", 6).alias("score"), F.round("evaluation.donor_score", 6).alias("donor_score"))
