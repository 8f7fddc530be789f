"""Records that a page carries as JSON: a bounded walk, breadth first, over values of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How deep a store is walked (its root is 0), how many objects and arrays of it are looked into, and whose children count.
DEPTH, NODES, CHILDREN = 6, 10_000, "portalChildren"


def script_json(html: Column, script_id: str) -> Column:
    """The text of a page's JSON script with that id; null without one."""
    pattern = rf"""(?is)<script\b(?=[^>]*\bid\s*=\s*["']?{script_id}["'\s>])(?=[^>]*\btype\s*=\s*["']?application/json\b)[^>]*>(.*?)</script>"""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def _entries(node: Column) -> Column:
    """Keys (null in arrays) and values of an object or array; empty for anything else."""
    named = F.map_entries(F.try_variant_get(node, "$", "map<string,variant>"))
    listed = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    return F.coalesce(named, listed, F.array().cast("array<struct<key:string,value:variant>>"))


def _nested(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull() | F.try_variant_get(value, "$", "array<variant>").isNotNull()


def _text(value: Column) -> Column:
    """A scalar as text: whole numbers without a fraction."""
    as_json = F.to_json(value)
    return F.when(as_json.startswith('"'), F.try_variant_get(value, "$", "string")).otherwise(F.regexp_replace(as_json, r"\.0+$", ""))


def _ids(value: Column) -> Column:
    """The digits that a list holds, or a text with commas; a lone 0 counts as nothing."""
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), _text)
    alone = F.when(_nested(value) | (_text(value) == "0"), F.lit("")).otherwise(_text(value))
    texts = F.coalesce(listed, F.split(F.coalesce(alone, F.lit("")), ","))
    return F.filter(F.transform(texts, lambda t: F.regexp_extract(t, r"^\s*([0-9]+)\s*$", 1)), lambda t: t != "")


def children(stores: DataFrame, body: str, keep: list[str], key: str = CHILDREN, depth: int = DEPTH, nodes: int = NODES) -> DataFrame:
    """One row for each id below a key called ``key`` (in any case): keep, pos (from 0, in the order of first sight) and child.

    Breadth first: the values of an object by key, of an array by place. Objects and arrays are looked into down to
    ``depth``, at most ``nodes`` of them; what stands under a matching key is read and not walked, and text that looks like
    JSON is text. A store that is null or no JSON has no ids. The walk is a chain of expressions over the store's own row,
    a level each, so nothing is shuffled and a level that is cut is never expanded.
    """
    rows = stores.select(F.struct(*keep).alias("keep"), F.try_parse_json(body).alias("root"))
    rows = rows.select("keep", F.lit(nodes).alias("left"), F.when(_nested(F.col("root")), F.array("root")).otherwise(F.array().cast("array<variant>")).alias("level"), F.array().cast("array<string>").alias("ids"))
    match = lambda e: F.coalesce(F.lower(e["key"]) == key.lower(), F.lit(False))
    for at in range(depth + 1):
        rows = rows.withColumn("level", F.slice("level", 1, F.col("left")))
        rows = rows.select("keep", "ids", (F.col("left") - F.size("level")).alias("left"), F.flatten(F.transform("level", _entries)).alias("entries"))
        found = F.flatten(F.transform(F.filter("entries", match), lambda e: _ids(e["value"])))
        below = F.transform(F.filter("entries", lambda e: ~match(e) & _nested(e["value"])), lambda e: e["value"]) if at < depth else F.array().cast("array<variant>")
        rows = rows.select("keep", "left", below.alias("level"), F.concat("ids", found).alias("ids"))
    return rows.select("keep.*", F.posexplode(F.array_distinct("ids")).alias("pos", "child"))
