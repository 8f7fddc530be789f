"""Rows that are accepted, and rows that are set aside with their reasons, in one pass; identities and fingerprints that decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwright.sources.shared import shared_path

#: Members of a request that change from page to page and from session to session.
VOLATILE = ("page", "sessionid")


def composite_id(account: Column, asset: Column) -> Column:
    """account:asset; null if either is missing or empty."""
    part = lambda x: F.nullif(F.trim(x.cast("string")), F.lit(""))
    return F.when(part(account).isNotNull() & part(asset).isNotNull(), F.concat_ws(":", part(account), part(asset)))


def identity_faults(account: Column, asset: Column, wanted_account: Column, wanted_asset: Column) -> dict[str, Column]:
    """Reasons for which a record is not the one that was asked for; a null wanted part asks for nothing."""
    other = lambda got, wanted: F.coalesce(got.cast("string") != wanted.cast("string"), F.lit(False))
    return {"asset-identity-missing": composite_id(account, asset).isNull(), "asset-identity-mismatch": other(account, wanted_account) | other(asset, wanted_asset)}


def judged(rows: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """rows with reasons: the names of the faults that hold, in order; a fault that is null does not."""
    return rows.withColumn("reasons", F.array_compact(F.array(*(F.when(x, F.lit(name)) for name, x in faults.items()))))


def separated(rows: DataFrame, faults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with reasons): one pass over rows writes both, and each is read from its own folder."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "judged")
    out = judged(rows, faults).withColumn("_accepted", F.size("reasons") == 0)
    out.write.partitionBy("_accepted").parquet(path)
    back = spark.read.schema(out.schema).parquet(path)
    return back.where("_accepted").drop("reasons", "_accepted"), back.where("NOT _accepted").drop("_accepted")


def request_fingerprint(body: Column, volatile: tuple[str, ...] = VOLATILE) -> Column:
    """A digest of a JSON request without its volatile members, whatever the order of its members; null for what is no JSON object."""
    members = F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>")
    kept = F.map_filter(members, lambda k, _: ~F.lower(k).isin(*volatile))
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))))), 256)
