"""Proof that a capture is complete: enumerated ids against hydrated records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are reported.
REASONS = [
    "route-fingerprint-changed", "user-stop", "api-page-failure", "api-hydration-failure", "api-total-drift", "api-visible-total-mismatch", "api-total-missing",
    "api-duplicate-ids", "api-enumeration-count-mismatch", "api-missing-hydration", "api-unexpected-hydration", "api-hydration-count-mismatch",
]
#: What an expectation may say beside its total and fingerprints, and what holds where it does not.
FACTS = {"visible_total": None, "failed_pages": 0, "failed_batches": 0, "drifted": 0, "stopped": False}


def audit(enumerated: DataFrame, hydrated: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per snapshot with counts of both sides, whether the capture is complete, and the first of twelve reasons if not.

    ``enumerated`` and ``hydrated`` have snapshot and id, and may have n, how often it occurs; ``expected`` has snapshot, total, start and end (fingerprints;
    a null one is not compared) and any of FACTS. Both sides are counted per (snapshot, id) first, so repeated ids and
    large snapshots combine before the shuffle; null ids do not count.
    """
    counted = lambda df, name: df.where("id IS NOT NULL").groupBy("snapshot", "id").agg((F.sum("n") if "n" in df.columns else F.count("*")).alias(name))
    a, b = counted(enumerated, "a"), counted(hydrated, "b")
    both = a.join(b, ["snapshot", "id"], "full")
    counts = both.groupBy("snapshot").agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("enumerated"),
        F.count("a").alias("enumerated_ids"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("hydrated"),
        F.count("b").alias("hydrated_ids"),
        F.count_if(F.col("a") > 1).alias("duplicates"),
        F.count_if(F.col("b").isNull()).alias("missing"),
        F.count_if(F.col("a").isNull()).alias("unexpected"),
    )
    rows = expected.join(counts, "snapshot", "left").fillna(0, ["enumerated", "enumerated_ids", "hydrated", "hydrated_ids", "duplicates", "missing", "unexpected"])
    fact = lambda name: F.coalesce(F.col(name), F.lit(FACTS[name])) if name in expected.columns else F.lit(FACTS[name])
    failed = [
        F.col("start") != F.col("end"),
        fact("stopped"),
        fact("failed_pages") > 0,
        fact("failed_batches") > 0,
        fact("drifted") > 0,
        fact("visible_total").isNotNull() & ~F.col("total").eqNullSafe(fact("visible_total")),
        F.col("total").isNull(),
        F.col("duplicates") > 0,
        F.col("enumerated_ids") != F.col("total"),
        F.col("missing") > 0,
        F.col("unexpected") > 0,
        F.col("hydrated_ids") != F.col("total"),
    ]
    reason = F.coalesce(*(F.when(x, name) for x, name in zip(failed, REASONS)))
    return rows.withColumn("reason", reason).withColumn("complete", F.col("reason").isNull()).drop("start", "end", *FACTS)


def missing(enumerated: DataFrame, hydrated: DataFrame, key: str = "id") -> DataFrame:
    return enumerated.select(key).distinct().join(hydrated.select(key), key, "left_anti")


#: What a reason of an audit is called in a proof.
PROOF_REASONS = {"route-fingerprint-changed": "route-fingerprint-changed", "user-stop": "stopped", "api-total-missing": "expected-total-unknown", "api-duplicate-ids": "duplicate-identities"}


def proven(audited: DataFrame, proofs: DataFrame) -> DataFrame:
    """audited (of ``audit``) with tier and proof, its reason: ``complete``, or why the capture is not proven.

    ``proofs`` has snapshot, exhausted and settled, as far as they are known. An exact total proves by the audit, an unknown one by
    pages that were read to their end, or by a bottom that had settled; neither helps where ids repeat or the route changed.
    """
    other = lambda name: F.coalesce(F.col(name), F.lit(False))
    rows = audited.join(proofs.select("snapshot", "exhausted", "settled"), "snapshot", "left")
    unknown = F.col("reason") == "api-total-missing"
    clean = F.col("duplicates") == 0
    tier = F.when(F.col("complete"), "api-exact").when(unknown & clean & other("exhausted"), "pagination-exact").when(unknown & clean & other("settled"), "dom-bottom-settled").otherwise("unproven")
    named = F.coalesce(*(F.when(F.col("reason") == k, v) for k, v in PROOF_REASONS.items()), F.when(F.col("reason") == "api-total-drift", "total-drift"), F.lit("count-mismatch"))
    rows = rows.withColumn("tier", tier)
    proof = F.when(F.col("tier") != "unproven", "complete").when(unknown & ~clean, "duplicate-identities").otherwise(named)
    return rows.withColumn("proof", proof).drop("exhausted", "settled")
