"""A corpus pipeline over ``documents``: language, quality, near-duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwright.llm import decontaminate, language_id, minhash, packing, quality
from lotwright.llm.common import discard, scratch, shared_path, table, written

#: (name, function of (spark, docs, sf_dir)); what a stage returns is written as Parquet and read as the next one's docs.
STAGES = [
    ("language_id", language_id.stage),
    ("quality", quality.stage),
    ("minhash_near_dedup", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("best_fit_packing", packing.stage),
]

#: Trained classifiers decide the first two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep. A stage's own tables go when its result is written, its input when the next one's is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
