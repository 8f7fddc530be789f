"""The pipeline over the smallest tables: the models' decisions by the operators, all later stages by brute force."""

import os

import corpus_pipeline
from test_operators import brute_groups, brute_hits, crc, token_lists

from lotwright.llm import language_id, quality
from lotwright.llm.common import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_have_the_columns_of_documents(spark):
    docs = table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).dtypes == docs.dtypes


def _folder(spark, path, rows):
    """Tables of a pipeline run: documents with odd rows and columns, and what the stages read beside them."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("row", "h", "d", "score", "predicted", "lang_pred", "n_hit", "contaminated", "_text", "a b"):
        table = table.withColumn(name, F.lit(None).cast("string") if name == "h" else F.lit("x"))
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(0, len(rows))], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return table


def test_stages_on_odd_rows_and_columns(spark, tmp_path):
    rows = [(k, "Some words of a text, number %d. " % k * 9, "en") for k in range(30)] + [(None, None, None), (40, None, "en"), (41, "", None), (None, "no id here, but words.", "en"), (5, "Some words. " * 30_000, "en"), (1, "Some words of a text, number 1. " * 9, "en")]
    table = _folder(spark, str(tmp_path), rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.dtypes == table.dtypes and out.exceptAll(table).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"


def test_stages_on_an_empty_table(spark, tmp_path):
    table = _folder(spark, str(tmp_path), [(0, "a text", "en")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, str(tmp_path)).count() == 0, name


def test_only_the_last_stages_tables_stay(spark, tmp_path):
    """Tables of earlier stages are deleted when the next one is written."""
    import pathlib

    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = {p.name for p in root.iterdir()}
    corpus_pipeline.run(spark, DATA).count()
    left = {p.name.rsplit("-", 1)[0] for p in root.iterdir() if p.name not in before}
    assert left <= {"decontamination", "pieces", "islands"}


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    said = language_id.predict(docs, language_id.fit(docs), ["doc_id"]).collect()
    ids = {r["doc_id"] for r in said if r["lang_pred"] != "und" and r["score"] >= language_id.LEAST}
    left = docs.where(docs["doc_id"].isin(list(ids)))
    good = quality.score(left, quality.fit(left, table(spark, DATA, "labels")), ["doc_id", "text"]).where("predicted = 1").collect()
    rows = [(r["doc_id"], r["text"]) for r in good]
    rows = [x for x, g in zip(rows, brute_groups(rows, 80)) if g[3]]
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    rows = [x for x, h in zip(rows, brute_hits([t for _, t in rows], items)) if not h[4]]
    want = sorted((i, p, len(c), crc(c)) for (i, _), own in zip(rows, token_lists(rows, 0)) for p, c in enumerate(own[k : k + 2048] for k in range(0, len(own), 2048)))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) <= -(-sum(r["length"] for r in got) // 2048) + 1
