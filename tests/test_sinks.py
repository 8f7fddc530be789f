import pytest
from pyspark.sql import functions as F

from lotwright.sources import batches, sinks


def test_gate(spark):
    rows = spark.range(3)
    audit = lambda *x: spark.createDataFrame(list(x), "complete boolean, reason string")
    assert sinks.gated(rows, audit((True, None))).count() == 3
    for bad in (audit((True, None), (False, "missing-records")), audit()):
        with pytest.raises(Exception, match="capture is not complete"):
            sinks.gated(rows, bad).collect()


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi"'), (2, None)], "id int, t string").coalesce(1)
    sinks.to_csv(rows, f"{tmp_path}/csv")
    assert [p.read_bytes() for p in (tmp_path / "csv").glob("part-*")] == [b'id,t\r\n"1","say ""hi"""\r\n"2",""']
    sinks.to_json(rows, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    sinks.to_text(rows.select(F.coalesce("t", F.lit("-")).alias("value")), f"{tmp_path}/text")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/text").collect()) == ["-", 'say "hi"']


def test_replace_and_upsert(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = lambda *x: spark.createDataFrame(list(x), "job string, id long, revision long")
    sinks.replace_partitions(df(("a", 1, 1), ("b", 2, 1)), path, ["job"])
    sinks.replace_partitions(df(("a", 9, 2)), path, ["job"])
    assert sorted((r["job"], r["id"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]
    got = sinks.upserted(df(("a", 1, 5), ("b", 1, 5), ("c", 1, 5)), df(("a", 2, 4), ("b", 2, 5), ("d", 2, 1)), "job", "revision")
    assert sorted((r["job"], r["id"]) for r in got.collect()) == [("a", 1), ("b", 2), ("c", 1), ("d", 2)]


def failing(df):
    """df, of which a task fails after some rows."""
    return df.withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))


def test_quoted_text_byte_by_byte(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 'x"y', None, 1.0, 2.5), ("", "line\r\nend", "é", -3.0, None)], "t string, u string, n string, d double, e double").coalesce(1)
    batches.write_quoted(rows, str(tmp_path / "q"))
    file = next((tmp_path / "q").glob("part-*"))
    assert file.read_bytes() == 't,u,n,d,e\r\n"a,b","x""y","","1","2.5"\r\n"","line\r\nend","é","-3",""'.encode()
    with pytest.raises(Exception, match="lost"):
        batches.write_quoted(failing(spark.range(0, 50, 1, 4)), str(tmp_path / "q"))
    assert [p for p in (tmp_path / "q").iterdir() if p.name[0] not in "._"] == [file]  # a task that outlives the failure may leave what nobody reads
    batches.write_quoted(spark.range(3).coalesce(1), str(tmp_path / "q"))
    assert [p.read_bytes() for p in (tmp_path / "q").glob("part-*")] == [b'id\r\n"0"\r\n"1"\r\n"2"']
    batches.write_quoted(spark.range(0).coalesce(1), str(tmp_path / "q"))
    assert {p.read_bytes() for p in (tmp_path / "q").glob("part-*")} <= {b"id"}


def test_batches_are_replaced_whole_or_not_at_all(spark, tmp_path):
    path, some = str(tmp_path / "b"), lambda a, b, job: spark.range(a, b, 1, 3).withColumn("job", F.lit(job))
    read = lambda: sorted((r["job"], r["id"]) for r in batches.read_batches(spark, path, "job", "id long").collect())
    assert read() == []
    batches.put_batches(some(0, 350, "a").union(some(0, 5, "b")), path, "job")
    want = sorted([("a", k) for k in range(350)] + [("b", k) for k in range(5)])
    assert read() == want
    sizes = [len(f.read_text().splitlines()) for f in (tmp_path / "b").rglob("*.json")]
    assert max(sizes) <= 100 and sum(sizes) == 355
    with pytest.raises(Exception, match="lost"):
        batches.put_batches(failing(some(0, 300, "a")), path, "job", replace=True)
    assert read() == want
    batches.put_batches(some(5, 8, "b"), path, "job")
    batches.put_batches(some(1000, 1002, "a"), path, "job", replace=True)
    assert read() == sorted([("a", 1000), ("a", 1001)] + [("b", k) for k in range(8)])
