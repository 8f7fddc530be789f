"""Queries give the whole of what they once gave."""

from lotwright.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_private_mask_hides_names_and_balances(spark):
    got = catalog.queries()["q_private_mask"](spark, DATA)
    assert got.columns == ["c_custkey", "c_name", "c_acctbal", "segment"]
    kept = {r["c_custkey"]: r["c_acctbal"] > 0 for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(kept)
    assert all(r["c_acctbal"] is None and len(r["segment"]) <= 5 and (r["c_name"] is not None) == kept[r["c_custkey"]] for r in rows)


def test_partial_export_lists_what_is_missing(spark):
    rows = catalog.queries()["q_partial_export"](spark, DATA).collect()
    assert any(r["missing"] for r in rows)
    lines = {}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").collect():
        lines.setdefault(r["l_orderkey"], set()).add(r["l_linenumber"])
    assert all(r["missing"] == [x for x in range(1, max(lines[r["l_orderkey"]]) + 1) if x not in lines[r["l_orderkey"]]] for r in rows)
