"""Queries over whole tables: no row of their table is left out."""

import pytest

from lotwright.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_job_store_reads_all_events(spark):
    rows = catalog.queries()["q_job_store_full"](spark, DATA).collect()
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert sum(r["writes"] for r in rows) == events.count()
    assert {r["user_id"] for r in rows} == {r["user_id"] for r in events.select("user_id").distinct().collect()}


#: Queries over literal rows, and the table that each operator runs over in full as name_all.
OPERATORS = {
    "documents": "q_cautions q_kind q_discriminators q_discriminators_rest q_currency q_mixed_lot q_stated_retail q_structured_desc q_tristate q_research_query q_inventory_prefix q_max_rate q_size_conflict q_identity",
    "pages": "q_html_tiles q_page_state q_html_candidates q_json_pages q_html_groups q_embedded_json_bfs q_state_normalize q_script_literals q_json_fragment q_listing_snapshot q_jsonld_richest",
}


@pytest.mark.parametrize("table,name", [(t, n) for t, names in OPERATORS.items() for n in names.split()])
def test_operator_reads_the_whole_table(spark, table, name):
    df = catalog.queries()[f"{name}_all"](spark, DATA)
    assert any(f"/{table}.parquet" in f for f in df.inputFiles())
    rows = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    n = df.count()
    if name in "q_cautions q_kind q_discriminators q_currency q_mixed_lot q_stated_retail q_research_query q_inventory_prefix q_max_rate q_size_conflict q_identity q_page_state q_state_normalize".split():
        assert n == rows  # one row each


def test_listing_snapshot_of_tables_that_do_not_fit(spark):
    from lotwright.plans import captures

    html = ["<p>no table</p>", "<table><tr><th>Price</th><th>Item</th><th>Item</th></tr><tr><td>$1</td></tr><tr><td>$2</td><td>C3</td></tr></table>", None]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    assert sorted(map(tuple, captures.q_listing_snapshot(df).collect()), key=str) == [(1, "C3", None, "$2"), (1, None, None, "$1")]


def test_export_payload_of_all_orders(spark):
    import json

    got = {r["c_custkey"]: json.loads(r["payload"]) for r in catalog.queries()["q_export_payload"](spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/customer.parquet").collect()
    assert got == {r["c_custkey"]: {"context": {"schemaVersion": 1}, "item": {"c_name": r["c_name"], "c_mktsegment": r["c_mktsegment"]}} for r in rows}
