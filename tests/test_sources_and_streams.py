"""Sources on literal pages, and the watchlist stream against hand-made histories."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lotwright.sources import markup, paged
from lotwright.streaming import refresh, watch, windows


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_lot_tiles(spark):
    html = """<h2>Group</h2><div class=t data-lot-id="7"><h3>Lamp &amp; <b>shade</b></h3><a href="/lot/7">x</a> High Bid: $1,250.50</div><div data-lot-id='8'><h3>Desk</h3></div>"""
    got = rows(markup.lot_tiles(spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "p long, html string"), "html", ["p"]))
    assert [(r["p"], r["id"], r["title"], r["url"], r["bid"]) for r in got] == [(1, "7", "Lamp & shade", "/lot/7", 1250.5), (1, "8", "Desk", None, None)]


def test_candidates_prefer_organic_then_cheap(spark):
    key = "B000000001"
    html = f"""<div data-key="{key}"><h2>Sony TV</h2>Sponsored <span class="price">$10</span></div><div data-key="{key}"><h2>Sony TV</h2><span class="price">$30.5</span></div><div data-key="{key}"><h2>Sony TV used</h2><span class="price">$20</span></div><div data-key="B000000002"></div>"""
    got = rows(markup.candidates(spark.createDataFrame([(1, html)], "p long, html string"), "html", ["p"]))
    assert got == [{"p": 1, "key": key, "title": "Sony TV used", "price": 20.0, "sponsored": False, "used": True}]


def test_page_state_and_json_ld(spark):
    r = spark.range(1).select(markup.page_state(F.lit("Showing 1 to 24 of 1,250 lots")).alias("a"), markup.page_state(F.lit("No exact matches")).alias("b")).first()
    assert tuple(r["a"]) == (1, 24, 1250, False) and r["b"]["none"] and r["b"]["total"] is None
    html = '<script type="application/ld+json">{"@type":"Product","name":"a"}</script><script type="application/ld+json">{"@type":"Product","name":"b","sku":"9"}</script><script type="application/ld+json">broken</script>'
    assert rows(markup.json_ld(spark.createDataFrame([(1, html)], "p long, html string"), "html", ["p"])) == [{"p": 1, "name": "b", "sku": "9", "fields": 3}]


def test_pages(spark, tmp_path):
    pages = [{"pageNumber": k, "totalCount": 5, "filteredCount": None, "results": [{"id": 10 * k + i, "title": f"t{i}"} for i in range(2 if k < 3 else 1)]} for k in (1, 2, 3)]
    none = {"pageNumber": 1, "totalCount": 9, "noExactMatches": True, "results": [{"id": 1}]}
    df = spark.createDataFrame([(json.dumps(p),) for p in pages] + [(json.dumps(none),)], "body string")
    got = rows(paged.page_rows(df, "body"))
    assert len(got) == 5 and {r["total"] for r in got} == {5}
    assert [r["page"] for r in rows(paged.next_pages(spark.createDataFrame([(245,)], "total long"), 100))] == [2, 3]
    for p in pages:
        (tmp_path / f"page-{p['pageNumber']}.json").write_text(json.dumps(p))
    got = paged.read_landed(spark, str(tmp_path), 3)
    assert got.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in got.collect()) == [10, 11, 20, 21, 30]


@pytest.mark.parametrize(
    ("condition", "pages", "left"),
    [
        ("page = 2", 1, False), ("page >= 2 AND page < 4 AND id > 21", 2, False), ("page IN (1, 9)", 1, False), ("page = 7", 1, False), ("title LIKE 't1%' AND page <= 2", 2, True), ("page = 1 OR id = 30", 4, True), ("id IS NULL", 4, False), ("page <> 2", 4, True),
        ("title = 't0' AND id = 10", 4, True), ("total = 7 AND pos = 1", 4, False),
    ],
)
def test_filters_are_pushed_into_the_pages(spark, tmp_path, condition, pages, left):
    for k in (1, 2, 3, 4):
        results = [{"id": 10 * k + i, "title": f"t{i}"} for i in range(3)] + [{"title": "none"}]
        (tmp_path / f"page-{k}.json").write_text(json.dumps({"pageNumber": k, "totalCount": 9, "filteredCount": 7, "results": results}))
    own = paged.read_landed(spark, str(tmp_path), 4)
    pushed = own.where(condition)
    plain = spark.createDataFrame(own.collect(), own.schema).where(condition)
    assert sorted(pushed.collect(), key=str) == sorted(plain.collect(), key=str)
    assert pushed.rdd.getNumPartitions() == pages
    assert ("Filter" in pushed._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]) == left


def test_pages_of_ids(spark, tmp_path):
    pages = [{"data": {"pageNumber": 1, "totalCount": 9, "filteredCount": 6, "lots": [{"id": 91}, {"id": None}, {"id": 92}]}}, {"totalCount": 3, "lots": [{"id": 5}]}, {"data": {"pageNumber": 1, "totalCount": 455, "noExactMatches": True, "lots": [{"id": 1}]}}, {}]
    df = spark.createDataFrame([(json.dumps(p), k) for k, p in enumerate(pages)] + [("broken", 9), (None, 9)], "body string, k int")
    assert sorted(tuple(r) for r in paged.id_rows(df, "body", "k").collect()) == [(1, 0, 3, 5), (1, 0, 6, 91), (1, 2, 6, 92)]
    for k, p in enumerate(pages, 1):
        (tmp_path / f"page-{k}.json").write_text(json.dumps(p))
    got = paged.read_landed(spark, str(tmp_path), 4, ids="true")
    assert sorted(tuple(r) for r in got.where("id IS NOT NULL").collect()) == [(1, 0, 6, 91), (1, 2, 6, 92), (2, 0, 3, 5)]


def test_watchlist(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    at = lambda m: t0 + datetime.timedelta(minutes=m)
    ms = lambda m: int(at(m).timestamp() * 1000)
    history = [
        (1, at(0), 1, True, 5.0, 10.0, ms(60)), (1, at(1), 2, True, 12.0, 10.0, ms(60)), (1, at(2), 3, True, 13.0, 10.0, ms(60)), (1, at(3), 1, True, 1.0, 10.0, ms(60)),
        (1, at(4), 4, True, 9.0, 10.0, ms(60)), (1, at(5), 5, True, 11.0, 10.0, ms(60)), (2, at(0), 1, True, 1.0, 10.0, None), (2, at(1), 1, False, 0.0, 10.0, None),
        (2, at(2), 1, False, 0.0, 10.0, None), (2, at(3), 1, False, 0.0, 10.0, None), (3, at(120), 1, True, 1.0, 2.0, None),
    ]
    schema = "lot_id long, at timestamp, revision long, ok boolean, bid double, ceiling double, ends_ms long"
    spark.createDataFrame(history, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = sorted((r["lot_id"], r["kind"], r["at_ms"]) for r in watch.run_to_end(watch.watch(stream), str(tmp_path)).collect())
    assert got == [(1, "alarm_15", ms(45)), (1, "alarm_2", ms(58)), (1, "late", ms(3)), (1, "over_max", ms(1)), (1, "over_max", ms(5)), (2, "stale", ms(2))]


REFRESH = "lot_id long, at timestamp, seq long, kind string, generation long, fingerprint string, revision long, ok boolean, bid double, ceiling double, ends_ms long"


def landed_refreshes(spark, folder, files):
    """A stream of one micro-batch for each list of rows (lot, minute, ...)."""
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    for k, own in enumerate(files):
        table = spark.createDataFrame([(r[0], t0 + datetime.timedelta(minutes=r[1]), *r[2:]) for r in own], REFRESH)
        table.coalesce(1).write.parquet(f"{folder}/in/{k}")
        for part in (folder / "in" / str(k)).glob("part-*"):
            os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(REFRESH).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def minutes(alerts):
    return sorted((r["lot_id"], r["kind"], (r["at_ms"] - 1_704_067_200_000) / 60_000) for r in alerts.collect())


def answer(lot, at, revision=1, ok=True, bid=1.0, ends=None, generation=None, fingerprint=None, seq=0):
    return (lot, at, seq, "answer", generation, fingerprint, revision, ok, bid, 10.0, None if ends is None else 1_704_067_200_000 + ends * 60_000)


def ask(lot, at, generation, fingerprint, seq=0):
    return (lot, at, seq, "ask", generation, fingerprint, None, None, None, None, None)


def test_late_answers_are_rejected(spark, tmp_path):
    rows = [
        answer(1, 0), ask(1, 1, 1, "a"), answer(1, 2, bid=20.0, generation=1, fingerprint="a"), ask(1, 3, 2, "b"), answer(1, 4, generation=1, fingerprint="a"), answer(1, 5, generation=2, fingerprint="a"), answer(1, 6, generation=2, fingerprint="b", bid=5.0),
        ask(1, 7, 1, "a"), answer(1, 8, generation=2, fingerprint="b", bid=11.0), answer(1, 9, revision=0, generation=2, fingerprint="b", bid=1.0), answer(1, 10), answer(9, 600),
    ]
    got = minutes(watch.run_to_end(watch.watch(landed_refreshes(spark, tmp_path, [rows])), str(tmp_path)))
    assert got == [(1, "late", 4), (1, "late", 5), (1, "late", 9), (1, "late", 10), (1, "over_max", 2), (1, "over_max", 8)]


def test_order_of_arrival_and_size_of_runs_do_not_matter(spark, tmp_path):
    """A hot lot's rows, mixed and in four micro-batches within the lateness, give what one ordered batch gives."""
    own = random.Random(5)
    rows = [answer(7, k / 4, revision=k - own.choice((0, 0, 0, 5)), ok=own.random() < 0.7, bid=own.choice((1.0, 20.0)), ends=own.choice((None, k // 4 + 30, k // 4 + 3)), seq=k) for k in range(1200)]
    rows += [answer(8, 299, ends=320), answer(9, 2000)]
    want = minutes(watch.run_to_end(watch.watch(landed_refreshes(spark, tmp_path / "a", [rows])), str(tmp_path / "a")))
    mixed = sorted(rows[:-1], key=lambda r: r[1] + own.uniform(0, 60))
    files = [mixed[:300], mixed[300:320], mixed[320:900], mixed[900:], rows[-1:]]
    small = watch.watch(landed_refreshes(spark, tmp_path / "b", files), "120 minutes", watch.Watch(run=50, chunk=8))
    got = minutes(watch.run_to_end(small, str(tmp_path / "b")))
    assert got == want and {k for _, k, _ in got} == {"late", "stale", "over_max", "alarm_15", "alarm_2"}


def test_lots_are_forgotten_after_their_end(spark, tmp_path):
    files = [[answer(1, 0, ends=30, bid=20.0), answer(2, 0, bid=20.0)], [answer(9, 200)], [answer(1, 300, ends=330, bid=20.0), answer(2, 300, bid=20.0), answer(9, 500)]]
    forgetful = watch.watch(landed_refreshes(spark, tmp_path, files), processor=watch.Watch(keep_ms=60 * 60_000))
    got = minutes(watch.run_to_end(forgetful, str(tmp_path)))
    assert got == sorted([(lot, "over_max", at) for lot in (1, 2) for at in (0, 300)] + [(1, "alarm_15", 15), (1, "alarm_2", 28), (1, "alarm_15", 315), (1, "alarm_2", 328)])


def test_a_row_reaches_the_worker_as_one_text(spark, tmp_path):
    rows = [answer(1, 0, bid=float("nan")), answer(1, 1, bid=float("inf")), answer(1, 2, bid=None), answer(1, 3, bid=11.0), answer(1, 4, bid=float("nan")), answer(1, 5, bid=10.5), answer(9, 600)]
    alerts = watch.watch(landed_refreshes(spark, tmp_path, [rows]))
    assert "to_json" in alerts._jdf.queryExecution().analyzed().toString()
    assert minutes(watch.run_to_end(alerts, str(tmp_path))) == [(1, "over_max", at) for at in (1, 3, 5)]


def test_a_lot_of_few_rows_is_one_value_of_the_state():
    calls = []

    class State:
        value = None

        def __getattr__(self, name):
            def call(*x):
                calls.append(name)
                if name in ("update", "clear"):
                    self.value = x[0] if x else None
                return self.value

            return call

        getValueState = getMapState = lambda self, *x: State()
        getCurrentWatermarkInMs = lambda self: 10

    processor = watch.Watch()
    processor.init(State())
    said = lambda **x: Row(lot_id=1, at=None, said=json.dumps({"kind": "answer", "revision": 1, "ok": True, "over": True} | x))
    assert list(processor.handleInputRows((1,), iter([said(at_ms=20, seq=2), said(at_ms=2, seq=1), said(at_ms=1, over=False)]), State())) == []
    assert [(r["kind"], r["at_ms"]) for r in processor.handleExpiredTimer((1,), State(), None)] == [("over_max", 2)]
    assert calls == ["get", "update", "registerTimer"] * 2
    assert len(json.loads(processor.known.value[3])) == 3 and processor.known.value[2] == [[0, 0, 2, 0, 20]]  # the third row waits


def test_hourly_windows(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    events = [(k, t0 + datetime.timedelta(minutes=20 * k), "view", 1.0) for k in range(12)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    spark.createDataFrame(events + events[:2], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = windows.hourly(source()).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.sql("SELECT * FROM hours").collect())[-1] == 5
    q = windows.first_sights(source()).writeStream.format("memory").queryName("sights").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT * FROM sights").count() == 12


def test_tree_records(spark):
    from lotwright.sources import tree

    html = """<div data-key="a1"><h2>Sony <b>TV</b></h2><div data-key="b2"><h2>Inner</h2><span class="x-price">$5</span></div><span class="price">$1,030.50</span></div><div data-key="c3"><img alt="Pic"><i>Sponsored</i></div>"""
    got = rows(tree.records(spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "p long, html string"), "html", ["p"]))
    assert [(r["key"], r["title"], r["price"], r["sponsored"]) for r in sorted(got, key=lambda r: r["pos"])] == [("A1", "Sony TV", 1030.5, False), ("B2", "Inner", 5.0, False), ("C3", "Pic", None, True)]


def test_refreshes_merge_in_batches(spark, tmp_path):
    store = refresh.Store(spark, str(tmp_path / "watched"))
    store.create(spark.createDataFrame([(k, 500 if k == 3 else None) for k in range(250)], "lot_id long, max_cents long"))
    assert sorted(len(r["lot_ids"]) for r in refresh.requests(store.read()).collect()) == [50, 100, 100]
    schema = "lot_id long, high_bid double, seconds_left double, place long, at_ms long, batch long"
    rounds = [
        [(3, 5.01, 60.0, 1, 1000, None), (3, 6.5, None, 2, 1000, None), (150, 1.0, float("nan"), 1, 1000, None), (999, 9.0, 1.0, 1, 1000, None)],
        [(3, 7.0, 10.0, 1, 2000, None), (150, 2.0, 5.0, 1, 2000, None), (None, None, None, None, 2000, 0)],
        [(3, float("inf"), 10.0, 1, 3000, None), (None, None, None, None, 3000, 0), (None, None, None, None, 3000, 0)],
    ]
    tables = [spark.createDataFrame(r, schema) for r in rounds]
    store.refresh(tables[0], 0)
    row = lambda k: tuple(store.read().where(f"lot_id = {k}").first())[2:]
    assert row(3) == (650, None, 1000, 0, False, True, True) and row(150) == (100, None, 1000, 0, False, False, False) and row(9) == (None, None, None, 1, False, False, False)
    store.refresh(tables[1], 1)
    assert row(3) == (650, None, 1000, 1, False, True, False) and row(150) == (200, 7000, 2000, 0, False, False, False) and row(9)[3:5] == (2, True)
    before = {tuple(r) for r in store.read().collect()}
    store.refresh(tables[1], 1)  # the same micro-batch again
    assert {tuple(r) for r in store.read().collect()} == before and store.versions() == [1, 2]
    tables[2].write.parquet(str(tmp_path / "watched/3"))
    (tmp_path / "watched/3/_SUCCESS").unlink()  # a version that was begun and not finished
    store.refresh(tables[2], 2)
    assert row(3) == (650, None, 1000, 2, True, True, False) and store.read().count() == 250 and store.versions() == [2, 3]
