"""Retail results by their place in the element tree: for pages whose records nest, where slices of text would mix them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Records(HTMLParser):
    """Collects title, price and sponsorship of each element with data-key; an inner record's text is its own alone."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict | None, str | None]] = []  # element, its record, the field its text goes to
        self.found: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        record = self.open[-1][1] if self.open else None
        if key := at.get("data-key"):
            record = {"key": key.upper(), "title": "", "price": "", "sponsored": False}
            self.found.append(record)
        names = at.get("class", "").split()
        field = "title" if tag in ("h2", "h3") else "price" if any("price" in n for n in names) else self.open[-1][2] if self.open and not key else None
        if record is not None and any("sponsored" in n.lower() for n in names):
            record["sponsored"] = True
        if record is not None and tag == "img" and not record["title"]:
            record["title"] = at.get("alt", "")
        if tag not in VOID:
            self.open.append((tag, record, field))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and (record := self.open[-1][1]) is not None:
            if field := self.open[-1][2]:
                record[field] = f"{record[field]} {data}"
            if data.strip().lower() == "sponsored":
                record["sponsored"] = True


def records(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """One row per record: keep, pos, key, title, price, sponsored. A null page has none."""
    taken = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    schema = T.StructType([*pages.select(*keep).schema.fields, *T.StructType.fromDDL("pos int, key string, title string, price_text string, sponsored boolean").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("_html").to_pylist()):
                parser = _Records()
                parser.feed(text or "")
                parser.close()
                for pos, r in enumerate(parser.found):
                    rows.append(i)
                    out.append((pos, r["key"], " ".join(r["title"].split()), " ".join(r["price"].split()), r["sponsored"]))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, kinds))], [*keep, "pos", "key", "title", "price_text", "sponsored"])

    price = F.replace(F.regexp_extract("price_text", r"([\d,]+(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
    return taken.mapInArrow(work, schema).withColumn("price", price).drop("price_text")
