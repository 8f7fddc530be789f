"""Landed pages of API results as tables: one partition per page through a Python data source, or plain JSON columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

PAGE = "struct<pageNumber:int,pageLength:int,totalCount:bigint,filteredCount:bigint,noExactMatches:boolean,results:array<struct<id:bigint,title:string,highBid:double>>>"



def page_rows(pages: DataFrame, body: str) -> DataFrame:
    """One row per result: page, pos, total (filtered count if there is one; 0 where nothing matches), id, title, bid."""
    p = pages.withColumn("_p", F.from_json(body, PAGE))
    total = F.when(F.col("_p.noExactMatches"), F.lit(0)).otherwise(F.coalesce("_p.filteredCount", "_p.totalCount"))
    results = F.when(F.coalesce(F.col("_p.noExactMatches"), F.lit(False)), F.array().cast("array<struct<id:bigint,title:string,highBid:double>>")).otherwise(F.col("_p.results"))
    rows = p.select(F.col("_p.pageNumber").alias("page"), total.alias("total"), F.posexplode(results).alias("pos", "r"))
    return rows.select("page", "pos", "total", "r.id", "r.title", F.col("r.highBid").alias("bid"))


def next_pages(first: DataFrame, size: int) -> DataFrame:
    """The pages that remain after the first: one row each, from its total."""
    last = F.ceil(F.col("total") / size).cast("int")
    return first.where("total > 0").select(F.explode(F.when(last >= 2, F.sequence(F.lit(2), last)).otherwise(F.array().cast("array<int>"))).alias("page"))


ID_PAGE = "struct<pageNumber:int,totalCount:bigint,filteredCount:bigint,noExactMatches:boolean,lots:array<struct<id:bigint>>>"


def id_rows(pages: DataFrame, body: str, requested: str | None = None) -> DataFrame:
    """One row per id of pages that list ids only: page (the answer's, else the ``requested`` column), pos, total, id; null ids are left out.

    The total is the filtered count, else the whole count; where nothing matches it is 0 and suggestions are no ids. The
    listing may stand below ``data``.
    """
    p = pages.withColumn("_p", F.coalesce(F.from_json(F.get_json_object(body, "$.data"), ID_PAGE), F.from_json(body, ID_PAGE)))
    none = F.coalesce(F.col("_p.noExactMatches"), F.lit(False))
    total = F.when(none, F.lit(0)).otherwise(F.coalesce("_p.filteredCount", "_p.totalCount"))
    rows = p.select(F.coalesce("_p.pageNumber", F.col(requested) if requested else F.lit(None).cast("int")).alias("page"), total.alias("total"), F.posexplode(F.when(~none, F.col("_p.lots"))).alias("pos", "r"))
    return rows.select("page", "pos", "total", F.col("r.id").alias("id")).where("id IS NOT NULL")


#: What a filter on a whole-number column means; a null fits none of them but IsNull.
_TESTS = {
    EqualTo: lambda x, f: x is not None and x == f.value,
    EqualNullSafe: lambda x, f: x == f.value,
    GreaterThan: lambda x, f: x is not None and x > f.value,
    GreaterThanOrEqual: lambda x, f: x is not None and x >= f.value,
    LessThan: lambda x, f: x is not None and x < f.value,
    LessThanOrEqual: lambda x, f: x is not None and x <= f.value,
    In: lambda x, f: x is not None and x in f.value,
    IsNull: lambda x, f: x is None,
    IsNotNull: lambda x, f: x is not None,
}
_NUMBERS = ("page", "pos", "total", "id")


def fits(filters: list[Filter], values: dict[str, int | None]) -> bool:
    """Whether all filters on the given columns hold; those on others are not asked."""
    return all(_TESTS[type(f)](values[f.attribute[0]], f) for f in filters if f.attribute[0] in values)


class _Page(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__(number)
        self.path = path


class _Reader(DataSourceReader):
    """Filters on whole numbers are applied here in full: those on the page by not opening the others, the rest row by row."""

    def __init__(self, options: dict):
        self.path, self.pages = options["path"], int(options["pages"])
        self.ids, self.folders = options.get("ids", "false").lower() == "true", options.get("layout", "files") == "folders"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _NUMBERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[_Page]:
        name = "page={}" if self.folders else "page-{}.json"
        return [_Page(k, f"{self.path}/{name.format(k)}") for k in range(1, self.pages + 1) if fits(self.filters, {"page": k})]

    def _bodies(self, partition: _Page) -> Iterator[dict]:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(partition.path if "://" in partition.path else f"file://{partition.path.removeprefix('file:')}")
        paths = [path]
        if self.folders:
            paths = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if not f.base_name.startswith(("_", ".")))
        for one in paths:
            with fs.open_input_stream(one) as file:
                if raw := file.readall():
                    yield json.loads(raw)

    def read(self, partition: _Page | None):
        if partition is None:  # no page fits
            return
        for page in self._bodies(partition):
            page = page.get("data") or page
            none = bool(page.get("noExactMatches"))
            total = 0 if none else page["filteredCount"] if page.get("filteredCount") is not None else page.get("totalCount")
            for pos, r in enumerate([] if none else page.get("lots" if self.ids else "results") or []):
                own = {"page": partition.value, "pos": pos, "total": total, "id": r.get("id")}
                if fits(self.filters, own):
                    yield (*own.values(),) if self.ids else (*own.values(), r.get("title"))


class LandedPages(DataSource):
    """page-1.json to page-n.json of a folder, or the folders page=1 to page=n, a task for each; use ``read_landed``.

    Columns: page (that was asked for), pos, total, id and title; of pages that list ids only (option ``ids``), no title.
    Workers open the pages with Arrow's file systems, which take credentials of their own.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "page int, pos int, total bigint, id bigint" + ("" if self.options.get("ids", "false").lower() == "true" else ", title string")

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_landed(spark: SparkSession, path: str, pages: int, **options: str) -> DataFrame:
    """Landed pages with filters on page, pos, total and id pushed into the source; options: ids, layout."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").option("pages", pages).options(**options).load(path)
