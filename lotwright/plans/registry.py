"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, folder of tables) under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def landed(sql: str, columns: dict[str, str], whole: Query) -> Callable:
    """Registers a function of rows twice: over every page with what a site would have landed there, and as name_all over a table as it is.

    ``columns`` are SQL expressions of page_id, url and html that Spark and DuckDB read alike; ``sql`` says what must be found in them.
    """

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def every(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(table(spark, sf_dir, "pages").selectExpr(*(f"{x} AS {n}" for n, x in columns.items())))

        def full(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(whole(spark, sf_dir))

        every.__name__, full.__name__ = f.__name__, f"{f.__name__}_all"
        query(sql)(every)
        query()(full)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by a key to several tasks for each core: for costly work on each row, where a table's files or row groups are fewer."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)
