"""Photo manifests checked against the archived files themselves: path, size, content, repetition, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: photos of a listing that are uploaded.
MOST = 10
#: Where an archived photo may lie: below a folder, by plain names.
SHAPE = r"^(?!.*\.\.)[A-Za-z0-9_-][A-Za-z0-9_.-]*(?:/[A-Za-z0-9_-][A-Za-z0-9_.-]*)+\.(?i:jpe?g|png|webp|gif)$"


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), sha256 and bytes of every file; contents stay in the tasks that read them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.removeprefix("file:").rstrip("/")
    return digests(files.select(F.regexp_replace("path", rf"^.*?\Q{root}\E/", "").alias("path"), "content"))


def digests(files: DataFrame) -> DataFrame:
    """path, own_sha256 and own_bytes of files with path and content."""
    return files.select("path", F.sha2("content", 256).alias("own_sha256"), F.octet_length("content").cast("long").alias("own_bytes"))


def checked(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest's rows with reason, null for a photo that is as it should be.

    ``manifest`` has listing, position, path, sha256, bytes and expected (photos of the listing); ``files`` are digests. Reasons in order:
    ``path`` (escapes the archive or is no photo's), ``missing``, ``bytes``, ``hash``, ``duplicate`` (an earlier photo of the
    listing has the same hash). A null path, hash or size is a fault of its kind; a null position comes last.
    """
    place = F.struct(F.col("position").isNull(), F.coalesce("position", F.lit(0)), F.coalesce("path", F.lit("")))
    rows = manifest.withColumn("_place", place)
    firsts = rows.where("sha256 IS NOT NULL").groupBy("listing", "sha256").agg(F.min("_place").alias("_first"))
    rows = rows.join(firsts, ["listing", "sha256"], "left").join(files, "path", "left")
    wrong = lambda ok: ~F.coalesce(ok, F.lit(False))
    faults = [(wrong(F.col("path").rlike(SHAPE)), "path"), (F.col("own_sha256").isNull(), "missing"), (wrong(F.col("bytes") == F.col("own_bytes")), "bytes"), (wrong(F.lower("sha256") == F.col("own_sha256")), "hash"), (F.col("_place") > F.col("_first"), "duplicate")]
    reason = F.coalesce(*(F.when(x, name) for x, name in faults))
    return rows.select(*manifest.columns, reason.alias("reason"), "_place")


def listings(rows: DataFrame) -> DataFrame:
    """listing, photos, expected, reason (of the first faulty photo, else ``incomplete``), valid, uploads and capped, for rows of ``checked``.

    Faults beyond the photos that would be uploaded count too.
    """
    out = rows.groupBy("listing").agg(F.count("*").alias("photos"), F.max("expected").cast("long").alias("expected"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("_place"))).alias("_fault"))
    reason = F.coalesce("_fault", F.when(~F.coalesce(F.col("photos") == F.col("expected"), F.lit(False)), "incomplete"))
    out = out.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
    return out.select("listing", "photos", "expected", "reason", "valid", F.when(F.col("valid"), F.least("photos", F.lit(MOST))).otherwise(0).cast("long").alias("uploads"), (F.col("valid") & (F.col("photos") > MOST)).alias("capped"))


def uploads(rows: DataFrame) -> DataFrame:
    """The first MOST photos of valid listings in order, with place (from 1), for rows of ``checked``."""
    valid = listings(rows).where("valid").select("listing")
    own = rows.join(valid, "listing", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("listing").orderBy("_place")))
    return own.where(F.col("place") <= MOST).drop("_place", "reason")
