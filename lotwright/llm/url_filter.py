"""URL filters: rules, and gradient-boosted trees on lexical features, in DataFrame and Spark ML operations only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, uniform, written

#: (host, path, verdict): fits the host and its subdomains where the path begins with the rule's; the longest wins.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Lexical features of a URL, then statistics of the host's last label, of its last two, and of the path's first segment.
FEATURES = [
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "upper_ratio", "hyphens", "host_hyphens",
    "parameters", "query_length", "has_fragment", "has_extension", "secure", "entropy",
    "suffix_count", "suffix_blocked", "domain_count", "domain_blocked", "segment_count", "segment_blocked",
]
#: Folds of labelled URLs: what a labelled URL is told of its suffix comes from the other folds.
FOLDS = 5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host lower-cased in A-Z; both empty for a null URL or one without ``://``."""
    rest = F.when(url.contains("://"), url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict): of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _lexical(rows: DataFrame) -> DataFrame:
    """rows (url, host, path) with the lexical features, and suffix, domain and segment: the host's last label, its last two, the path's first segment."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    letters = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda total, c: total - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return rows.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count(F.col("path"), "/[^/]").alias("depth"),
        count(F.col("host"), "[^.]+").alias("labels"),
        (count(url, "[0-9]") / size).alias("digit_ratio"),
        count(F.col("host"), "[0-9]").alias("host_digits"),
        (count(url, "[A-Z]") / size).alias("upper_ratio"),
        count(url, "-").alias("hyphens"),
        count(F.col("host"), "-").alias("host_hyphens"),
        count(query, "[^&]+").alias("parameters"),
        F.length(query).cast("double").alias("query_length"),
        url.contains("#").cast("double").alias("has_fragment"),
        F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double").alias("has_extension"),
        url.startswith("https").cast("double").alias("secure"),
        entropy.alias("entropy"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"),
        F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1).alias("domain"),
        F.regexp_extract("path", r"^/*([^/]*)", 1).alias("segment"),
    )


def _told(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (fold: null if not labelled) with how many URLs of ``known`` share their suffix, domain and segment, and the share blocked.

    A labelled URL is told what the other folds say, so that no label is read from its own row. Shares are smoothed by
    ten URLs of the overall share, which is also what a name that no labelled URL has gets.
    """
    overall = known.agg(F.avg(F.col("blocked").cast("double")).alias("overall"))
    rows = rows.crossJoin(F.broadcast(overall)).withColumn("overall", F.coalesce("overall", F.lit(0.5)))  # one row
    for name in ("suffix", "domain", "segment"):
        of = [F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(FOLDS)] + [F.count_if((F.col("fold") == k) & F.col("blocked")).alias(f"b{k}") for k in range(FOLDS)]
        stats = known.groupBy(F.col(name).alias("of")).agg(*of)
        rows = rows.join(stats, F.col(name) == F.col("of"), "left").drop("of")
        others = lambda x: sum((F.when(F.col("fold").isNull() | (F.col("fold") != k), F.coalesce(f"{x}{k}", F.lit(0))).otherwise(0) for k in range(FOLDS)), F.lit(0))  # noqa: E731, B023
        rows = rows.withColumns({f"{name}_count": F.log1p(others("n")), f"{name}_blocked": (others("b") + 10 * F.col("overall")) / (others("n") + 10)})
        rows = rows.drop(*(f"{x}{k}" for x in "nb" for k in range(FOLDS)))
    return rows.drop("overall")


def fit(labelled: DataFrame, most: int = 20_000, trees: int = 20, depth: int = 4) -> GBTClassificationModel | str:
    """Trees learned from at most ``most`` rows (url, blocked, FEATURES), drawn by a hash; both verdicts weigh the same.

    Where only one verdict occurs it is returned, and ``allow`` without any labelled URL.
    """
    count, bad = labelled.agg(F.count("*"), F.count_if("blocked")).first()
    if bad in (0, count):
        return "block" if bad else "allow"
    share = min(1.0, (1.5 * most + 100) / count)  # what can be in the sample: only that is sorted
    sample = labelled.where(uniform(1, "url") <= share).select(F.col("blocked").cast("double").alias("label"), *FEATURES, uniform(1, "url").alias("k"))
    sample = written(sample.orderBy("k", *FEATURES).limit(most), "urls")
    sample = sample.withColumn("weight", F.when(F.col("label") == 1.0, 0.5 * count / bad).otherwise(0.5 * count / (count - bad)))
    learner = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=1.0, seed=1)
    return learner.fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(sample))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row.

    The longest fitting rule decides; where none fits, boosted trees do. They learn from ``labelled`` (url string,
    blocked boolean; rows with a null are left out), by default from the URLs of ``pages`` that rules decide. The
    statistics of suffixes, domains and first path segments are counted over all labelled URLs. A null URL or one
    without ``://`` has empty host and path and goes to the trees as such. Repeated rows get equal rows; an empty
    table gives an empty result; very long URLs are read whole; other columns are ignored.
    """

    def read(df: DataFrame, *keep: str) -> DataFrame:
        host, path = parts(F.col("url"))
        return _lexical(df.select(*keep, F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path}))

    rows = read(pages, "page_id")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    if labelled is None:
        known = rows.where("ruled IS NOT NULL").withColumns({"blocked": F.col("ruled") == "block", "fold": fold})
    else:
        known = read(labelled.where("url IS NOT NULL AND blocked IS NOT NULL"), "blocked").withColumn("fold", fold)
    model = fit(_told(known, known))
    if isinstance(model, str):
        said = rows.withColumn("said", F.lit(model))
    else:
        told = _told(rows.withColumn("fold", F.lit(None).cast("long")), known)
        said = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(told)).withColumn("said", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return said.select("page_id", "host", "path", "rule", F.coalesce("ruled", "said").alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every row of ``pages``."""
    return judged(table(spark, sf_dir, "pages"))
