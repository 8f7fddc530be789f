"""Lines whose parts read alike are compared once."""

from pyspark.sql import functions as F

from lotwright.functions import identity as I
from lotwright.plans import listings

DATA = "/root/testdata/sf0.001"


def test_each_pair_of_contents_is_compared_once(spark, monkeypatch):
    seen, evaluated = [], I.evaluated
    monkeypatch.setattr(listings.I, "evaluated", lambda rows, lot, offer: (seen.append(rows), evaluated(rows, lot, offer))[1])
    listings._pairs(spark, DATA)
    pairs = seen[0].select(F.to_json("lot").alias("lot"), "offer.title")
    n = pairs.count()
    assert 0 < n == pairs.distinct().count() < spark.read.parquet(f"{DATA}/lineitem.parquet").count()
