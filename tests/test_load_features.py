"""Features of loads' series without a row a bin."""

import pytest
from pyspark.sql import functions as F

from crawlsift.operators import series
from crawlsift.plans import crawl, site_rows
from crawlsift.sources import captures

LOAD = ["key", "arm", "trial"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("loads"))
    spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.com/"), "id").alias("url"), F.lit("<p>x</p>").alias("html")).write.parquet(f"{root}/pages.parquet")
    made = crawl.loads(spark, root)
    calls, changes = captures.request_events(made), captures.mutation_events(made)
    late = F.when(F.col("place") == 1, F.col("time") + F.crc32("key") % 30000).otherwise(F.col("time"))
    return calls, changes.withColumn("time", late.cast("long")).localCheckpoint()


def test_same_features_as_over_the_bins(events):
    calls, changes = events
    stopped = captures.blocked_requests(calls)
    want = sorted(series.trial_features(series.capture_series(changes, stopped, LOAD), LOAD).collect())
    got = series.capture_features(changes, stopped, LOAD)
    assert sorted(got.collect()) == want and len(want) == 40 and len(got.columns) == 3 + 58


def test_site_series_group_no_bins(events, monkeypatch):
    def packed(*_):
        raise AssertionError("bins are collected to series again")

    monkeypatch.setattr(series, "packed", packed)
    calls, changes = events
    assert site_rows.series_of(changes, calls, 2).count() == 10
