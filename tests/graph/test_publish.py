"""Builds write what changed; pages of opinions that went are gone."""

import os

import pytest
from juriscope.sources import publish
from pyspark.sql import functions as F


def pages(spark, rows):
    return spark.createDataFrame(rows, "cluster_id long, title string, cites array<struct<n:int,tier:string>>")


FIRST = [(i, f"Opinion {i}", [(i % 3, "Stop")] if i % 2 else None) for i in range(60)]


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def shown(frame):
    return sorted(tuple(r) for r in frame.select("cluster_id", "title").collect())


def test_second_build_writes_the_difference(spark, tmp_path):
    root = str(tmp_path / "site")
    assert publish.versions(spark, root) == [] and publish.manifest(spark, root) is None
    assert publish.publish(pages(spark, FIRST), root, buckets=4) == publish.Report(1, 60, 0, 0, 0)
    before = files(f"{root}/pages")
    second = [(i, "New title" if i == 7 else t, c) for i, t, c in FIRST if i not in (3, 4)] + [(99, "Late", [])]
    assert publish.publish(pages(spark, second).select("cites", "title", "cluster_id"), root, buckets=8) == publish.Report(2, 1, 1, 57, 2)
    after = files(f"{root}/pages")
    assert all(after[f] == at for f, at in before.items())
    assert spark.read.parquet(f"{root}/pages/version=2").count() == 2
    assert shown(publish.read(spark, root)) == sorted((i, t) for i, t, _ in second)
    assert shown(publish.read(spark, root, version=1)) == [(i, t) for i, t, _ in FIRST]
    # One page at a time: a page that stayed, one that changed, one that went.
    assert [shown(publish.page(spark, root, i)) for i in (5, 7, 3)] == [[(5, "Opinion 5")], [(7, "New title")], []]
    plan = publish.page(spark, root, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    # The same pages again: nothing is written, null and empty lists differ.
    assert publish.publish(pages(spark, second), root, buckets=8) == publish.Report(3, 0, 0, 59, 0)
    assert publish.vacuum(spark, root) == [] or shown(publish.read(spark, root)) == sorted((i, t) for i, t, _ in second)
    assert publish.publish(pages(spark, [(i, t, c or []) for i, t, c in second]), root) == publish.Report(4, 0, 29, 30, 0)


def test_builds_that_stop_and_stale_files(spark, tmp_path):
    root = str(tmp_path / "site")
    publish.publish(pages(spark, FIRST), root, buckets=2)
    # A build that was broken off: pages without a manifest, or a manifest without its end.
    pages(spark, [(1, "broken", None)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{root}/pages/version=2")
    os.makedirs(f"{root}/manifest/version=2")
    assert publish.versions(spark, root) == [1] and len(shown(publish.read(spark, root))) == 60
    every = [(i, t + "!", c) for i, t, c in FIRST]
    assert publish.publish(pages(spark, every), root, buckets=2) == publish.Report(2, 0, 60, 0, 0)
    assert publish.vacuum(spark, root) == [1] and not os.path.exists(f"{root}/pages/version=1")
    assert shown(publish.read(spark, root)) == [(i, t) for i, t, _ in every]
    assert publish.publish(pages(spark, []), root, buckets=2) == publish.Report(3, 0, 0, 0, 60)
    assert shown(publish.read(spark, root)) == []
    with pytest.raises(ValueError):
        publish.manifest(spark, root, 1)


def test_keys_and_columns(spark, tmp_path):
    root = str(tmp_path / "site")
    for rows in ([(1, "a", None), (1, "b", None)], [(None, "a", None)]):
        with pytest.raises(ValueError):
            publish.publish(pages(spark, rows), root)
    with pytest.raises(ValueError):
        publish.publish(pages(spark, FIRST).withColumn("_hash", F.lit("")), root)
    with pytest.raises(FileNotFoundError):
        publish.read(spark, root)
    publish.publish(pages(spark, FIRST), root)
    # A new column changes every page.
    assert publish.publish(pages(spark, FIRST).withColumn("a.b", F.lit(1)), root).changed == 60
