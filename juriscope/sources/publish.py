"""Versioned publishing: a build writes the pages that changed, and those alone.

``<root>/pages/version=V/bucket=B`` holds the pages that build V wrote, dealt by their key;
``<root>/manifest/version=V/bucket=B`` names every page of build V: key, content hash and the
version that holds it; ``<root>/schema`` keeps each build's columns.  A manifest is written last, so a build counts when its manifest is
whole, and one that is broken off leaves nothing that readers see.  Pages whose opinion went
have no row in the manifest; ``vacuum`` deletes files that no kept manifest names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from juriscope.sources.scratch import written

#: Folders that pages are dealt to; a manifest keeps its own number.
BUCKETS = 32


@dataclass(frozen=True)
class Report:
    """What a build did, in pages."""

    version: int
    added: int
    changed: int
    same: int
    removed: int


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """The builds whose manifest is whole, oldest first."""
    fs, at = _fs(spark, f"{root}/manifest")
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("version=")]
    whole = [p for p in names if fs.exists(_fs(spark, f"{p}/_SUCCESS")[1])]
    return sorted(int(p.getName().partition("=")[2]) for p in whole)


def schema(spark: SparkSession, root: str, version: int) -> StructType:
    """The columns of a build's pages."""
    return StructType.fromJson(json.loads(spark.read.text(f"{root}/schema/version={version}", wholetext=True).head()[0]))


def manifest(spark: SparkSession, root: str, version: int | None = None, key: str = "cluster_id") -> DataFrame | None:
    """(key, hash, held_by, buckets, bucket) of a build, the last one by default; None where
    there is none."""
    known = versions(spark, root)
    if version is None and not known:
        return None
    if version is not None and version not in known:
        raise ValueError(f"no build {version} in {root}")
    at = known[-1] if version is None else version
    kind = schema(spark, root, at)[key].dataType.simpleString()
    return spark.read.schema(f"key {kind}, hash string, held_by int, buckets int, bucket int").parquet(f"{root}/manifest/version={at}")


def _bucket(key: Column, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n) if isinstance(n, int) else n).cast("int")


def content_hash(pages: DataFrame, key: str) -> Column:
    """A digest of a page's columns, their names and types; columns in another order are the
    same page."""
    rest = sorted(c for c in pages.columns if c != key)
    types = dict(pages.dtypes)
    shape = F.sha2(F.lit("\n".join(f"{c} {types[c]}" for c in rest)), 256)
    return F.sha2(F.concat(shape, F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]), {"ignoreNullFields": "false"})), 256)


def publish(pages: DataFrame, root: str, key: str = "cluster_id", buckets: int = BUCKETS) -> Report:
    """Writes ``pages`` as the next build of ``root`` and returns what it did.

    Each page needs a key of its own: null and repeated keys are an error. No pages at all is
    a build that removes every page."""
    spark = pages.sparkSession
    held = {"_hash", "bucket", "version"} & set(pages.columns)
    if held:
        raise ValueError(f"columns of the manifest: {sorted(held)}")
    # Pages are made once: hashed, told apart from the last build's, and written from there.
    now = written(pages.withColumn("_hash", content_hash(pages, key)), "pages")
    twice = now.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n").__gt__(1) | F.col(key).isNull()).select(key).head()
    if twice:
        raise ValueError(f"key is null or repeated: {twice[0]}")
    known = versions(spark, root)
    version = known[-1] + 1 if known else 1
    new = now.select(F.col(key).alias("key"), F.col("_hash").alias("new"))
    if known:
        old = manifest(spark, root, key=key).select("key", F.col("hash").alias("old"), "held_by", F.col("bucket").alias("at"), F.col("buckets").alias("of"))
        both = new.join(old, "key", "full")
    else:
        both = new.withColumns({"old": F.lit(None).cast("string"), "held_by": F.lit(None).cast("int"), "at": F.lit(None).cast("int"), "of": F.lit(None).cast("int")})
    state = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    both = written(both.withColumn("state", state), "page_states")
    fresh = both.filter("state IN ('added', 'changed')").select(F.col("key").alias(key))
    laid = now.join(fresh, key, "left_semi").drop("_hash").withColumn("bucket", _bucket(F.col(key), buckets))
    laid.repartition(buckets, "bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/pages/version={version}")
    spark.createDataFrame([(pages.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/schema/version={version}")
    rows = both.filter("state <> 'removed'")
    stays = F.col("state") == "same"
    listed = rows.select("key", F.col("new").alias("hash"), F.when(stays, F.col("held_by")).otherwise(F.lit(version)).alias("held_by"), F.when(stays, F.col("of")).otherwise(F.lit(buckets)).alias("buckets"), F.when(stays, F.col("at")).otherwise(_bucket(F.col("key"), buckets)).alias("bucket"))
    listed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/manifest/version={version}")
    n = {r.state: r["count"] for r in both.groupBy("state").count().collect()}
    return Report(version, *[n.get(s, 0) for s in ("added", "changed", "same", "removed")])


def _pages(spark: SparkSession, root: str, shape: StructType, held: list[int]) -> DataFrame:
    """All pages that some builds wrote, with their version and bucket."""
    rows = spark.read.schema(StructType([*shape.fields]).add("bucket", IntegerType()).add("version", IntegerType())).option("basePath", f"{root}/pages")
    return rows.parquet(*[f"{root}/pages/version={v}" for v in held])


def read(spark: SparkSession, root: str, key: str = "cluster_id", version: int | None = None) -> DataFrame:
    """K4: the pages of a build, the last one by default."""
    m = manifest(spark, root, version, key)
    if m is None:
        raise FileNotFoundError(f"no build in {root}")
    shape = schema(spark, root, versions(spark, root)[-1] if version is None else version)
    held = sorted(r.held_by for r in m.select("held_by").distinct().collect())
    if not held:
        return spark.createDataFrame([], shape)
    named = m.select(F.col("key").alias(key), F.col("held_by").alias("version"), "bucket")
    return _pages(spark, root, shape, held).join(named, [key, "version", "bucket"], "left_semi").select(*[f"`{c}`" for c in shape.names])


def page(spark: SparkSession, root: str, value: int, key: str = "cluster_id") -> DataFrame:
    """K7: one page by its key. The manifest and the pages are read in one folder each."""
    m = manifest(spark, root, key=key)
    if m is None:
        raise FileNotFoundError(f"no build in {root}")
    shape = schema(spark, root, versions(spark, root)[-1])
    dealt = [r[0] for r in m.select("buckets").distinct().collect()]
    here = [spark.range(1).select(_bucket(F.lit(value).cast(shape[key].dataType), n)).head()[0] for n in dealt]
    row = m.filter(F.col("bucket").isin(here) & (F.col("key") == F.lit(value))).head()
    if row is None:
        return spark.createDataFrame([], shape)
    files = _pages(spark, root, shape, [row.held_by])
    return files.filter((F.col("bucket") == row.bucket) & (F.col(key) == F.lit(value))).select(*[f"`{c}`" for c in shape.names])


def vacuum(spark: SparkSession, root: str, keep: int = 1, key: str = "cluster_id") -> list[int]:
    """Deletes all manifests but the last ``keep``, and the pages of builds that none of them
    names; returns the builds whose pages went. Not to be run beside a build."""
    known = versions(spark, root)
    kept = known[-max(keep, 1) :]
    named = {r.held_by for v in kept for r in manifest(spark, root, v, key).select("held_by").distinct().collect()}
    gone = []
    for folder, stays in (("manifest", set(kept)), ("pages", named)):
        fs, at = _fs(spark, f"{root}/{folder}")
        for status in fs.listStatus(at) if fs.exists(at) else []:
            v = status.getPath().getName().partition("version=")[2]
            if v.isdigit() and int(v) not in stays:
                fs.delete(status.getPath(), True)
                gone += [int(v)] if folder == "pages" else []
    return sorted(gone)
