"""Writers: rows stay distributed; one folder for each table, keyed by cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juriscope.functions import courts as court_fn
from juriscope.functions import taxonomy as tax


def write_opinions(pages: DataFrame, path: str, fmt: str = "parquet", files: int | None = None) -> None:
    """K1: pages by cluster, replacing what was there. JSON has one line a page, dealt
    by cluster; a file for each page would burden any large store."""
    pages = pages.repartition(files, "cluster_id") if files else pages
    pages.write.mode("overwrite").format(fmt).save(path)


def read_opinions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """K4: all pages again."""
    return spark.read.format(fmt).load(path)


def write_index(index: DataFrame, path: str, order: list) -> None:
    """K2: the index sorted through range partitions, so files in name order are in order."""
    index.orderBy(*order).write.mode("overwrite").json(path)


def side_tables(spark: SparkSession, courts: DataFrame) -> dict[str, DataFrame]:
    """K3: the small tables beside the pages."""
    return {
        "courts": court_fn.court_list(courts),
        "court_picker": court_fn.court_picker(courts),
        "court_categories": court_fn.dim_category(spark),
        "court_jurisdictions": court_fn.dim_jurisdiction(spark),
        "treatments": tax.treatment_table(spark),
        "treatment_definitions": tax.definitions(spark),
    }


def write_side_tables(spark: SparkSession, courts: DataFrame, path: str) -> None:
    for name, table in side_tables(spark, courts).items():
        table.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def build_stamp(spark: SparkSession) -> DataFrame:
    """K6: when a build was made."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd").alias("date"), F.lower(F.conv(F.unix_millis(F.current_timestamp()).cast("string"), 10, 36)).alias("version"))
