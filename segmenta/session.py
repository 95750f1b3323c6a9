"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "segmenta", cores: int = 8, partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SEGMENTA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided parquet tables; times without a zone are read as UTC session times."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to the executors once, for functions that run in Python there."""
    sc = spark.sparkContext
    if not getattr(sc, "_segmenta_package", False):
        root = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="segmenta-package-"), "segmenta-package")
        sc.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(root), os.path.basename(root)))
        sc._segmenta_package = True
    return spark
