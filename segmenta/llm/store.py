"""Where lineage is cut and how batches reach Python.

Intermediate tables go to the shared folder named by spark.checkpoint.dir. Only
where that setting is absent (tests on one machine) a temporary folder is set.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: bytes of an Arrow batch, or one row
BATCH_BYTES = 1 << 20
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a fresh temporary one in local mode without the setting."""
    here = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        here = getattr(spark.sparkContext, "_segmenta_dir", None) or tempfile.mkdtemp(prefix="segmenta-")
        spark.sparkContext._segmenta_dir = here
    return here.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as parquet into the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/segmenta/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(*frames: DataFrame) -> None:
    """Remove the folders of saved tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/segmenta")
        root = root.getFileSystem(conf).makeQualified(root)
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            fs = path.getFileSystem(conf)
            # only folders that saved() made, right below the root
            if fs.makeQualified(path).getParent().toString() == root.toString():
                fs.delete(path, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the job that wrote them ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP, before)


def ready(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once and keep Arrow batches small for long texts."""
    sc = spark.sparkContext
    if not getattr(sc, "_segmenta_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for d, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(d, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        path = os.path.join(tempfile.mkdtemp(prefix="segmenta-ship-"), "segmenta.zip")
        with open(path, "wb") as f:
            f.write(buf.getvalue())
        sc.addPyFile(path)
        sc._segmenta_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def tidied(factory: Callable) -> Callable:
    """Functions over batches, made by factory, that give freed memory back when a task ends, as its worker lives on."""

    @functools.wraps(factory)
    def make(*args: object) -> Callable:
        run = factory(*args)

        def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pa.set_memory_pool(pa.system_memory_pool())
            try:
                yield from run(batches)
            finally:
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim is not None:
                    trim(0)

        return tidy

    return make
