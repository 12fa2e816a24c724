"""Session helpers: how tests, the bench and notebooks start Spark."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution settles partition counts, join strategies and skew at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cpus: int | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster spark-submit provides master and resources and this adds only DEFAULTS."""
    builder = SparkSession.builder.appName("foliant")
    if "SPARK_SUBMIT" not in os.environ:
        builder = builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '*')}]")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "4g"} | conf
    return builder.config(map=settings).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application: they may run elsewhere, or start in another folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    path = os.path.realpath(f"{tempfile.mkdtemp(prefix='foliant-')}/foliant.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a folder of our own only in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='foliant-')}")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the scratch folder: its lineage ends there, and a lost executor costs no recomputation before it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that a worker no longer uses goes back to the machine: workers live on after a stage, beside the next one's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)
