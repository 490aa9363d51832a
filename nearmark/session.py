"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# What the results or the join strategies depend on; a user's session keeps its own partition sizes.
SETTINGS = {
    # A repeated key in a JSON object keeps its last value instead of making the whole record unparsable.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
# For one machine only: a small table of distinct strings grows into many keys, so it must stay spread over
# all cores; at the default sizes adaptive execution would merge it into one or two tasks.
LOCAL_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context."""
    context = spark.sparkContext
    if not getattr(context, "_nearmark_shipped", False):
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='nearmark-code-')}/{root.name}", "zip",
                                      root.parent, root.name)
        context.addPyFile(archive)
        context._nearmark_shipped = True


def local_session(cores: str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nearmark")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in (SETTINGS | LOCAL_SETTINGS).items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors would not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="nearmark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scope = getattr(_scopes, "paths", None)
    if scope is not None:
        scope.append(path)
    return path


_scopes = threading.local()  # a stream's batches run in a thread of their own


@contextmanager
def _scope(paths: list[str] | None) -> Iterator[None]:
    outer = getattr(_scopes, "paths", None)
    _scopes.paths = paths
    try:
        yield
    finally:
        _scopes.paths = outer


def lasting_scratch():
    """Scratch tables that are written inside outlive the scope around."""
    return _scope(None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the scratch tables that were written inside. For work whose results are stored by then."""
    paths: list[str] = []
    try:
        with _scope(paths):
            yield
    finally:
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    The plans built on top start from files: they stay short, and a lost executor costs no recomputation
    of what led to the table.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table that comes in fewer partitions than there are cores; others stay as they are.

    For inputs that are small on disk and grow when they are taken apart.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
