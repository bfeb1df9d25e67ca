"""Session helpers: shared storage for intermediate tables, lineage cuts, sizing, what workers keep."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the session names none and is local (tests, a laptop) a temporary folder is set.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fathomweave-"))
            current = spark.sparkContext.getCheckpointDir()
        named = current
    return f"{named.rstrip('/')}/fathomweave/{spark.sparkContext.applicationId}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session; call it before a Python function enters a plan."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fathomweave-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Paths of the tables written by this process, in order.
_WRITTEN: list[str] = []


def written_so_far() -> int:
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int, keep: set[str]) -> None:
    """Removes the tables written after the first ``since`` ones, but for those in ``keep``."""
    for path in _WRITTEN[since:]:
        if path not in keep:
            drop_table(spark, path)
    _WRITTEN[since:] = [p for p in _WRITTEN[since:] if p in keep]


def write_table(df: DataFrame, tag: str, partition_by: list[str] | None = None, compression: str | None = None) -> tuple[DataFrame, str]:
    """Writes ``df`` once to the shared folder and returns the table read back, with its path.

    This cuts the lineage: whatever executor is lost later, the rows are in shared storage.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write if compression is None else df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table written by :func:`write_table` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that ``path`` names (file, hdfs, s3, ...; without a scheme: local) and the path in it, for Python code in tasks."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", path))


#: What this Python worker keeps between tasks: one thing at most.
_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gave for ``key`` in an earlier task of this Python worker, or gives now; what was kept for another key goes, so that no stage pays for the memory of the one before."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Frees what this Python worker keeps; for functions that keep nothing themselves, whose stage would carry it along."""
    if _HELD:
        _HELD.clear()
        gc.collect()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
