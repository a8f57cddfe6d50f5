"""Tables that are written once into the folder that driver and executors share, and read many times."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the cluster names one. A temporary folder
    only where none is named and all runs on one machine, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster has to name spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="titleforge-")
    return _OWN_DIR[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, and outlives lost executors. The table goes at the end
    of the driver's process, or earlier by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._titleforge_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*dfs: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in dfs:
        path = df._titleforge_path
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def written() -> set[str]:
    """The tables of :func:`materialize` that are still there."""
    return {path for _, path in _WRITTEN}


def release_since(before: set[str], *keep: DataFrame) -> None:
    """Delete what was written since, but for ``keep``."""
    kept = before | {df._titleforge_path for df in keep}
    for spark, path in [x for x in _WRITTEN if x[1] not in kept]:
        _delete(spark, path)
        _WRITTEN.remove((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the JVM may be gone already
                return
