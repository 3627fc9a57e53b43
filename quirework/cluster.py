"""What an operator needs from the cluster: the shared folder, lineage cuts and sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named in spark.checkpoint.dir.

    Only where that setting is absent in local mode (tests, a laptop) a temporary folder is made and removed at exit; on a
    cluster its absence is an error, as executors don't share one machine's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="quirework-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back: lineage ends there, a lost executor costs nothing."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/quirework-{uuid.uuid4().hex}"
    df.write.parquet(at)
    atexit.register(_delete, spark, at)
    read = spark.read.schema(df.schema).parquet(at)
    _WRITTEN[id(read)] = read, at
    return read


def release(df: DataFrame) -> None:
    """Deletes the files of a table that `cut` gave and that nothing reads any more."""
    _, at = _WRITTEN.pop(id(df), (None, None))
    if at:
        _delete(df.sparkSession, at)


def _delete(spark: SparkSession, at: str) -> None:
    try:
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already
        pass


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle that must not be coalesced."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
