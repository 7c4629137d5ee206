"""Shared-folder helpers: intermediate tables and files that survive lost executors.

Everything is written below the folder the cluster names in
``spark.checkpoint.dir``.  Only where that setting is absent (tests, notebooks on
``local[*]``) a temporary folder of the driver is used, which is then also the
executors' folder.
"""

from __future__ import annotations

import contextvars
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
#: What the run of this thread has made since its :func:`mark`; another thread's run has a list of its own.
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="cohortweave-")
    return _LOCAL_ROOT[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared root that no other call gets."""
    path = f"{shared_root(spark)}/cohortweave/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    files, where = _hadoop(spark, path)
    return files.exists(where)


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`stored` once nothing reads them any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        files, where = _hadoop(df.sparkSession, parent)
        files.delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now.

    They go when the driver's collector meets the job's plan, which in a job of many
    steps may be long after its result is stored.
    """
    spark.sparkContext._jvm.System.gc()


def mark() -> list[str]:
    """Begin a run: the list of what this thread makes from now on below the shared root, for :func:`release`."""
    made: list[str] = []
    _MADE.set(made)
    return made


def release(spark: SparkSession, made: list[str], keep: DataFrame | None = None) -> None:
    """Remove what the run has ``made`` since its :func:`mark`, but for the table ``keep``; what other runs made stays.

    For a step whose result is stored: nothing reads its intermediate tables any more.
    """
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in keep.inputFiles()} if keep is not None else set()
    stay = [p for p in made if p.rsplit("/", 1)[1] in kept]
    for path in made:
        if path not in stay:
            files, where = _hadoop(spark, path)
            files.delete(where, True)
    made[:] = stay


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or plain path, and the path on it."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return pafs.LocalFileSystem(), uri


def read_range(files: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    """``length`` bytes of a file from ``offset`` on, without reading the rest."""
    with files.open_input_file(path) as f:
        return f.read_at(length, offset)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
