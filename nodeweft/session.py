"""Session building and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: list[str] = []
#: The tables that each thread has staged.
_staged = threading.local()


def build_session(app: str = "nodeweft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer; `conf` overrides single settings."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def share(folder: str) -> None:
    """Names the folder for intermediate tables of sessions in which spark.checkpoint.dir is unset. Every executor must see
    it, as it sees an index that lies beside."""
    _own_folders.insert(0, folder.rstrip("/"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, where every executor can read what another wrote.

    Where it is unset, the folder named by `share` is taken; failing that, a local session gets a temporary folder of its own
    (removed at exit), and a cluster session is refused, since a folder of one machine would not be seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not _own_folders:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own_folders.append(tempfile.mkdtemp(prefix="nodeweft-"))
        atexit.register(shutil.rmtree, _own_folders[0], ignore_errors=True)
    return _own_folders[0]


def _path(spark: SparkSession, path: str):
    """A path and the file system it lies in, local or not."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(path: str) -> str | None:
    """The text of a small file in any file system that Spark reads; None where there is none."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    p, system = _path(spark, path)
    if not system.exists(p):
        return None
    stream = system.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Replaces a small file: written beside it and then renamed."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    p, system = _path(spark, path)
    new, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not system.rename(new, p):
        system.delete(p, False)
        system.rename(new, p)


def remove(path: str) -> None:
    """Deletes a folder or file, if it is there."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    p, system = _path(spark, path)
    system.delete(p, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` as a table into the shared folder and read it back: the lineage ends there.

    A lost executor costs only the tasks that read the table, never the work that made it, and a plan that uses the
    result twice runs it once. The table stays until `release` is called or the folder is cleaned.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _staged.__dict__.setdefault("paths", []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the tables that this thread has staged. To be called where no lazy result of the thread still reads them, as
    after a result is written or sent."""
    paths = _staged.__dict__.setdefault("paths", [])
    while paths:
        remove(paths.pop())
