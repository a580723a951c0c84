"""The folder that driver and executors share, and how a plan is cut there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_scopes: list[list[str]] = []


#: Bytes of the batches that workers get: texts are long, and a batch is held several times over on its way.
BATCH_BYTES = 4 << 20


def lean(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let this session hand workers batches of ``most`` bytes at most, if it would hand them larger ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if now is None or int(now[1]) > most:
        spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``; only where that is unset (tests on one machine), a
    temporary folder.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/skerry/{spark.sparkContext.applicationId}"
    if not conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="skerry-")
    return _local["dir"]


def new_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A path of its own in the shared folder; deleted with the scope it is made in (``keep``: the one around)."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    at = len(_scopes) - (2 if keep else 1)
    if at >= 0:
        _scopes[at].append(path)
    return path


def cut(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lost executors cost one task, not the lineage."""
    path = new_path(df.sparkSession, tag, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uri(path: str) -> str:
    """A path as the URI that Arrow's file systems take."""
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def delete(spark: SparkSession, name: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut inside is deleted at the end, but for tables cut with ``keep`` (a result still reads those)."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application cut, once no result is read any more."""
    delete(spark, shared_dir(spark))


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``, once nothing reads it any more."""
    for name in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(df.sparkSession, name)
