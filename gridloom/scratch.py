"""Tables written between steps, in the folder that all machines see."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidParameters


def _hadoop_path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI, its file system being the one that Spark would take."""
    place, system = _hadoop_path(spark, path)
    return system.makeQualified(place).toString()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (not made yet) below ``spark.checkpoint.dir``, as a URI.

    Where the session names no such folder, a local session (as in tests) gets
    one; on a cluster that is an error, as machines share no temporary folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise InvalidParameters("set spark.checkpoint.dir to a folder that all machines see")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-gridloom-"))
        base = sc.getCheckpointDir()
    return qualified(spark, posixpath.join(base, f"{name}-{uuid.uuid4().hex}"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps start
    from files that outlive any executor."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    _note(out)
    return out


#: The tables saved so far in the innermost ``steps`` block.
_noted: ContextVar[list[DataFrame] | None] = ContextVar("noted", default=None)


def _note(df: DataFrame) -> None:
    noted = _noted.get()
    if noted is not None:
        noted.append(df)


@contextmanager
def steps() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At the end of the block the tables that were saved in it are removed, but
    for those given to the function that it yields.  What leaves the block must
    not read the others any more.  Blocks may stand in one another."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    token = _noted.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _noted.reset(token)
        places = {df._saved_at for df in kept}
        discard(*(df for df in made if df._saved_at not in places))
        for df in kept:
            _note(df)


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of ``saved`` tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_saved_at", None)
        if path:
            place, system = _hadoop_path(df.sparkSession, path)
            system.delete(place, True)
