"""What several operators need: shared folders, files on any store, text columns."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space (a fixed value of the query contracts).
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir. Where that is unset, a session of one process gets a temporary folder, and any other an error: its executors wouldn't see the driver's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "skyledger-shared")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation of what came before."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> Column:
    """A whole row of df as one struct with fields c0, c1, ...: beside it, helper columns can't clash with the names of df."""
    return F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(df.columns)])


def unpacked(df: DataFrame, like: DataFrame, row: str = "row") -> DataFrame:
    """The columns of ``like`` again, from the struct that packed() made of them."""
    return df.select(*[F.col(f"{row}.c{k}").alias(c) for k, c in enumerate(like.columns)])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_text(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def file_system(path: str):
    """(file system, path inside it) for a URI or a plain path, by pyarrow, so that workers read and write any store it knows."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return fs.LocalFileSystem(), os.path.abspath(path)


@contextmanager
def atomic_file(path: str):
    """A binary stream that appears under its name only when it is complete; of several attempts at one file, the last complete one stays."""
    files, at = file_system(path)
    files.create_dir(os.path.dirname(at), recursive=True)
    draft = f"{at}.{uuid.uuid4().hex}.part"
    try:
        with files.open_output_stream(draft, compression=None) as out:
            yield out
        files.move(draft, at)
    except BaseException:
        try:
            files.delete_file(draft)
        except OSError:
            pass
        raise


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt to all cores if it is smaller than the least that Spark would give each (spark.sql.files.openCostInBytes): such a table often lies in one row group, which one task reads. Larger ones stay as they are."""
    spark = df.sparkSession
    cores, least = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < size < cores * least else df


def one_task_each(df: DataFrame, together: int = 1) -> DataFrame:
    """The rows of a small table (one for each file, say) dealt by turns to tasks of ``together`` rows, or of fewer where cores would be idle; small as they are, adaptive execution would put them into one."""
    n = df.count()
    return df.repartition(max(1, -(-n // together), min(n, df.sparkSession.sparkContext.defaultParallelism)))


_KEPT: dict = {}


def kept(key: tuple | None = None, make=None):
    """What a Python worker keeps from task to task: one thing at a time, so that a worker that goes from one operator to the next doesn't hold both. Without a key nothing is kept."""
    if key not in _KEPT:
        _KEPT.clear()
        if key is None:
            return None
        _KEPT[key] = make()
    return _KEPT[key]
