"""What the operators share: input tables, tables written in the shared folder, file systems by URI."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and 0x09 to 0x0D, nothing else.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local one only where it is unset and all run in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="evalweave-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/") if "://" in where else "file://" + where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for a table or files of this run."""
    return f"{shared_dir(spark)}/evalweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and rereads it: its lineage ends there, and it outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast if it has at most so many rows; else Spark joins it as it does."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def give_back() -> None:
    """At the end of a task: what its worker has freed goes back to the system, as the worker stays for other tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI, wherever a task runs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def text_of(column: str) -> Column:
    """Null is the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z only, whatever the language."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of keys in which null equals null; an equi-join for Spark."""
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
