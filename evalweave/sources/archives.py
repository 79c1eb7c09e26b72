"""Members of tar and ZIP archives as rows."""

from __future__ import annotations

import hashlib
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def safe(name: str) -> bool:
    """Whether a member's name stays below the folder it is unpacked in."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0]


def _tar(data: bytes) -> Iterator[tuple[str, int, Callable[[], bytes] | None]]:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if not m.isdir():
                yield m.name, m.size, (lambda m=m: t.extractfile(m).read()) if m.isreg() else None  # links have no content of their own


#: Archives inside an archive that are opened.
NESTED = 4


def _nested_tar(data: bytes, prefix: str = "", opened: list | None = None) -> Iterator[tuple[str, int, Callable[[], bytes] | None]]:
    """As _tar, and the members of .tar.gz members under their names; more than NESTED of those are an error."""
    opened = [] if opened is None else opened
    for name, size, read in _tar(data):
        if read is not None and name.endswith(".tar.gz") and safe(prefix + name):
            opened.append(name)
            if len(opened) > NESTED:
                raise tarfile.TarError("too many nested archives")
            yield from _nested_tar(read(), f"{prefix}{name[:-7]}/", opened)
        else:
            yield prefix + name, size, read


def _zip(data: bytes) -> Iterator[tuple[str, int, Callable[[], bytes] | None]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.infolist():
            if not m.is_dir():
                yield m.filename, m.file_size, lambda m=m: z.read(m)


def members(spark: SparkSession, folder: str, pattern: str, suffix: str | tuple[str, ...] = "", most_bytes: int = 128 << 20, nested: bool = False) -> DataFrame:
    """archive, member, bytes, sha256, content, fault: members of the archives whose names end in suffix.

    A link, a name that leads outside, a name that is there before, or a member over most_bytes has a fault and no content; an
    archive that can't be read is one row with a fault. An archive is one task's row, as Spark reads files whole. With `nested`,
    .tar.gz members of a tar archive are opened too; one that is too deep or broken is a row with a fault after those before it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                rows, seen = [], set()
                try:
                    for name, size, read in (_zip if zipfile.is_zipfile(io.BytesIO(data)) else _nested_tar if nested else _tar)(data):
                        if not name.endswith(suffix):
                            continue
                        fault = "link" if read is None else "path" if not safe(name) else "repeated" if name in seen else "size" if size > most_bytes else None
                        seen.add(name)
                        own = None if fault else read()
                        rows.append((path, name, size, own if own is None else hashlib.sha256(own).hexdigest(), own, fault))
                except (tarfile.TarError, zipfile.BadZipFile, EOFError) as e:
                    rows.append((path, None, None, None, None, str(e) or type(e).__name__))
                yield pd.DataFrame(rows, columns=["archive", "member", "bytes", "sha256", "content", "fault"]).astype({"bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, "archive string, member string, bytes long, sha256 string, content binary, fault string")


def complete(found: DataFrame, suffixes: list[str]) -> DataFrame:
    """archive, stem: names for which a sound member with each suffix is there."""
    kind = F.when(F.lit(False), "")
    for s in suffixes:
        kind = kind.when(F.col("member").endswith(s), s)
    k = found.filter("fault is null").withColumn("kind", kind).filter("kind is not null")
    k = k.withColumn("stem", F.regexp_extract(F.expr("left(member, length(member) - length(kind))"), "([^/]*)$", 1))
    return k.groupBy("archive", "stem").agg(F.count_distinct("kind").alias("n")).filter(F.col("n") == len(suffixes)).select("archive", "stem")
