"""Sinks: JSON lines, caches with a manifest, WAV files and silence, exports, and reports as Markdown.

Tables are written by Spark, whose committer shows a folder only when it is whole. Files that a task writes itself go to a
name of the attempt's own and are renamed, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.sources.wav import encode


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def fresh(prefix: str, now: dt.datetime | None = None) -> str:
    """A new folder's name by time, with a part that no other run has."""
    return f"{prefix}-{(now or dt.datetime.now()).strftime('%Y%m%d-%H%M%S')}-{uuid.uuid4().hex[:8]}"


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, nulls included; an error if the folder is there."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def content_digest(df: DataFrame) -> dict[str, int]:
    """rows and a sum of row hashes: the same for the same rows in any order and any partitions."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) for c in sorted(df.columns)])
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return {"rows": got["n"], "digest": int(got["s"])}


def write_cache(df: DataFrame, path: str, inputs: dict[str, str]) -> None:
    """A Parquet table with a manifest of what it was made from and what it holds, written last."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    own = content_digest(df.sparkSession.read.parquet(f"{path}/data"))
    fs, folder = file_system(path)
    with fs.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"inputs": inputs, **own}, sort_keys=True).encode())


def read_cache(spark: SparkSession, path: str, inputs: dict[str, str]) -> DataFrame | None:
    """The table, if it was made from the same inputs and holds what was written; else None."""
    fs, folder = file_system(path)
    try:
        with fs.open_input_stream(f"{folder}/manifest.json") as f:
            manifest = json.loads(f.read())
    except FileNotFoundError:
        return None
    if manifest["inputs"] != inputs:
        return None
    df = spark.read.parquet(f"{path}/data")
    return df if content_digest(df) == {k: manifest[k] for k in ("rows", "digest")} else None


def input_signature(spark: SparkSession, path: str) -> dict[str, str]:
    """size and time of each input file by path: a few rows, not contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return {r["path"]: f"{r['length']}@{r['modificationTime'].isoformat()}" for r in files.select("path", "length", "modificationTime").collect()}


def _write_files(df: DataFrame, out: str, name: str, make) -> DataFrame:
    """file, bytes, sha256: each row's bytes, written below out by the tasks themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = file_system(out)
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                target, data = f"{folder}/{r[name]}", make(r)
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                temporary = f"{target}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(temporary) as f:
                    f.write(data)
                fs.move(temporary, target)
                rows.append((r[name], len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["file", "bytes", "sha256"])

    return df.mapInPandas(run, "file string, bytes long, sha256 string")


def write_wav(df: DataFrame, out: str, name: str, samples: str, rate: str, bits: int = 32) -> DataFrame:
    """WAV files of one channel, named by a column; samples clipped to -1 and 1, those that aren't finite refused."""
    return _write_files(df.select(name, samples, rate), out, name, lambda r: encode(np.asarray(r[samples], float), int(r[rate]), bits))


def write_silence(df: DataFrame, out: str, name: str, frames: str, rate: str, bits: int = 16) -> DataFrame:
    """All-zero WAV files with the given numbers of frames: a paired control for each source."""
    return _write_files(df.select(name, frames, rate), out, name, lambda r: encode(np.zeros(int(r[frames])), int(r[rate]), bits))


def export(df: DataFrame, out: str, path: str, content: str) -> DataFrame:
    """The files of a column copied to out/audio and the other columns, with that path rewritten, to out/records: a folder that needs no other."""
    _own = F.concat(F.lit("audio/"), F.element_at(F.split(F.translate(F.col(path), "\\", "/"), "/"), -1))
    named = df.withColumn(path, _own)
    copies = _write_files(named.select(path, content), out, path, lambda r: bytes(r[content]))
    copies.write.mode("errorifexists").parquet(f"{out}/files")
    write_lines(named.drop(content), f"{out}/records")
    return df.sparkSession.read.parquet(f"{out}/files")


def percent(c: Column, places: int = 2) -> Column:
    return F.concat(F.format_number(c * 100, places), F.lit("%"))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small frame (counts and metrics by class) as Markdown; more rows than `most` are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report's table has at most {most} rows")
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in rows])


def report(title: str, sections: list[tuple[str, DataFrame]], notes: list[str] | None = None) -> str:
    """A report of small frames, one section each, and notes at its end."""
    parts = [f"# {title}"] + [f"## {i}. {name}\n\n{markdown_table(df)}" for i, (name, df) in enumerate(sections, 1)]
    if notes:
        parts.append("## Notes\n\n" + "\n".join(f"- {n}" for n in notes))
    return "\n\n".join(parts) + "\n"


def write_gzip_lines(df: DataFrame, path: str, keys: list[str], files: int = 1) -> None:
    """JSON lines in gzip files with nothing of the time in them: the same rows give the same bytes, ordered by their keys."""
    rows = df.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    rows.write.mode("errorifexists").option("ignoreNullFields", False).option("compression", "gzip").json(path)


def export_tar(df: DataFrame, out: str, path: str, content: str, packed: bool = True) -> DataFrame:
    """file, members: tar files below out, one a partition, that hold the files of a column under audio/ and the other columns,
    with that path rewritten, as records.jsonl. Times and owners are left out, so the same rows give the same bytes.
    """
    import io
    import tarfile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fs, folder = file_system(out)
        fs.create_dir(folder, recursive=True)
        name = f"export-{TaskContext.get().partitionId():05d}.tar" + (".gz" if packed else "")
        temporary, lines, n = f"{folder}/{name}.{uuid.uuid4().hex}.tmp", [], 0
        tar = None
        for b in batches:
            for r in b.to_dict("records"):
                if tar is None:
                    raw = fs.open_output_stream(temporary)
                    to = gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) if packed else raw
                    tar = tarfile.open(fileobj=to, mode="w|")
                data, own = bytes(r.pop(content)), "audio/" + r[path].replace("\\", "/").rsplit("/", 1)[-1]
                for member, body in ((own, data),):
                    info = tarfile.TarInfo(member)
                    info.size = len(body)
                    tar.addfile(info, io.BytesIO(body))
                lines.append(json.dumps(r | {path: own}, sort_keys=True, default=str))
                n += 1
        if tar is not None:
            body = ("\n".join(lines) + "\n").encode()
            info = tarfile.TarInfo("records.jsonl")
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
            tar.close()
            if packed:
                to.close()
            raw.close()
            fs.move(temporary, f"{folder}/{name}")
            yield pd.DataFrame({"file": [name], "members": [n]})

    return df.mapInPandas(run, "file string, members long")
