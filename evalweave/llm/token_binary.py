"""Token ids of documents in range-coded binary files.

Documents go to tasks by ranges of (doc_id, hash of the text), null first, so that a doc_id that many rows share is split too.
Spark finds the ranges' bounds by a look at some rows: they decide where files end, never what is in them or comes out.
A task encodes its documents (tokens.py), appends an end id to each and writes them in this order as files of FILE_IDS ids,
about; rows with one doc_id are ordered by their ids in a file. A file:

    magic "EWTOK3\\n\\0", u64 bytes of the index, of the prior and of the blocks, u32 crc32 of index and prior
    index, zlib: u64 documents, i64 doc_id each, u8 null flag each, u32 ids each
    prior (rangecoder.py): what the file's blocks start from, counted over all ids of the file
    blocks (rangecoder.py): the file's ids, cut into blocks that are reset and checksummed one by one

A document lies at the sum of the lengths before it; a reader takes the blocks that its range touches. Files are named by
their place, written under a name of the attempt's own and renamed, so a task that runs again leaves the same files.

Null text: empty, so the document is its end id. Null doc_id: kept, first. Repeated rows: each is a document. An empty
table: no file, no row. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rangecoder
from .common import give_back, materialize, open_fs, scratch
from .tokens import default_path, encoder

MAGIC = b"EWTOK3\n\0"
_HEAD = struct.Struct("<QQQI")
#: Bytes of text for a task, about, and ids after which a file is closed.
FILE_BYTES, FILE_IDS = 20 << 20, 8_000_000


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids and how many ids each has; ids of all, below 65,536."""
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    index = zlib.compress(struct.pack("<Q", len(doc_ids)) + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + nulls.tobytes() + lengths.astype("<u4").tobytes(), 1)
    prior = rangecoder.Prior.of(ids)
    packed = prior.pack()
    blocks = b"".join(rangecoder.encode_blocks(ids, prior))
    return MAGIC + _HEAD.pack(len(index), len(packed), len(blocks), zlib.crc32(index + packed)) + index + packed + blocks


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths, all ids."""
    if data[:8] != MAGIC or len(data) < 8 + _HEAD.size:
        raise rangecoder.BlockError("not a token file")
    a, p, b, crc = _HEAD.unpack_from(data, 8)
    data = data[8 + _HEAD.size :]
    if len(data) != a + p + b:
        raise rangecoder.BlockError("the file is cut short")
    if zlib.crc32(data[: a + p]) != crc:
        raise rangecoder.BlockError("the index's checksum is wrong")
    index = zlib.decompress(data[:a])
    (n,) = struct.unpack_from("<Q", index)
    docs, nulls, lengths = np.frombuffer(index, "<i8", n, 8), np.frombuffer(index, np.uint8, n, 8 + 8 * n), np.frombuffer(index, "<u4", n, 8 + 9 * n)
    ids = rangecoder.decode_blocks(rangecoder.split_blocks(data[a + p :]), rangecoder.Prior.unpack(data[a : a + p]))
    return [None if z else int(d) for d, z in zip(docs, nulls, strict=True)], lengths, ids


def _in_order(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids with rows of one doc_id, which stand together, ordered by their ids."""
    n = len(doc_ids)
    first = [k for k in range(n) if not k or doc_ids[k] != doc_ids[k - 1]]
    if len(first) == n:
        return lengths, ids
    ends, out = np.cumsum(lengths), []
    for a, b in zip(first, [*first[1:], n], strict=True):
        own = [ids[ends[k] - lengths[k] : ends[k]].astype("<u2").tobytes() for k in range(a, b)]
        out += sorted(own) if b > a + 1 else own
    return np.array([len(x) // 2 for x in out], lengths.dtype), np.frombuffer(b"".join(out), "<u2")


def write_tokens(docs: DataFrame, out_dir: str, path: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """docs (doc_id, text) -> part, nth, file, n_docs, n_ids of the files written: one row each, in a table of its own."""
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = max(1, -(-(size[0] or 0) // file_bytes), -(-size[1] // 4_000_000))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, nth = encoder(path, "<u2"), TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = ([], [], [])

        def close() -> pa.RecordBatch:
            fs, folder = open_fs(out_dir)
            fs.create_dir(folder, recursive=True)
            file = f"tokens-{part:06d}-{nth:04d}.bin"
            temporary = f"{folder}/{file}.{uuid.uuid4().hex}"
            lengths, ids = _in_order(held[0], np.concatenate(held[1]), np.concatenate(held[2]))
            row = [part, nth, file, len(held[0]), len(ids)]
            held[1].clear()
            held[2].clear()  # ids has them all
            data = pack_file(held[0], lengths, ids)
            held[0].clear()
            with fs.open_output_stream(temporary) as f:
                f.write(pa.py_buffer(data))
            fs.move(temporary, f"{folder}/{file}")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["part", "nth", "file", "n_docs", "n_ids"])

        for b in batches:
            at, doc_ids = 0, b.column(0).cast(pa.int64()).to_pylist()
            for ids, ends in enc.runs(b.column(1), end_id):
                held[0].extend(doc_ids[at : at + len(ends)])
                held[1].append(np.diff(ends, prepend=0))
                held[2].append(ids)
                at += len(ends)
                if sum(map(len, held[2])) >= FILE_IDS:
                    yield close()
                    nth += 1
        if held[0]:
            yield close()
        give_back()

    return materialize(rows.mapInArrow(write, "part int, nth int, file string, n_docs long, n_ids long"), "token-files")


def read_tokens(spark: SparkSession, out_dir: str, files: DataFrame) -> DataFrame:
    """files (part, nth, file, n_ids, ...) -> doc_id, start, n_tokens, ids binary (little-endian u32), from the files."""
    from pyspark.sql import Window

    # one row a file: as many rows as files pass through the window
    starts = files.select("file", (F.sum("n_ids").over(Window.orderBy("part", "nth")) - F.col("n_ids")).alias("base"))
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for file, base in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                fs, folder = open_fs(out_dir)
                with fs.open_input_stream(f"{folder}/{file}") as f:
                    docs, lengths, ids = unpack_file(f.read())
                raw, ends = ids.astype("<u4"), np.cumsum(lengths, dtype=np.int64)
                for i in range(0, len(docs), 2000):
                    e, m = ends[i : i + 2000], lengths[i : i + 2000].astype(np.int64)
                    low = int(e[0] - m[0])
                    own = pa.Array.from_buffers(pa.binary(), len(e), [None, pa.py_buffer((4 * np.concatenate(([0], e - low))).astype(np.int32)), pa.py_buffer(raw[low : e[-1]])])
                    yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 2000], pa.int64()), pa.array(base + e - m, pa.int64()), pa.array(m), own], ["doc_id", "start", "n_tokens", "ids"])
        give_back()

    return starts.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    out_dir = scratch(spark, "op2")
    files = write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), out_dir, default_path("word_bpe_49k.json"))
    return read_tokens(spark, out_dir, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
