"""Packing documents into sequences, shortest pack first over the histogram of lengths.

Each document is encoded, gets an end id and is cut into pieces: full sequences, then its rest. The histogram of piece
lengths (as many bins as a sequence has ids, whatever the corpus) goes to the driver, which places lengths longest first:
a length goes to the packs with the most room, a bin or a group of packs that holds more than the other is split, and
new packs open when none has room. What comes out are patterns (which lengths, in what order) with counts. Then the piece
of rank r among those of its length takes place r among the places that the patterns have for this length.

Ranks need no window over a length: a task numbers its own pieces of each length, and a small table of counts by (length,
task) gives what stands before. No group of equal lengths, however large, meets in a task.

Null text: empty, so the document is its end id. Null doc_id and repeated rows: each row is a document of its own. An
empty table: no rows. Very long texts: as many full pieces as needed. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialize
from .tokens import default_path, encoder

SEQUENCE = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"


def pattern_counts(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(packs, [(length, how many of it in a row), ...]) by shortest pack first."""
    heap: list[tuple[int, int]] = []  # (-room, number of the group)
    groups: list[tuple[int, list[tuple[int, int]]]] = []

    def put(packs: int, room: int, pattern: list[tuple[int, int]]) -> None:
        groups.append((packs, pattern))
        heapq.heappush(heap, (-room, len(groups) - 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or -heap[0][0] < length:
                put(left, size - length, [(length, 1)])
                break
            room, k = heapq.heappop(heap)
            packs, pattern = groups[k]
            take = min(packs, left)
            if take < packs:
                put(packs - take, -room, pattern)
            more = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
            put(take, -room - length, more)
            left -= take
    return sorted((groups[k] for _, k in heap), key=lambda g: [(-n, -m) for n, m in g[1]])


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, packs, first sequence and offset of each run of places, ascending by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for packs, pattern in patterns:
        offset = 0
        for length, many in pattern:
            at = ranks.get(length, 0)
            out.setdefault(length, []).append((at, packs, first, offset))
            ranks[length] = at + packs * many
            offset += length * many
        first += packs
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in out.items()}


def pieces(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """One row a piece; nth counts those of its length in the task before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            at, doc_ids = 0, b.column(0).cast(pa.int64())
            for ids, ends in enc.runs(b.column(1), end_id):
                tokens = np.diff(ends, prepend=0)
                cut = -(-tokens // size)
                doc = np.repeat(np.arange(len(ends)), cut)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(cut) - cut, cut)) * size
                length = np.minimum(size, tokens[doc] - start)
                low = (ends - tokens)[doc] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(low.tolist(), (low + length).tolist(), strict=True)]
                nth, seen = _ranks(length, seen)
                columns = [doc_ids.take(pa.array(at + doc)), start, length, crc, tokens[doc], np.full(len(doc), task, np.int32), nth]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.int32(), pa.int64()], strict=True)], PIECES.replace(" long", "").replace(" int", "").split(", "))
                at += len(ends)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _ranks(length: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of its length are before each, seen being those before all; and the new seen."""
    order = np.argsort(length, kind="stable")
    many = np.bincount(length, minlength=len(seen))
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(length)) - np.repeat(np.cumsum(many) - many, many) + seen[length[order]]
    return out, seen + many


def pack(docs: DataFrame, path: str, end_id: int = 1, size: int = SEQUENCE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece."""
    cut = materialize(pieces(docs, path, end_id, size), "pieces")
    counts = materialize(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    at = places(pattern_counts(histogram, size))
    before = materialize(counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")), "piece-ranks")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            length, rank = x["length"].to_numpy(), x["rank"].to_numpy()
            seq, off = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for n in np.unique(length):
                k = np.flatnonzero(length == n)
                first, packs, base, offset = at[int(n)]
                run = np.searchsorted(first, rank[k], "right") - 1
                inside = rank[k] - first[run]
                seq[k] = base[run] + inside % packs[run]
                off[k] = offset[run] + inside // packs[run] * n
            yield x.drop(columns="rank").assign(doc_id=x["doc_id"].astype("Int64"), sequence_id=seq, offset=off)

    # never broadcast: the counts grow with the tasks
    ranked = cut.join(before.hint("merge"), ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path("byte_bpe_50k.json"))
