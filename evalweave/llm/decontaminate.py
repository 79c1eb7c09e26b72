"""Benchmark decontamination with an FM-index for each shard of the training texts.

A-Z is lower-cased, words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window: 10 consecutive words of an item; an item of
fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

A shard is what a task reads until it has some SHARD symbols. Its alphabet is the benchmark's words. Any other word can't
lie in an occurrence, so it ends a segment, and a segment shorter than the shortest window isn't indexed; nothing else is
left out. All windows of one length are searched backwards together; occurrences are located by sampled suffix positions,
and overlapping ones merge into removal spans.

The benchmark never comes to the driver: it is written to the shared folder in blocks of some BOUND words, long items in
pieces that overlap by a window, and tasks read the blocks' windows from there, one block at a time. One block, the rule, is
read once by a worker; `find` takes several one after another, each against all documents, and joins their findings by row.

Null text: no words. Null doc_id, repeated rows: each is a row of the result. Null item_id: named as the empty string. Items
with equal texts or ids: each id counts once. An empty documents table: no rows; an empty benchmark: nothing is hit. Other
columns of the documents pass through `remove_passages` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, give_back, materialize, open_fs, scratch
from .fm_index import FMIndex

WINDOW = 10
#: Symbols of a shard, about, words of benchmark text in a block, about, and windows of a piece of an item.
SHARD, BOUND, PIECE = 400_000, 1_000_000, 10_000
_TABLE = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
REMOVED = "\n"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_TABLE).split()


class Windows:
    """Of (item_id, text) rows: the vocabulary, the distinct windows by length, and the items of each."""

    def __init__(self, items: Iterable[tuple[str, str | None]], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            w = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)], np.int32)
            if len(w):
                own = np.lib.stride_tricks.sliding_window_view(w, min(len(w), size))
                parts.setdefault(own.shape[1], []).append((own, np.full(len(own), names.setdefault(item, len(names)), np.int32)))
        self.names = list(names)
        #: By length: the windows, and of each the numbers of its items as a range of one array.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(parts):
            windows, which = np.unique(np.concatenate([w for w, _ in parts[n]]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((which.ravel(), np.concatenate([i for _, i in parts.pop(n)])), 1), axis=0)
            self.by_length[n] = windows.astype(np.int64), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
        self.shortest = min(self.by_length, default=0)

    def hits(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each text: its words, which of them are hit (as merged [start, end) rows), the items found."""
        get, n_words, parts, where = self.vocabulary.get, [], [], []
        for d, t in enumerate(texts):
            w = words_of(t)
            n_words.append(len(w))
            if len(w) < max(1, self.shortest) or not self.shortest:
                continue
            ids = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0]))))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a >= self.shortest:
                    parts += [ids[a:b], np.zeros(1, np.int64)]
                    where.append((d, a, b - a + 1))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        if parts:
            index = FMIndex(np.concatenate(parts))
            doc, offset, length = (np.array(x, np.int64) for x in zip(*where, strict=True))
            begin = np.cumsum(length) - length
            for n, (patterns, owners, of) in self.by_length.items():
                low, high = index.search(patterns)
                many = high - low
                k = np.repeat(np.arange(len(patterns)), many)
                at = index.locate(np.repeat(low, many) + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many))
                seg = np.searchsorted(begin, at, "right") - 1
                start = at - begin[seg] + offset[seg]
                for d, a, own in zip(doc[seg].tolist(), start.tolist(), k.tolist(), strict=True):
                    spans[d].append((a, a + n))
                    items[d].update(owners[of[own] : of[own + 1]].tolist())
        return [(n, merge(s), {self.names[k] for k in i}) for n, s, i in zip(n_words, spans, items, strict=True)]


def merge(spans: list[tuple[int, int]]) -> np.ndarray:
    """Overlapping or touching [start, end) as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items with words, in pieces of at most PIECE windows; no window is cut."""
    for b in batches:
        for item, text in zip(b["item"], b["text"], strict=True):
            w = [x.decode() for x in words_of(text)]
            for i in range(0, max(1, len(w) - WINDOW + 1) if w else 0, PIECE):
                own = w[i : i + PIECE + WINDOW - 1]
                yield pd.DataFrame({"item": [item], "piece": [i // PIECE], "n": [len(own)], "text": [" ".join(own)]})


def _blocks(benchmark: DataFrame) -> list[str]:
    """Folders with the benchmark's pieces, some BOUND words in each: one as a rule, none if it has no words."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    pieces = materialize(rows.mapInPandas(_pieces, "item string, piece long, n long, text string"), "benchmark-pieces")
    n = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // BOUND)
    out = [scratch(spark, "benchmark-block") for _ in range(n)]
    for k, path in enumerate(out):
        own = pieces if n == 1 else pieces.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(n)) == k)
        own.select("item", "text").write.parquet(path)
    return out


@lru_cache(1)
def _windows(path: str) -> Windows:
    """Of a block, in a worker."""
    import pyarrow.dataset as ds

    fs, folder = open_fs(path)
    rows = (r for b in ds.dataset(folder, filesystem=fs, format="parquet").to_batches() for r in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True))
    return Windows(rows)


def shards(batches: Iterator[pd.DataFrame], symbols: int = SHARD) -> Iterator[pd.DataFrame]:
    """Joins Arrow batches until their texts have so many words, about (eight bytes each)."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += sum(len(t) for t in b["text"] if t)
        if size >= 8 * symbols:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, spans array<struct<start, end>> in words, items array<string>, sorted."""
    rows = docs.select("doc_id", "text")
    schema = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    blocks = _blocks(benchmark)

    def run(path: str | None, key: str):
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            windows = _windows(path) if path else Windows([])
            for x in shards(batches):
                found = windows.hits(list(x["text"]))
                yield pd.DataFrame({key: x[key].astype("Int64"), "n_words": [n for n, _, _ in found], "spans": [[{"start": a, "end": b} for a, b in s.tolist()] for _, s, _ in found], "items": [sorted(i) for _, _, i in found]})
            give_back()

        return go

    if len(blocks) < 2:
        return rows.mapInPandas(run(blocks[0] if blocks else None, "doc_id"), f"doc_id long, {schema}")
    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    parts = [numbered.select("row", "text").mapInPandas(run(b, "row"), f"row long, {schema}") for b in blocks]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    # as many rows of a key as blocks
    out = out.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(spans=[[{"start": a, "end": b} for a, b in merge([(y["start"], y["end"]) for y in s]).tolist()] for s in x["spans"]])

    return out.mapInPandas(merged, f"row long, {schema}").join(numbered.select("row", "doc_id"), "row").select("doc_id", "n_words", "spans", "items")


def cut(text: str, spans: np.ndarray) -> str:
    """The text without the words of these spans and what lies between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, now = [], 0
    for a, b in spans.tolist():
        out += [text[now : at[a][0]], REMOVED]
        now = at[b - 1][1]
    return "".join([*out, text[now:]])


def remove_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without benchmark passages: spans go until none is left, n_chars (if there) follows. Only texts go to Python."""
    blocks = _blocks(benchmark)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in shards(b.to_frame("text") for b in batches):
            texts, todo = list(x["text"]), list(range(len(x)))
            while todo:
                again = []
                for path in blocks:
                    for k, (_, s, _) in zip(todo, _windows(path).hits([texts[k] for k in todo]), strict=True):
                        if len(s):
                            texts[k] = cut(texts[k], s)
                            again.append(k)
                todo = sorted(set(again))  # what is left may join to a passage
            yield pd.Series(texts, dtype=object)
        give_back()

    (text,) = (c for c in docs.columns if c.lower() == "text")
    counted = [c for c in docs.columns if c.lower() == "n_chars"]
    (new,) = free_name(docs, "_clean")
    out = docs.withColumn(new, clean(F.col(text)))
    values = {c: F.col(c) for c in docs.columns} | {text: F.col(new)}
    for c in counted:
        values[c] = F.when(F.col(new).isNull(), F.col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType))
    return out.select(*[v.alias(c) for c, v in values.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, pos.n, i, item FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
