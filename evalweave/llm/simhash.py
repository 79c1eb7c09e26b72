"""SimHash near-duplicates with vantage-point trees.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, 3-word shingles with repeats (the whole sequence if there are
fewer words), XXH64 with seed 42 of each; a bit is 1 if it is set in over half the hashes; no words: zero.

Links: the distinct fingerprints, so that copies count once, go down a vantage-point tree built on a bounded sample of
them (the tree only places fingerprints: any tree gives the same links). At a node with vantage v and radius m those
within m go in, others out; those at m-1 or m go out as well, since by the triangle inequality only they can have a
partner within two bits on the other side. So any two that link meet in a shard. There a local tree with the same bounds
leads to blocks that are compared pair by pair (families too dense for a tree are peeled, core by core), and only each fingerprint's root in its shard leaves the task, not pairs.
Shards that share a fingerprint link their roots; components of that small graph join the shards.

Null text: no words. Null doc_id: kept, and never the smallest of a component unless all are null (then component_id is
null). Repeated rows: each is a row of the result. An empty table: no rows. Other columns are not read, but pass through
`deduplicate` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize
from .graph import components

SEED = 42
#: Fingerprints of a shard that the tree aims at, shards at most, and sampled fingerprints for each shard.
SHARD, SHARDS, SAMPLE = 1024, 65536, 32
#: Fingerprints that a local tree leaves to be compared pair by pair, and share of a family up to which its rest is worth peeling.
BLOCK, PEELED = 512, 0.95


def fingerprint(text: str | None, width: int = 3) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: lower() knows A-Z, split() space and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _printed():
    @F.pandas_udf("long")
    def printed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in texts:
            yield pd.Series(np.array([fingerprint(t) for t in own], np.uint64).view(np.int64))
            del own
        give_back()

    return printed


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp long; only the text goes to Python."""
    return docs.select("doc_id", _printed()(F.col("text")).alias("fp"))


def build_tree(sample: np.ndarray, leaves: int) -> list:
    """Nested [vantage, radius, inside, outside], a leaf being its number."""
    count = iter(range(1 << 62))

    def grow(x: np.ndarray, n: int):
        if n > 1 and len(x) > 1:
            for v in x[: min(8, len(x))]:
                d = np.bitwise_count(x ^ v)
                m = int(np.median(d))
                inside = d <= m
                if 0 < inside.sum() < len(x):
                    return [int(v), m, grow(x[inside], n // 2), grow(x[~inside], n - n // 2)]
        return next(count)

    return grow(sample, leaves)


def route(tree, x: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions in x) such that any two of x within reach bits meet in a leaf."""
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, k = todo.pop()
        if not len(k):
            continue
        if isinstance(node, int):
            yield node, k
            continue
        v, m, inside, outside = node
        d = np.bitwise_count(x[k] ^ np.uint64(v)).astype(np.int64)
        todo += [(inside, k[d <= m]), (outside, k[d > m - reach])]


def linked_pairs(x: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of x (ascending) within reach bits that link all that are linked; a pair may come twice."""
    todo = [np.arange(len(x))]
    while todo:
        k = todo.pop()
        if len(k) > BLOCK:
            d = np.bitwise_count(x[k] ^ x[k[0]]).astype(np.int64)
            m = int(np.median(d))
            inside, outside = k[d <= m], k[d > m - reach]
            if max(len(inside), len(outside)) < 0.9 * len(k):
                todo += [inside, outside]
                continue
            if reach == 2:
                pairs, rest = peeled(x, k)
                if len(rest) <= PEELED * len(k):  # a dense family: its core is linked, what is left goes on
                    yield from pairs
                    todo.append(rest)
                    continue
        for i in range(0, len(k), BLOCK):
            a, b = np.nonzero(np.bitwise_count(x[k[i : i + BLOCK], None] ^ x[None, k[i:]]) <= reach)
            keep = a < b
            yield k[i : i + BLOCK][a[keep]], k[i:][b[keep]]


def peeled(x: np.ndarray, k: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Links of the core of a dense family, two bits apart, and the positions outside it. No pair within the core is compared.

    The core is what lies within two bits of the fingerprint nearest to the majority of each bit, so all of it links to that
    one. Any other links to the core only from three or four bits away, by bits that both have changed: few, and looked up.
    """
    ones = sum(np.unpackbits(x[k[i : i + 65536]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(k), 65536))
    middle = np.packbits(ones * 2 > len(k), bitorder="little").view(np.uint64)[0]
    centre = k[np.bitwise_count(x[k] ^ middle).argmin()]
    changed = x[k] ^ x[centre]
    d = np.bitwise_count(changed)
    core = k[d <= 2]
    pairs = [(np.full(len(core), centre), core)]
    own, near = x[core], (d == 3) | (d == 4)
    z, left, bits = k[near], changed[near], []
    for _ in range(4):
        low = left & (~left + np.uint64(1))
        bits.append(low)
        left = left ^ low
    three = bits[3] == 0
    tries = [(bits[i] | bits[j], bits[j] != 0) for i in range(4) for j in range(i + 1, 4)] + [(bits[i], three) for i in range(3)]
    for change, valid in tries:
        want = (x[centre] ^ change)[valid]
        at = np.minimum(np.searchsorted(own, want), len(own) - 1)
        hit = own[at] == want
        pairs.append((core[at[hit]], z[valid][hit]))
    return pairs, k[d > 2]


def roots_of(x: np.ndarray, reach: int) -> np.ndarray:
    """For each of x (ascending) the least position that it is linked to, through others too."""
    root = np.arange(len(x))
    pairs = [p for p in linked_pairs(x, reach) if len(p[0])]
    if pairs:
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return root


def group(prints: DataFrame, reach: int = 2) -> DataFrame:
    """prints (fp, ...) -> the same with joined, a fingerprint that names the component, as a table of its own."""
    nodes = materialize(prints.select("fp").distinct(), "fingerprints")
    n = nodes.count()
    leaves = max(1, min(SHARDS, n // SHARD))
    # a fraction by hash, so of bounded size and the same whenever it is drawn
    part = min(1.0, leaves * SAMPLE / max(1, n))
    drawn = nodes.filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    sample = np.sort(np.array([r[0] for r in drawn.limit(2 * SHARDS * SAMPLE).collect()], np.int64)).view(np.uint64)
    tree = build_tree(np.random.default_rng(7).permutation(sample), leaves)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = x["fp"].to_numpy(np.int64)
            for leaf, k in route(tree, fp.view(np.uint64), reach):
                yield pd.DataFrame({"leaf": np.full(len(k), leaf, np.int32), "fp": fp[k]})

    def shard(x: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(x["fp"].to_numpy(np.int64).view(np.uint64))
        root = roots_of(fp, reach)
        linked = np.bincount(root, minlength=len(fp))[root] > 1
        return pd.DataFrame({"fp": fp[linked].view(np.int64), "root": fp[root][linked].view(np.int64)})

    stars = materialize(nodes.mapInPandas(spread, "leaf int, fp long").groupBy("leaf").applyInPandas(shard, "fp long, root long"), "stars")
    own = materialize(stars.groupBy("fp").agg(F.min("root").alias("root")), "roots")
    between = stars.join(own.withColumnRenamed("root", "u"), "fp").select("u", F.col("root").alias("v")).filter("u <> v").distinct()
    merged = materialize(components(between), "components")
    joined = own.join(merged, own.root == merged.node, "left").select("fp", F.coalesce("component", "root").alias("joined"))
    where = materialize(joined, "joined")
    # large groups of one fingerprint or component: plain equi-joins of written tables, which Spark splits by size
    return materialize(prints.join(where, "fp", "left").withColumn("joined", F.coalesce("joined", "fp")), "placed")


def link(prints: DataFrame, reach: int = 2) -> DataFrame:
    """prints (doc_id, fp, ...) -> the same with joined and component_id, the smallest doc_id that is reachable."""
    placed = group(prints, reach)
    least = materialize(placed.groupBy("joined").agg(F.min("doc_id").alias("component_id")), "smallest")
    return placed.join(least, "joined")


def deduplicate(docs: DataFrame, reach: int = 2) -> DataFrame:
    """The documents, all columns, of which one of each group stays: that with the smallest doc_id, else (nulls) any one.

    Of several rows with this doc_id one stays too. The documents are written once, numbered and with their fingerprints, and
    the numbers of those that go are joined back: texts are shuffled only where these are too many to broadcast.
    """
    # columns are numbered meanwhile, so that no name clashes with those of the method
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, own, strict=True)}
    printed = docs.toDF(*own).withColumn("fp", _printed()(F.col(at["text"]))).withColumn("row", F.monotonically_increasing_id())
    printed = materialize(printed, "printed")
    found = group(printed.select(F.col(at["doc_id"]).alias("doc_id"), "fp", "row"), reach)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    stay = materialize(found.groupBy("joined").agg(F.min(order).alias("s"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("joined", F.col("s.row").alias("stays")), "staying")
    go = materialize(found.select("joined", "row").join(stay, "joined").filter("row <> stays").select("row"), "going")
    return printed.join(go, "row", "left_anti").select(*[F.col(n).alias(c) for n, c in zip(own, docs.columns, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    prints = materialize(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "prints")
    return link(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
