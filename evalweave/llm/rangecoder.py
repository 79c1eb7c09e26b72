"""Adaptive context-mixing range coder for token ids.

A sequence is cut into blocks that are coded independently, each from a fresh state and with its own checksum, so a damaged
block costs that block alone. Blocks are coded side by side: a step codes one id of every block with array operations.

What the blocks of a file share is a `Prior`: of each id, how often it comes in up to TABLES kinds of passages that are told
apart by their frequent ids, and which id follows it most and how surely. All ids and all pairs of the file are counted, and all
its passages told apart. A block starts from it and adapts, to each of its ids:

- order 0: ids by the prior's table that has told this block's last ids best,
- order 1: the id that follows the one before most, by the prior, where order 2 has nothing,
- order 2: the id that came last behind the same two in the block, with a confidence,
- weights, learned by order and confidence: what the predicted id gets, the rest being left to order 0.

An id's interval, that of the prediction or by order 0, drives a range coder with a window of 48 bits that emits
words of 16 bits and carries into words that are out. All numbers are integers below 2 ** 53, so doubles hold them exactly.

Block: n ids u32, n words u32, crc32 of the ids as u32 u32, then the words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Ids of a block, and blocks coded side by side: some 1 kB of state each.
BLOCK, LANES = 2048, 4096
#: Kinds of passages, ids of a passage, ids that tell them apart, starts of the search, passages tried for each, and passages counted at once.
TABLES, PASSAGE, TELLING, STARTS, TRIED, AT_ONCE = 4, 256, 128, 2, 8, 2048
#: Shares from which an id's successor is sure to the first, second and third degree.
SURE = (0.05, 0.15, 0.4)
#: Bits of a probability by order 0, of a weight; the most that a weight grows to, of 65,536; how fast it learns.
_IDS, _WEIGHT, _MOST, _RATE = 18, 12, 62_000, 4
#: Slots for contexts.
_SLOTS = 256
#: Steps after which the table is chosen anew, by all ids so far.
_TURN = 8
_LEAST = float(1 << 32)
_SLOT_OF = np.arange(1 << 16) * 40503 >> 4 & (_SLOTS - 1)
_HEAD = struct.Struct("<III")


class BlockError(ValueError):
    """A block's checksum or length is wrong."""


class Prior:
    """used: the ids, ascending; freq: for each table how much of 2 ** _IDS each has, at least 1; after: id | sureness << 16."""

    def __init__(self, used: np.ndarray, freq: np.ndarray, after: np.ndarray):
        self.used, self.freq, self.after = used, freq, after
        size = int(used[-1]) + 1 if len(used) else 1
        self.start, self.width = np.zeros((len(freq), size), np.float32), np.ones((len(freq), size), np.float32)
        self.find = np.zeros((len(freq), 1 << _IDS), np.uint16)
        for k, f in enumerate(freq):
            self.start[k, used], self.width[k, used] = np.cumsum(f) - f, f
            self.find[k] = np.repeat(used, f)
        # what an id costs by each table beyond the best, in half bits, four tables to a number
        cost = np.clip(np.round(2 * np.log2(self.width.max(0) / self.width)), 0, 31).astype(np.uint32)
        self.cost = np.zeros(size, np.uint32)
        for k, c in enumerate(cost):
            self.cost |= c << np.uint32(8 * k)
        self.next = np.zeros(size, np.int32)
        self.next[used] = after
        self.size = size

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        all_counts = np.bincount(ids) if len(ids) else np.ones(1, np.int64)
        used = np.flatnonzero(all_counts)
        counts = all_counts[used].astype(float)
        tables, after = [counts], np.zeros(len(used), np.int32)
        if len(ids) >= 16 * TABLES * PASSAGE:
            number = np.zeros(len(all_counts), np.uint16)
            number[used] = np.arange(len(used))
            x = number.take(ids)
            tables = [t + 0.02 * counts for t in _tables(x, _kinds(x, counts), len(used))]
            after = _after(x, used)
        freq = np.stack([_scaled(t) for t in tables])
        return cls(used, freq, after)

    def pack(self) -> bytes:
        raw = struct.pack("<II", *self.freq.shape) + np.diff(self.used, prepend=0).astype("<u2").tobytes() + self.freq.astype("<u4").T.copy().view(np.uint8).reshape(-1, 4).T.tobytes() + self.after.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
        return zlib.compress(raw, 6)

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        raw = zlib.decompress(data)
        k, n = struct.unpack_from("<II", raw)
        used = np.cumsum(np.frombuffer(raw, "<u2", n, 8), dtype=np.int64)
        freq = np.frombuffer(raw, np.uint8, 4 * k * n, 8 + 2 * n).reshape(4, -1).T.copy().view("<u4").reshape(n, k).T.astype(np.int64)
        after = np.frombuffer(raw, np.uint8, 4 * n, 8 + 2 * n + 4 * k * n).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int32)
        return cls(used, freq, after)


def _after(x: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Of each id (its number in used, of which x has all in a row) the id that follows it most, with how surely; 0 without one."""
    pairs = x[:-1].astype(np.uint32)
    pairs *= np.uint32(len(used))
    pairs += x[1:]
    pairs.sort()
    at = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    many, pairs = np.diff(at, append=len(pairs)), pairs[at].astype(np.int64)
    first = pairs // len(used)
    order = np.lexsort((many, first))
    last = order[np.flatnonzero(np.diff(first[order], append=len(used)))]  # of each id its largest pair
    share = many[last] / np.bincount(first, many, len(used))[first[last]]
    sure = np.searchsorted(SURE, share, "right") * (many[last] > 1)
    out = np.zeros(len(used), np.int32)
    out[first[last]] = np.where(sure > 0, used[pairs[last] % len(used)] | sure << 16, 0)
    return out


def _passages(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """All of x by some passages: number of the first, ids, the passage of each, from 0 on; the last passage may be short."""
    for i in range(0, len(x), AT_ONCE * PASSAGE):
        own = x[i : i + AT_ONCE * PASSAGE]
        yield i // PASSAGE, own, np.arange(len(own)) // PASSAGE


def _tables(x: np.ndarray, kind: np.ndarray, n: int) -> list[np.ndarray]:
    """How often each of n ids comes in the passages of each kind."""
    out = np.zeros(TABLES * n, np.int64)
    for first, own, passage in _passages(x):
        out += np.bincount(kind[first:].take(passage) * n + own, minlength=TABLES * n)
    return [t for t in out.reshape(TABLES, n) if t.any()]


def _kinds(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The kind of each passage of x: spherical k-means over the telling ids, the best of some starts."""
    rank = np.full(len(counts), TELLING)
    top = np.argsort(-counts, kind="stable")[:TELLING]
    rank[top] = np.arange(len(top))
    wide = TELLING + 1
    many = np.zeros((-(-len(x) // PASSAGE), wide), np.float32)
    for first, own, passage in _passages(x):
        n = int(passage[-1]) + 1
        many[first : first + n] = np.bincount(passage * wide + rank.take(own), minlength=n * wide).reshape(n, wide)
    np.sqrt(many, out=many)
    many /= np.linalg.norm(many, axis=1, keepdims=True)
    best, kind = -1.0, np.zeros(len(many), np.int64)
    draw = np.random.default_rng(1)
    for _ in range(STARTS):
        centres, before = _apart(many, draw), None
        for _ in range(8):
            own = (many @ centres.T).argmax(1)
            if before is not None and (own == before).all():
                break
            before = own
            sums = (own == np.arange(TABLES)[:, None]).astype(np.float32) @ many
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        alike = many @ centres.T
        if float(alike.max(1).sum(dtype=float)) > best:
            best, kind = float(alike.max(1).sum(dtype=float)), alike.argmax(1)
    return kind


def _apart(many: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Rows to start from: of some that are drawn, the sooner the less they are like those before, the one that leaves the least (greedy k-means++)."""
    far, found = np.ones(len(many), np.float32), []
    for _ in range(TABLES):
        upto = np.cumsum(far, dtype=float)
        rows = np.minimum(np.searchsorted(upto, draw.random(TRIED) * upto[-1], "right"), len(many) - 1)
        left = np.minimum(far[:, None], np.maximum(1 - many @ many[rows].T, 0))
        k = int(left.sum(0, dtype=float).argmin())
        far = left[:, k]
        found.append(rows[k])
    return many[found]


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as integers of at least 1 that sum to 2 ** _IDS."""
    f = (counts * (((1 << _IDS) - len(counts)) / counts.sum())).astype(np.int64) + 1
    f[f.argmax()] += (1 << _IDS) - f.sum()
    return f


class _Model:
    """Of n blocks."""

    def __init__(self, n: int, prior: Prior):
        self.prior, self.row = prior, np.arange(n)
        self.lanes = self.row * _SLOTS
        self.last = np.zeros(n * _SLOTS, np.int32)  # id | confidence << 16
        # by sureness of order 1, then by confidence of order 2
        self.weights = np.tile(np.array([0, 6_000, 16_000, 40_000, 0, 12_000, 36_000, 52_000], np.int32), n)
        self.cells = self.row * 8
        self.h = np.zeros(n, np.int64)  # from the id before
        self.h2 = np.zeros(n, np.int64)  # from the one before it
        self.next = np.zeros(n, np.int32)
        self.table = np.zeros(n, np.int64)
        self.score = np.zeros((len(prior.freq), n))
        self.spent = np.zeros(n, np.uint32)
        self.t = 0

    def predict(self) -> None:
        """said: the id that is predicted; f: its weight, 0 if there is none."""
        self.slot = self.lanes + (self.h ^ self.h2)
        self.e = self.last.take(self.slot)
        e = np.where(self.e, self.e + (4 << 16), self.next)
        self.said = e & 0xFFFF
        self.cell = self.cells + (e >> 16)
        self.v = self.weights.take(self.cell)
        self.f = self.v >> (16 - _WEIGHT)

    def update(self, ids: np.ndarray) -> None:
        up = np.minimum(self.e >> 16, 2)
        up *= (self.e & 0xFFFF) == ids
        self.last[self.slot] = ids + (up + 1 << 16)
        self.t += 1
        # without a prediction the weight is 0 and stays it
        self.weights[self.cell] = self.v + (_MOST * ((self.said == ids) & (self.f > 0)) - self.v >> _RATE)
        self.h2 = self.h * 5 & (_SLOTS - 1)
        self.h = _SLOT_OF.take(ids)
        self.next = self.prior.next.take(ids)
        if len(self.score) > 1:
            self.spent += self.prior.cost.take(ids)
            if self.t % _TURN == 0:
                self.score *= 0.875
                for k in range(len(self.score)):
                    self.score[k] += self.spent >> np.uint32(8 * k) & np.uint32(255)
                self.table = self.score.argmin(0)
                self.spent[:] = 0


def encode_blocks(ids: np.ndarray, prior: Prior | None = None, block: int = BLOCK, lanes: int = LANES) -> list[bytes]:
    """ids (below 65,536) as coded blocks, in order. The prior is that of the ids if none is given."""
    prior = prior or Prior.of(ids)
    out = []
    blocks = -(-len(ids) // block)
    for part in np.array_split(np.arange(blocks), max(1, -(-blocks // lanes))):
        if len(part):
            out += _encode(ids[part[0] * block : (part[-1] + 1) * block], prior, block)
    return out


def _encode(ids: np.ndarray, prior: Prior, block: int) -> list[bytes]:
    n = -(-len(ids) // block)
    padded = np.full(n * block, ids[0], np.uint16)
    padded[: len(ids)] = ids
    steps = np.ascontiguousarray(padded.reshape(n, block).T)
    del padded
    last = len(ids) - (n - 1) * block  # ids of the last block, which may stop before the others
    model = _Model(n, prior)
    low, rng = np.zeros(n), np.full(n, float(1 << 48))
    wide = 2 * block + 8
    words, line, at = np.zeros(n * wide, np.uint16), model.row * wide, np.zeros(n, np.int64)
    start_of, width_of, size = prior.start.ravel(), prior.width.ravel(), prior.size
    ended = None
    for t in range(min(block, len(ids))):
        if t == last:
            ended = low[-1], words[line[-1] : line[-1] + at[-1]].copy()
        x = steps[t].astype(np.int32)
        model.predict()
        r = np.floor(rng * 2.0**-_WEIGHT)
        r0 = np.floor(r * ((1 << _WEIGHT) - model.f) * 2.0**-_IDS)
        own = model.f * r
        said = (x == model.said) & (model.f > 0)
        k = model.table * size + x
        low += np.where(said, 0.0, own + start_of.take(k) * r0)
        rng = np.where(said, own, width_of.take(k) * r0)
        while (out := rng <= _LEAST).any():
            w = np.floor(low * 2.0**-32)
            if w.max() > 65535:
                k = np.flatnonzero(out & (w > 65535))
                _carry(words, line[k], line[k] + at[k] - 1)
            # where nothing is due the next word overwrites this one
            words[line + at] = w.astype(np.int32)
            at += out
            low = np.where(out, (low - w * _LEAST) * 65536, low)
            rng = np.where(out, rng * 65536, rng)
        model.update(x)
    if ended is not None:  # what was coded behind its end may have carried into its words
        low[-1], at[-1] = ended[0], len(ended[1])
        words[line[-1] : line[-1] + at[-1]] = ended[1]
    done = []
    for k in range(n):
        value = int(low[k])
        if value >> 48:
            _carry(words, line[k : k + 1], line[k : k + 1] + at[k] - 1)
        own = ids[k * block : (k + 1) * block]
        data = words[line[k] : line[k] + at[k]].astype("<u2").tobytes() + struct.pack("<3H", *(value >> s & 0xFFFF for s in (32, 16, 0)))
        done.append(_HEAD.pack(len(own), len(data) // 2, zlib.crc32(own.astype("<u4").tobytes())) + data)
    return done


def _carry(words: np.ndarray, line: np.ndarray, at: np.ndarray) -> None:
    """One more in the word at `at`, and in those before it while they are full."""
    while len(at):
        if (at < line).any():
            raise AssertionError("nothing to carry into")
        full = words[at] == 65535
        words[at] += np.uint16(1)
        line, at = line[full], at[full] - 1


def split_blocks(data: bytes) -> list[tuple[int, int, bytes]]:
    """(ids, crc32, words) of each block."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise BlockError("a block is cut short")
        n, words, crc = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        out.append((n, crc, data[at : at + 2 * words]))
        if len(out[-1][2]) != 2 * words:
            raise BlockError("a block is cut short")
        at += 2 * words
    return out


def decode_blocks(blocks: list[tuple[int, int, bytes]], prior: Prior, lanes: int = LANES) -> np.ndarray:
    """The ids of blocks, checked; blocks of one length are decoded side by side."""
    out: list[np.ndarray | None] = [None] * len(blocks)
    by: dict[int, list[int]] = {}
    for k, (n, _, _) in enumerate(blocks):
        by.setdefault(n, []).append(k)
    for n, all_k in by.items():
        for ks in np.array_split(all_k, -(-len(all_k) // lanes)):
            ks = ks.tolist()
            ids = _decode([blocks[k][2] for k in ks], n, prior)
            for k, own in zip(ks, ids, strict=True):
                if zlib.crc32(own.astype("<u4").tobytes()) != blocks[k][1]:
                    raise BlockError("a block's checksum is wrong")
                out[k] = own
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def _decode(data: list[bytes], steps: int, prior: Prior) -> np.ndarray:
    n = len(data)
    longest = max(len(d) for d in data) // 2
    words = np.zeros((n, longest + 4), np.uint16)
    for k, d in enumerate(data):
        words[k, : len(d) // 2] = np.frombuffer(d, "<u2")
    model = _Model(n, prior)
    rng, ahead = np.full(n, float(1 << 48)), np.zeros(n)  # ahead: of the interval's start
    for j in range(3):
        ahead = ahead * 65536 + words[:, j]
    words, line, at, end = words.ravel(), model.row * (longest + 4), np.full(n, 3, np.int64), longest + 3
    find, start_of, width_of, size = prior.find.ravel(), prior.start.ravel(), prior.width.ravel(), prior.size
    out = np.zeros((steps, n), np.uint16)
    for t in range(steps):
        model.predict()
        r = np.floor(rng * 2.0**-_WEIGHT)
        r0 = np.floor(r * ((1 << _WEIGHT) - model.f) * 2.0**-_IDS)
        own = model.f * r
        said = ahead < own
        # where the prediction is right this is any place, and not used
        place = ((ahead - own) / r0).astype(np.int64)
        rare = find.take((model.table << _IDS) + place, mode="clip")
        k = model.table * size + rare
        x = np.where(said, model.said, rare.astype(np.int32))
        ahead -= np.where(said, 0.0, own + start_of.take(k) * r0)
        rng = np.where(said, own, width_of.take(k) * r0)
        out[t] = x
        while (more := rng <= _LEAST).any():
            ahead = np.where(more, ahead * 65536 + words.take(line + np.minimum(at, end)), ahead)
            at += more
            rng = np.where(more, rng * 65536, rng)
        model.update(x)
    return np.ascontiguousarray(out.T)
