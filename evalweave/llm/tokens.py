"""Token ids by the tokenizers library, with each distinct word encoded once by a worker.

No token of these vocabularies crosses the places where a text is cut (in front of one space or line feed between other
characters, and between a run of letters and the marks behind it), so the pieces' ids, one after another, are the ids of the
whole text; tests hold both against the library on whole texts. A text with other white space goes to the library in larger
pieces or whole.

A batch of texts is split into words, these are numbered and looked up among the words that are held, all by Arrow. New words
of Latin letters, marks behind them or not, go straight to the library's model, many at a time, as the pre-tokenizer would hand
them over; any other goes through the whole library. A batch's ids are gathered from one array that holds the runs of ids of
all words. What is held is dropped when it is full: that costs time, never ids.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

#: Words held by a worker, at some 50 bytes each.
CACHE = 500_000
#: Words of letters in lower case held beside them where the vocabulary has no others, at some 150 bytes each.
LOWER = 1_000_000
#: Bytes of the texts that are taken apart at once, unless one text has more.
AT_ONCE = 4 << 20
#: New words joined for one call of the library.
JOINED = 256

#: White space in which a text may be uneven: other than one space or line feed between other characters.
_ODD = "\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
_UNEVEN = f"[ \\n][ \\n]|^[ \\n]|[ \\n]$|[\\t\\r{_ODD}]"
_IS_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Latin letters (both vocabularies cut before any mark that follows), composed ones only where lower case is one letter too.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = f"^\\n?[A-Za-zÀ-ÖØ-öø-ÿ]+[{re.escape(_MARKS)}]*$"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next from U+0100."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PieceEncoder:
    def __init__(self, path: str, dtype: str = "<u4", cache: int = CACHE, lower: int = LOWER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.np, self.dtype, self.most, self.most_lower = np, np.dtype(dtype), cache, lower
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_space = self._ids(" a") == self._ids("a")  # and then lower-cases, as tests see
        # the same model, given words that are parted already
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of a token, without the mark of a word's end
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.removesuffix("</w>") if self.drops_space else token)
        self._forget()
        self._forget_lower()

    def _forget_lower(self) -> None:
        np = self.np
        self.lower: dict[str, int] = {}  # the number of a word of letters in lower case
        self.lower_flat, self.lower_ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _forget(self) -> None:
        import pyarrow as pa

        np = self.np
        self.words = pa.array([], pa.large_string())  # as they stand behind a space, or with the line feed before them
        self.first: dict[str, list[int]] = {}  # at the start of a text, where that differs
        self.pieces: dict[str, list[int]] = {}
        self.marks: dict[str, list[int]] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian integers."""
        import pyarrow as pa

        out: list[bytes] = []
        for ids, ends in self.runs(pa.array(texts, pa.large_string())):
            raw, at, size = ids.tobytes(), 0, self.dtype.itemsize
            for end in ends.tolist():
                out.append(raw[at : end * size])
                at = end * size
        return out

    def runs(self, texts, end_id: int | None = None):
        """Of an Arrow array of texts (null: empty): (ids of some texts in a row, where each ends), an end id behind each if given."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + AT_ONCE, "right")))
            yield self._run(texts[at:to], end_id)
            at = to

    def _run(self, texts, end_id: int | None):
        import pyarrow.compute as pc

        np, n = self.np, len(texts)
        if max(len(self.words), len(self.pieces), len(self.first), len(self.marks)) > self.most:
            self._forget()
        extra = int(end_id is not None)
        even = ~(pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0))
        own = texts if even.all() else texts.filter(even)
        split = pc.split_pattern(pc.replace_substring(own, "\n", " " if self.drops_space else " \n"), " ")
        bounds = split.offsets.to_numpy()
        bounds = bounds - bounds[:1]
        all_words = split.flatten()
        numbered = all_words.dictionary_encode()
        word = self._numbers(numbered.dictionary)[numbered.indices.to_numpy()]
        openings = [] if self.drops_space else all_words.take(bounds[:-1]).to_pylist()
        del split, all_words, numbered  # what comes next takes as much room
        starts, many = self.starts[word], self.lengths[word]
        del word
        flat = self.flat
        if not self.drops_space and len(own):
            k = bounds[:-1]
            opening = [self._opening(w) for w in openings]
            many[k] = list(map(len, opening))
            starts[k] = len(flat) + np.cumsum(many[k]) - many[k]
            flat = np.concatenate((flat, np.fromiter(chain.from_iterable(opening), self.dtype)))
        upto = np.concatenate(([0], np.cumsum(many)))
        rest = [self._uneven(t) for t in texts.filter(~even).to_pylist()] if not even.all() else []
        length = np.zeros(n, np.int64)
        length[even] = upto[bounds[1:]] - upto[bounds[:-1]]
        length[~even] = list(map(len, rest))
        ends = np.cumsum(length + extra)
        # a word's ids lie in flat from its start on: what its place in the result is ahead of that goes to all of them
        at = np.repeat(starts - upto[:-1], many)
        at += np.arange(upto[-1])
        ids = flat.take(at)
        del at
        if not rest and not extra:
            return ids, ends
        out = np.empty(int(ends[-1]) if n else 0, self.dtype)
        of_text = np.repeat(even, length + extra)
        if extra:
            out[ends - 1] = end_id
            of_text[ends - 1] = False
        out[of_text] = ids
        for k, x in zip(np.flatnonzero(~even).tolist(), rest, strict=True):
            out[ends[k] - extra - len(x) : ends[k] - extra] = x
        return out, ends

    def _numbers(self, words):
        """The number of each word of an Arrow array, new ones being learned."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        found = pc.index_in(words, self.words)
        missing = found.is_null()
        new = words.filter(missing)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            ids, lengths = self._learn(new)
            at[at < 0] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, new])
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, ids))
        return at

    def _learn(self, words):
        """(Ids, how many each has) of words that stand behind a space, or of a line feed and a word."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        own = words.filter(plain)
        feed = pc.starts_with(own, "\n").to_numpy(zero_copy_only=False)
        letters = pc.utf8_ltrim(pc.utf8_rtrim(own, _MARKS), "\n")
        behind = pc.binary_length(own).to_numpy(zero_copy_only=False) - pc.binary_length(letters).to_numpy(zero_copy_only=False) - feed
        marks = self._marks(own, behind)
        if self.drops_space:
            ids, lengths = self._lower_ids(pc.utf8_lower(letters))
        else:
            letters = pc.if_else(feed, letters, pc.binary_join_element_wise(pa.scalar(" ", letters.type), letters, pa.scalar("", letters.type)))
            ids, lengths = self._model_ids(letters)
        full = np.zeros(len(words), np.int64)
        of_marks = np.fromiter(map(len, marks), np.int64, len(marks))
        full[plain] = lengths + feed
        full[np.flatnonzero(plain)[behind > 0]] += of_marks
        others = [self._ids(w if w[:1] == "\n" else " " + w) if w else [] for w in words.filter(~plain).to_pylist()]
        full[~plain] = list(map(len, others))
        out, ends = np.empty(int(full.sum()), self.dtype), np.cumsum(full)
        of_letters = np.repeat(plain, full)
        last = ends[plain][behind > 0]
        at = np.repeat(last - np.cumsum(of_marks), of_marks) + np.arange(of_marks.sum())
        out[at] = np.fromiter(chain.from_iterable(marks), self.dtype, len(at))
        of_letters[at] = False
        at = (ends - full)[plain][feed]
        if len(at):
            (out[at],) = self._ids("\n")
            of_letters[at] = False
        out[of_letters] = ids
        out[np.repeat(~plain, full)] = np.fromiter(chain.from_iterable(others), self.dtype)
        return out, full

    def _marks(self, words, behind) -> list[list[int]]:
        """Ids of the marks behind the words that have some."""
        import pyarrow as pa
        import pyarrow.compute as pc

        held, out = self.marks, []
        for m in pc.replace_substring_regex(words.filter(pa.array(behind > 0)), "^\\n?[^!-~]*(?:[A-Za-z]+[^!-~]*)*", "").to_pylist():
            if m not in held:
                held[m] = self._ids(m)
            out.append(held[m])
        return out

    def _lower_ids(self, words):
        """As _model_ids, of words in lower case: many words differ in capitals or marks alone, or were held once, and are not given to the model again."""
        import pyarrow.compute as pc

        np = self.np
        if len(self.lower) > self.most_lower:
            self._forget_lower()
        numbered = words.dictionary_encode()
        own, held = _strings(numbered.dictionary), self.lower
        at = np.fromiter(map(held.get, own, repeat(-1)), np.int64, len(own))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = np.arange(len(held), len(held) + len(missing))
            held.update(zip([own[k] for k in missing.tolist()], at[missing].tolist(), strict=True))
            ids, lengths = self._model_ids(pc.take(numbered.dictionary, missing))
            self.lower_ends = np.concatenate((self.lower_ends, self.lower_ends[-1] + np.cumsum(lengths)))
            self.lower_flat = np.concatenate((self.lower_flat, ids))
        at = at[numbered.indices.to_numpy()]
        starts = self.lower_ends[at]
        many = self.lower_ends[at + 1] - starts
        upto = np.cumsum(many)
        return self.lower_flat.take(np.repeat(starts - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)), many

    def _model_ids(self, words):
        """(Ids, how many each has) of words by the model alone, each byte as its letter."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np, ids = self.np, []
        for i in range(0, len(words), JOINED):
            joined = pc.binary_join(_one_list(words[i : i + JOINED]), pa.scalar("\n", words.type))[0].as_py()
            text = joined.encode().decode("latin-1").translate(self.letters).replace(self.letters[10], "\n")
            ids.append(np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype))
        flat = np.concatenate(ids) if ids else np.zeros(0, self.dtype)
        # tokens spell the words byte by byte: a word ends where as many bytes are spelt
        spelt = np.cumsum(self.bytes_of[flat])
        ends = np.searchsorted(spelt, np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False)), "left") + 1
        return flat, np.diff(ends, prepend=0)

    def _opening(self, word: str) -> list[int]:
        if word not in self.first:
            self.first[word] = self._ids(word)
        return self.first[word]

    def _uneven(self, text: str) -> list[int]:
        if not text or _IS_ODD.search(text):
            return self._ids(text) if text else []
        out: list[int] = []
        for piece in _CUT.split(text):
            if piece not in self.pieces:
                self.pieces[piece] = self._ids(piece)
            out += self.pieces[piece]
        return out


def _strings(words) -> list[str]:
    """Words without line feeds, as Python has them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join(_one_list(words), pa.scalar("\n", words.type))[0].as_py().split("\n") if len(words) else []


def _one_list(words):
    import pyarrow as pa

    return pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)


_held: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, dtype: str = "<u4") -> PieceEncoder:
    """This worker's encoder: what it holds lasts from task to task."""
    if (path, dtype) not in _held:
        _held[path, dtype] = PieceEncoder(path, dtype)
    return _held[path, dtype]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
