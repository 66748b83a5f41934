"""Token ids of whole texts with a public tokenizer file.

The tokenizers library encodes each distinct stretch of text once per Python
worker, as long as it is kept; words of letters are handed to it many at a time,
as one text.  The ids are looked up and put together by Arrow and numpy.  A text
is cut in front of spaces that follow a character that is no white space, and at
line breaks between characters that are none.  The pre-tokenizers of the supported files never make one token
of both sides of such a cut (a token may begin with a space, none goes on
after one), so the joined ids are those of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The characters of Unicode's White_Space property.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_BEFORE_SPACE = tuple(w + " " for w in WHITE_SPACE)
_CUT = re.compile(f"(?<=[^{WHITE_SPACE}]) ")

# Marks that end a word without being part of its token, and the
# Latin letters (ASCII, Latin-1, Extended-A and -B) that such a word consists of; not U+0130, whose
# lower-case form ends with a combining dot, which goes with the mark.
_MARKS = ".,"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_WORD = f"^ ?[{_LETTERS}]+$"
# Line breaks between characters that are neither white space nor control characters: tokens of their own, or none.
_BROKEN = f"^ ?[!-~{_LETTERS}]+(\n[!-~{_LETTERS}]+)+$"
# A part that ends with white space, or an empty one, stands before a space that is no cut.
_OPEN = f"[{WHITE_SPACE}]$|^$"
# What may stand between words that are encoded together, if it is one token.
_BETWEEN = "\n", " .\n"
# Stretches a Python worker keeps, beside those of the texts at hand.
CACHE_ENTRIES = 800_000
# Characters of text that are encoded at a time (a longer text alone).
STEP = 8_000_000
# Stretches that the library encodes in one call, and words that it is given as one text.
BATCH, TOGETHER = 20_000, 20
_EMPTY, _SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


class _Ragged:
    """Lists of ids, one after another in ``pool``."""

    def __init__(self, pool: np.ndarray, lengths: np.ndarray):
        self.pool, self.lengths = pool, lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, at: np.ndarray) -> _Ragged:
        lengths = self.lengths[at]
        shift = self.starts[at] - (np.cumsum(lengths) - lengths)
        return _Ragged(self.pool[np.arange(lengths.sum()) + np.repeat(shift, lengths)], lengths)

    def followed_by(self, other: _Ragged) -> _Ragged:
        return _Ragged(np.concatenate([self.pool, other.pool]), np.concatenate([self.lengths, other.lengths]))

    def joined(self, counts: np.ndarray) -> _Ragged:
        """``counts`` neighbouring lists as one."""
        ends = np.concatenate([[0], np.cumsum(self.lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return _Ragged(self.pool, np.diff(ends))


def _ragged(lists: list[list[int]]) -> _Ragged:
    lengths = np.fromiter(map(len, lists), "i8", len(lists))
    return _Ragged(np.fromiter(chain.from_iterable(lists), "<u4", lengths.sum()), lengths)


def _strings(values: list[str] = ()) -> pa.Array:
    return pa.array(values, pa.large_string())


def _numpy(array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


class Encoder:
    """Ids of whole texts, as arrays of unsigned 32-bit integers."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # control strings in a text are ordinary text
        self.cache_entries = cache_entries
        self.keys, self.ids = _strings(), _ragged([])
        # marks of one id, which are put behind the ids of their word
        alone = {m: ids for m, ids in zip(_MARKS, self._each(list(_MARKS))) if len(ids) == 1}
        self.marks = {m: ids[0] for m, ids in alone.items()}
        self.marked = f"^ ?[{_LETTERS}]+[{''.join(self.marks)}]$" if self.marks else "^[^\\s\\S]$"
        self.line_break = _ragged(self._each(["\n"]))
        self.between, self.between_id = next(filter(None, map(self._between, _BETWEEN)), (None, None))

    def _each(self, parts: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(parts), BATCH):
            out += [one.ids for one in self.tokenizer.encode_batch_fast(parts[at:at + BATCH], add_special_tokens=False)]
        return out

    def _between(self, text: str) -> tuple[str, int] | None:
        """``text`` and its id, if it is one token between words and behind them."""
        words = ["a", " b", "c"]
        ids = self._each([*words, "".join(w + text for w in words)])
        (first, *own), whole = ids[:-1], ids[-1]
        last = whole[-1:]
        return (text, last[0]) if whole == [*first, *last, *own[0], *last, *own[1], *last] else None

    def _words(self, words: list[str]) -> _Ragged:
        """The ids of words of letters, many in one text: no token reaches over what stands between them."""
        if self.between is None:
            return _ragged(self._each(words))
        texts = [self.between.join([*words[at:at + TOGETHER], ""]) for at in range(0, len(words), TOGETHER)]
        ids = _ragged(self._each(texts)).pool
        ends = np.flatnonzero(ids == self.between_id)
        if len(ends) != len(words):
            return _ragged(self._each(words))
        return _Ragged(ids[ids != self.between_id], np.diff(ends, prepend=-1) - 1)

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """Keep the ids of ``parts``, which are distinct and new, and return their places."""
        plain = pc.match_substring_regex(parts, _WORD)
        words, others = parts.filter(plain), parts.filter(pc.invert(plain))
        new = self._words(words.to_pylist()).followed_by(_ragged(self._each(others.to_pylist())))
        self.keys = pa.concat_arrays([self.keys, words, others])
        self.ids = self.ids.followed_by(new)
        first, word = len(self.keys) - len(parts), _numpy(plain)
        return first + np.where(word, np.cumsum(word) - 1, len(words) + np.cumsum(~word) - 1)

    def _known(self, parts: pa.Array) -> _Ragged:
        """The ids of each of ``parts``, which are distinct."""
        at = pc.index_in(parts, self.keys)
        if at.null_count:
            if len(self.keys) > self.cache_entries:  # only what is at hand stays
                held = at.drop_null()
                self.keys, self.ids = self.keys.take(held), self.ids.take(_numpy(held))
                at = pc.index_in(parts, self.keys)
            place, new = _numpy(pc.fill_null(at, 0)).astype("i8"), at.is_null()
            place[_numpy(new)] = self._learn(parts.filter(new))
            return self.ids.take(place)
        return self.ids.take(_numpy(at))

    def _unbroken(self, parts: pa.Array) -> _Ragged:
        """The ids of each of ``parts``: a word and the mark behind it are tokens of their own."""
        marked = pc.match_substring_regex(parts, self.marked)
        cores = pc.if_else(marked, pc.utf8_slice_codeunits(parts, 0, -1), parts).dictionary_encode()
        got = self._known(cores.dictionary)
        marks = list(self.marks)
        table = got.followed_by(_Ragged(np.array([self.marks[m] for m in marks], "<u4"), np.ones(len(marks), "i8")))
        has = _numpy(marked)
        mark = _numpy(pc.index_in(pc.utf8_slice_codeunits(parts.filter(marked), -1), _strings(marks))).astype("i8")
        counts = 1 + has
        at = np.repeat(_numpy(cores.indices).astype("i8"), counts)
        at[(np.cumsum(counts) - 1)[has]] = len(cores.dictionary) + mark
        return table.take(at).joined(counts)

    def _parts(self, parts: pa.Array) -> _Ragged:
        """The ids of each of ``parts``, which are distinct."""
        broken = pc.match_substring_regex(parts, _BROKEN)
        lines = pc.split_pattern(parts.filter(broken), "\n")
        pieces = pa.concat_arrays([parts.filter(pc.invert(broken)), lines.flatten()]).dictionary_encode()
        table = self._unbroken(pieces.dictionary).followed_by(self.line_break)
        codes = _numpy(pieces.indices).astype("i8")
        whole = len(parts) - len(lines)
        # a line break between the pieces of a part
        counts = 2 * np.diff(_numpy(lines.offsets)) - 1
        ends = np.cumsum(counts)
        of_lines = np.full(counts.sum(), len(pieces.dictionary))
        place = np.arange(len(of_lines)) - np.repeat(ends - counts, counts)
        of_lines[place % 2 == 0] = codes[whole:]
        every = table.take(np.concatenate([codes[:whole], of_lines])).joined(np.concatenate([np.ones(whole, "i8"), counts]))
        order = np.argsort(_numpy(broken), kind="stable")  # where each of them came from
        back = np.empty(len(order), "i8")
        back[order] = np.arange(len(order))
        return every.take(back)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        at, size = 0, 0
        for k, text in enumerate(texts):
            if size and size + len(text) > STEP:
                yield from self._encode(texts[at:k])
                at, size = k, 0
            size += len(text)
        if at < len(texts):
            yield from self._encode(texts[at:])

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        # where no white space stands before a space, every space is a cut
        lists = pc.split_pattern(_strings(texts), " ")
        words = lists.flatten().dictionary_encode()
        bounds = _numpy(lists.offsets)
        if self._open(words, bounds):
            lists = _rebuilt(lists, texts)
            words, bounds = lists.flatten().dictionary_encode(), _numpy(lists.offsets)
        codes, table = _numpy(words.indices).astype("i8"), words.dictionary
        # the first part of a text has no space before it
        first = bounds[:-1]
        starts, own = np.unique(codes[first], return_inverse=True)
        codes[first] = len(table) + own
        parts = pa.concat_arrays([pc.binary_join_element_wise(_EMPTY, table, _SPACE), table.take(pa.array(starts))]).dictionary_encode()
        ids = self._parts(parts.dictionary).take(_numpy(parts.indices).astype("i8")[codes])
        edges = np.concatenate([[0], np.cumsum(ids.lengths)])[bounds]
        return (ids.pool[a:b] for a, b in zip(edges[:-1], edges[1:]))

    @staticmethod
    def _open(words, bounds: np.ndarray) -> bool:
        """Does some part that is not the last of its text end with white space, or is it empty?"""
        ends = _numpy(pc.match_substring_regex(words.dictionary, _OPEN))
        hit = ends[_numpy(words.indices)]
        hit[bounds[1:] - 1] = False
        return bool(hit.any())


def _rebuilt(lists, texts: list[str]):
    """The parts where some text has white space before a space (no cut)."""
    parts = [_CUT.split(text) if any(w in text for w in _BEFORE_SPACE) else own
             for text, own in zip(texts, lists.to_pylist())]
    return pa.array(parts, pa.large_list(pa.large_string()))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per tokenizer file and Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
    return Encoder(path)
