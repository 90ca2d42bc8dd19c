"""Encoding with a tokenizer file, each distinct stretch of text once.

Texts are cut into units that the tokenizer treats independently of what
surrounds them: at white space, or into the pre-tokens of a byte-level pattern
where that is known. A unit that was seen before costs one
dictionary lookup; a new one goes through the tokenizers library.
"""

from __future__ import annotations

import gc
import os
import re
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import regex

from .blocks import BASE_2, INVERSE_2, prefix_hashes, span_hashes, word_spans

#: Units that a task remembers; beyond them it starts anew.
REMEMBERED = 500_000

#: Unicode white space; the fixed set that ``\\s`` means in the tokenizer files.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of other characters with the blank before it, or a run of white space
#: without its last character, or one that is left.
BLANK_LED = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: The pattern of byte-level pre-tokenizers whose pre-tokens are found without a regular expression.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: New units that are searched apart from the others until there are so many.
RECENT = 50_000
#: First bytes of the white space outside ASCII, as UTF-8.
LEADS = np.zeros(256, bool)
LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def other_white(data: np.ndarray) -> np.ndarray:
    """Places of white space outside ASCII in UTF-8 bytes: U+0085, U+00A0 and the rest of ``WHITE``."""
    at = np.flatnonzero(LEADS[data])
    padded = np.append(data, [0, 0])
    a, b, c = data[at], padded[at + 1], padded[at + 2]
    general = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    found = (
        ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
        | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
        | ((a == 0xE2) & (general | ((b == 0x81) & (c == 0x9F))))
        | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    )
    return at[found]


def unit_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the units of ``BLANK_LED``, in order, of texts whose white space is ASCII."""
    start, end, owner = word_spans(data, at)
    before = np.empty_like(start)
    before[1:] = end[:-1]
    first = np.ones(len(start), bool)
    first[1:] = owner[1:] != owner[:-1]
    before[first] = at[owner[first]]
    gap = start - before
    blank = (gap > 0) & (data[start - 1] == 32)
    run, single = gap > 1, (gap > 0) & ~blank
    # what follows the last word of a text, or is all of it
    tail = at[:-1].copy()
    last = np.ones(len(start), bool)
    last[:-1] = first[1:]
    tail[owner[last]] = end[last]
    rest = np.flatnonzero(tail < at[1:])
    starts = np.concatenate([start - blank, before[run], start[single] - 1, tail[rest]])
    ends = np.concatenate([end, start[run] - 1, start[single], at[1:][rest]])
    owners = np.concatenate([owner, owner[run], owner[single], rest])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], owners[order]


class TokenSpans:
    """The pre-tokens of :data:`BYTE_LEVEL`, found on UTF-8 bytes."""

    WHITE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)

    def __init__(self):
        # classes of code points, those beyond ASCII as they turn up
        self.classes = np.full(0x110000, self.UNKNOWN, np.uint8)
        self._classify(range(128))
        self.ascii = np.append(self.classes[:128], np.full(128, self.UNKNOWN, np.uint8))

    def _classify(self, codes) -> None:
        kinds = ((r"\s", self.WHITE), (r"\p{L}", self.LETTER), (r"\p{N}", self.NUMBER))
        for code in codes:
            found = [kind for pattern, kind in kinds if regex.match(pattern, chr(code))]
            self.classes[code] = found[0] if found else self.OTHER

    def byte_classes(self, data: np.ndarray) -> np.ndarray:
        """The class of the character of each byte."""
        out = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        first = data[lead].astype(np.int64)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)  # bytes that follow
        code = first & (0x3F >> more)
        follows = [lead[more >= k] for k in (1, 2, 3)]
        for k, at in enumerate(follows, 1):
            code[more >= k] = code[more >= k] << 6 | (data[at + k] & 0x3F)
        kind = self.classes[code]
        if (new := kind == self.UNKNOWN).any():
            self._classify(np.unique(code[new]).tolist())
            kind = self.classes[code]
        out[lead] = kind
        for k, at in enumerate(follows, 1):
            out[at + k] = kind[more >= k]
        return out

    def starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pre-tokens start of texts whose white space is ASCII; each ends where the next one starts."""
        n = len(data)
        kind = self.byte_classes(data)
        opens = np.zeros(n + 3, bool)  # places where no string of the text before goes on
        opens[at] = True
        opens[n:] = True
        flag = opens[:n].copy()
        flag[1:] |= kind[1:] != kind[:-1]
        # of the white space before another character the last one is apart; a blank belongs to what follows
        white = kind == self.WHITE
        turn = np.flatnonzero(white[:-1] & ~white[1:] & ~opens[1:n]) + 1
        flag[turn - 1] = True
        flag[turn[data[turn - 1] == 32]] = False
        # contractions, where an apostrophe starts a pre-token
        q = np.flatnonzero((data == 39) & flag)
        q = q[~opens[q + 1]]
        one = data[q + 1]
        two = np.where(opens[q + 2], 0, data[np.minimum(q + 2, n - 1)])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        short = np.isin(one, list(b"stmd"))
        flag[q[long | short] + 1] = False
        end = np.concatenate([q[short] + 2, q[long] + 3])
        flag[end[end < n]] = True
        return np.flatnonzero(flag)


def byte_letters() -> list[str]:
    """How byte-level models write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def load(path: str):
    """The tokenizer in ``path``, single-threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Units:
    """Token ids of units, remembered up to a bound.

    ``pattern`` is the regular expression of a byte-level pre-tokenizer without
    a normalizer; with it, units are split here and only new pre-tokens go to
    the library's model. Without it new units go through the library whole.
    If it is :data:`BYTE_LEVEL`, whole blocks are split into pre-tokens by
    classes of characters, and pre-tokens are the units.
    """

    def __init__(self, path: str, pattern: str | None = None):
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(pattern).findall if pattern else None
        self.shown = byte_letters()
        self.letters = np.array([ord(x) for x in self.shown], "<u2")
        self.tokens = TokenSpans() if pattern == BYTE_LEVEL else None
        self.forget()

    def forget(self) -> None:
        self.number: dict = defaultdict(count().__next__)  # numbers in the order of arrival
        self.start = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.known: dict[str, list[int]] = {}
        # hashes of units, sorted, and their numbers: the many and the recent ones
        self.hashed = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.second = np.zeros(0, np.uint64)

    def _looked_up(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashed units, -1 for new ones."""
        out = np.full(len(h), -1, np.int64)
        for hashes, numbers in self.hashed:
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                out[hit] = numbers[at[hit]]
        return out

    def _remember(self, h: np.ndarray, numbers: np.ndarray) -> None:
        many, recent = self.hashed
        both = [np.concatenate(x) for x in zip(recent, (h, numbers))]
        if len(both[0]) > RECENT:
            both, recent = [np.concatenate(x) for x in zip(many, both)], self.hashed[1]
        order = np.argsort(both[0])
        made = both[0][order], both[1][order]
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.hashed = [made, empty] if len(made[0]) > len(many[0]) and len(made[0]) > RECENT else [many, made]

    def _append(self, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32)])

    def span_numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number for each span of a block; only spans that are new to the task become strings.

        Spans are told apart by 128 bits. Not to be mixed with :meth:`numbers`.
        """
        if len(self.start) > REMEMBERED:
            self.forget()
        h = span_hashes(prefix_hashes(data), start, end)
        check = span_hashes(prefix_hashes(data, BASE_2), start, end, INVERSE_2)
        unique, first, which = np.unique(h, return_index=True, return_inverse=True)
        number = self._looked_up(unique)
        new = np.flatnonzero(number < 0)
        if len(new):
            gc.disable()  # only lists of numbers are made here
            try:
                ids = self._encode_spans(data, start[first[new]], end[first[new]])
            finally:
                gc.enable()
            number[new] = np.arange(len(new)) + len(self.start) - 1
            self._append(ids)
            self.second = np.concatenate([self.second, check[first[new]]])
            self._remember(unique[new], number[new])
        out = number[which]
        if (self.second[out] != check).any():
            raise ValueError("two units share a hash")
        return out

    def _encode_spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
        spans = zip(start.tolist(), end.tolist())
        if self.tokens is None:
            return self.encode_all([data[a:b].tobytes().decode() for a, b in spans])
        # one character for each byte, so places stay
        shown = self.letters[data].tobytes().decode("utf-16-le")
        tokenize = self.tokenizer.model.tokenize
        return [[x.id for x in tokenize(shown[a:b])] for a, b in spans]

    def encode_block(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a block.

        Texts with the string of an added token go to the library whole, those
        with white space outside ASCII are cut by the regular expression.
        """
        text = data.tobytes()
        whole = {int(np.searchsorted(at, m.start(), "right")) - 1 for s in self.special for m in re.finditer(re.escape(s.encode()), text)}
        cut = set((np.searchsorted(at, other_white(data), "right") - 1).tolist())
        if self.tokens is None:
            start, end, _ = unit_spans(data, at)
        else:
            start = self.tokens.starts(data, at)
            end = np.append(start[1:], len(data))
        if cut or whole:
            apart = np.zeros(len(at) - 1, bool)
            apart[list(cut | whole)] = True
            plain = np.repeat(~apart, np.diff(np.searchsorted(start, at)))
            start, end = start[plain], end[plain]
        numbers = self.span_numbers(data, start, end)
        ends = np.concatenate([[0], np.cumsum(self.sizes(numbers))])[np.searchsorted(start, at)]
        ids = self.ids(numbers)
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for k in cut | whole:
            one = text[at[k] : at[k + 1]].decode()
            if k in whole:
                out[k] = np.array(self.tokenizer.encode(one, add_special_tokens=False).ids, np.uint32)
            else:
                out[k] = np.fromiter(chain.from_iterable(self.encode_all(BLANK_LED.findall(one))), np.uint32)
        return out

    def encode_all(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit."""
        if self.split is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        known, tokenize, shown, out = self.known, self.tokenizer.model.tokenize, self.shown, []
        for unit in units:
            ids: list[int] = []
            for token in self.split(unit):
                got = known.get(token)
                if got is None:
                    got = known[token] = [x.id for x in tokenize("".join([shown[b] for b in token.encode()]))]
                ids += got
            out.append(ids)
        return out

    def numbers(self, units: list) -> np.ndarray:
        """A number for each unit (str, or UTF-8 bytes) of a block; new units are encoded."""
        if len(self.number) > REMEMBERED:
            self.forget()
        have, number = len(self.number), self.number
        out = np.fromiter(map(number.__getitem__, units), np.int64, len(units))
        if len(number) > have:
            new = list(islice(reversed(number), len(number) - have))[::-1]
            gc.disable()  # only lists of numbers are made here
            try:
                ids = self.encode_all([u.decode() if isinstance(u, bytes) else u for u in new])
            finally:
                gc.enable()
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32)])
        return out

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.start[numbers + 1] - self.start[numbers]

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of a sequence of units, one after another."""
        size = self.sizes(numbers)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.arange(total) + np.repeat(self.start[numbers] - (ends - size), size)]
