"""Texts of a batch as one array of code points, and number lists for their segments.

A segmenter cuts texts where no token can cross, so what a tokenizer makes of a segment does
not depend on its neighbours; each worker keeps the answers for the segments it has met in a
table of bounded size, and only new segments go to the tokenizer.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np

BATCH_CHARS = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _letters() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < size:
        have = np.full(max(size, BATCH_CHARS + 1), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:size]


def segment_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[starts:ends], never 0; equal for equal segments anywhere."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_letters()[codes] * _power(_BASE, len(codes)), out=sums[1:])
    inner = (sums[ends] - sums[starts]) * _power(_INVERSE, len(codes) + 1)[starts]
    return mixed(inner + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def gather(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[first[0]:first[0]+lengths[0]], flat[first[1]:...], ... behind each other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class SegmentTable:
    """From a segment's hash and length to its list of numbers; emptied when it is full.

    ``answer`` takes a list of strings and returns their numbers behind each other and how
    many each has.
    """

    def __init__(self, answer: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind=np.uint32, bits: int = 21):
        self.answer, self.kind, self.bits = answer, kind, bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.entry = np.zeros(1 << self.bits, dtype=np.int64)
        room = 1 << (self.bits - 1)
        self.chars, self.first, self.count = (np.zeros(room, dtype=np.int64) for _ in range(3))
        self.flat = np.zeros(4 * room, dtype=self.kind)
        self.size = self.used = 0

    def _find(self, hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Entry numbers, or -1."""
        mask = (1 << self.bits) - 1
        found = np.full(len(hashes), -1, dtype=np.int64)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        hit = held == hashes
        found[hit] = self.entry[slot[hit]]
        open_ = np.flatnonzero(~hit & (held != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & mask
            held = self.keys[slot]
            hit = held == hashes[open_]
            found[open_[hit]] = self.entry[slot[hit]]
            on = ~hit & (held != 0)
            open_, slot = open_[on], slot[on]
        known = np.flatnonzero(found >= 0)
        found[known[self.chars[found[known]] != chars[known]]] = -2  # two texts with one hash
        return found

    def _insert(self, hashes: np.ndarray, chars: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        new = np.arange(self.size, self.size + len(hashes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.chars[new], self.count[new] = chars, count
        self.first[new] = self.used + np.cumsum(count) - count
        self.size += len(hashes)
        self.used += len(flat)
        mask = (1 << self.bits) - 1
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(new):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, winners = np.unique(slot[free], return_index=True)
            winners = free[winners]
            self.keys[slot[winners]], self.entry[slot[winners]] = hashes[winners], new[winners]
            left = np.ones(len(new), dtype=bool)
            left[winners] = False
            hashes, new, slot = hashes[left], new[left], (slot[left] + 1) & mask

    def numbers(self, text: str, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all segments of ``text`` behind each other, and how many each has."""
        chars = ends - starts
        found = self._find(hashes, chars)
        if (found < 0).any():
            _, where = np.unique(hashes[found == -1], return_index=True)
            where = np.flatnonzero(found == -1)[where]
            if self.size + len(where) > len(self.chars):
                self.clear()
                _, where = np.unique(hashes, return_index=True)
                if len(where) > len(self.chars):
                    return self.answer([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
            if len(where):
                self._insert(hashes[where], chars[where], *self.answer([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]))
            found = self._find(hashes, chars)
            if (found < 0).any():
                return self.answer([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        count = self.count[found]
        return gather(self.flat, self.first[found], count), count


def chunks(text: str, limit: int = BATCH_CHARS) -> Iterator[str]:
    """``text`` in chunks of about ``limit``; every cut is before a blank that follows a non-blank."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        while cut > 0 and (text[cut - 1].isspace() or text[cut - 1] == "\u2581"):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def batches(texts: Iterable[str], limit: int = BATCH_CHARS) -> Iterator[list[tuple[bool, str]]]:
    """Lists of (last chunk of its text?, chunk) with about ``limit`` characters."""
    held, size = [], 0
    for text in texts:
        parts = [text] if len(text) <= limit else list(chunks(text, limit))
        for i, part in enumerate(parts):
            if held and size + len(part) > limit:
                yield held
                held, size = [], 0
            held.append((i + 1 == len(parts), part))
            size += len(part) + 1
    if held:
        yield held


def joined(parts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The parts in one string, each followed by one character that belongs to none;
    its code points; where each part starts and ends."""
    text = "\n".join(parts) + "\n"
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    return text, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), ends - sizes, ends


def numbers_of_texts(texts: Iterable[str], segment: Callable, table: SegmentTable, prepare: Callable[[list[str], list[bool]], list[str]] | None = None) -> Iterator[np.ndarray]:
    """For each text the numbers of its segments behind each other.

    ``segment(codes, ends)`` gets the code points and the positions that are in no part, and
    returns where the segments start and end. ``prepare`` may change the chunks of a batch; it
    also gets whether each one begins a text.
    """
    kept: list[np.ndarray] = []
    fresh = True
    for batch in batches(texts):
        parts = [part for _, part in batch]
        if prepare:
            begins = [fresh] + [last for last, _ in batch[:-1]]
            parts = prepare(parts, begins)
        fresh = batch[-1][0]
        text, codes, first, ends = joined(parts)
        starts, stops = segment(codes, ends)
        flat, count = table.numbers(text, segment_hashes(codes, starts, stops), starts, stops)
        at = np.concatenate([[0], np.cumsum(count)])
        low, high = at[np.searchsorted(starts, first)], at[np.searchsorted(starts, ends)]
        for (last, _), a, b in zip(batch, low.tolist(), high.tolist()):
            kept.append(flat[a:b])
            if last:
                yield kept[0] if len(kept) == 1 else np.concatenate(kept)
                kept = []
