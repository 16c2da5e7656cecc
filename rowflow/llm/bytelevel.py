"""Ids of a byte-level BPE tokenizer file for many texts, through the tokenizers library.

Its pre-tokenizer splits a text by character classes, and merges stay inside a split, so the
splits are found for a whole batch at once and each worker asks the library for every distinct
split only once. The file's added tokens are cut out before, as the library does.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import regex

from rowflow.llm.ragged import SegmentTable, numbers_of_texts

BLANK, LETTER, DIGIT, OTHER, NONE = range(5)


@functools.cache
def classes(path: str) -> np.ndarray:
    """The class of every code point; where two versions of the character data differ, the
    library is asked how it splits."""
    from tokenizers import Tokenizer

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    text = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((BLANK, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    own = np.fromiter(({"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], OTHER) for c in text), dtype=np.uint8, count=len(text))
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    for c in points[(own != out[points]) & (out[points] != BLANK)].tolist():
        out[c] = LETTER if len(split(f"a{chr(c)}a")) == 1 else DIGIT if len(split(f"1{chr(c)}1")) == 1 else OTHER
    return out


def segments(classes: np.ndarray, codes: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the splits of the byte-level pre-tokenizer start and end; ``apart``: positions that are in no text."""
    kind = classes[codes]
    kind[apart] = NONE
    before = np.concatenate([[NONE], kind[:-1]])
    start = kind != before
    # the last blank before a word or sign goes with it if it is a space, and stands alone else
    word = np.flatnonzero((before == BLANK) & (kind != BLANK) & (kind != NONE))
    start[word - 1] = True
    start[word] = codes[word - 1] != 0x20
    quote = np.flatnonzero((codes == 0x27) & start & (kind == OTHER))
    if len(quote):
        padded = np.concatenate([np.where(kind == NONE, 0, codes), [0, 0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        for hits, size in ((quote[short], 2), (quote[long], 3)):
            start[hits + 1] = False
            start[hits + size] = True
    cuts = np.flatnonzero(start | (kind == NONE))
    inside = kind[cuts] != NONE
    return cuts[inside], np.append(cuts[1:], len(codes))[inside]


@functools.cache
def table(path: str) -> SegmentTable:
    """One per worker and tokenizer file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True

    def answer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [i for i, x in enumerate(texts) if x[0] == " " and x[1:].isalpha()]
        lists: list = [None] * len(texts)
        if plain:  # words with a leading space split apart again when they are strung together
            got = library.encode("".join(texts[i] for i in plain), add_special_tokens=False)
            ids, word = np.array(got.ids, dtype=np.uint32), np.array(got.word_ids)
            sizes = np.bincount(word, minlength=len(plain))
            if len(sizes) == len(plain):
                for i, part in zip(plain, np.split(ids, np.cumsum(sizes)[:-1])):
                    lists[i] = part
        rest = [i for i, x in enumerate(lists) if x is None]
        if rest:
            for i, got in zip(rest, library.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
                lists[i] = np.array(got.ids, dtype=np.uint32)
        return np.concatenate(lists), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))

    return SegmentTable(answer)


@functools.cache
def splits_alike(path: str) -> bool:
    """Whether the file has the plain byte-level pre-tokenizer and nothing that runs before it."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec["pre_tokenizer"] or {}
    return before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec["normalizer"]


@functools.cache
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern of the file's added tokens (the longest at a place counts), and their ids."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens") or []
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in found):
        raise ValueError(f"{path} has added tokens that depend on what is around them")
    ids = {x["content"]: x["id"] for x in found if x["content"]}
    names = sorted(ids, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None, ids


def ids_of_texts(texts: Iterable[str], path: str, added: bool = False) -> Iterator[np.ndarray]:
    """The ids (unsigned 32 bit) that the library gives to each text, without special tokens
    around it. ``added``: the file's added tokens in a text get their own ids, as the library
    does by default; without it they are text like any other (``encode_special_tokens``)."""
    if not splits_alike(path):
        raise ValueError(f"{path} is no plain byte-level tokenizer")
    cut, names = added_tokens(path) if added else (None, {})
    inside: deque[list[str]] = deque()  # the added tokens of the texts under way

    def parts() -> Iterator[str]:
        for text in texts:
            found = cut.split(text) if cut else [text]
            inside.append(found[1::2])
            yield from found[::2]

    numbers = numbers_of_texts(parts(), functools.partial(segments, classes(path)), table(path))
    for ids in numbers:
        out = [ids]
        for name in inside.popleft():
            out += [np.array([names[name]], dtype=ids.dtype), next(numbers)]
        yield ids if len(out) == 1 else np.concatenate(out)
