"""SentencePiece ids with the place of every piece in the original text, and back.

A text is normalised by the model's compiled character map: at each position the longest prefix
that the map knows is replaced, and the source offset of every normalised byte is kept. Pieces
cover the normalised text, so each one has a span of original bytes. Ids are what the library
gives for the same text: pieces never cross the start of a blank run (checked on the
vocabulary), so each worker asks the library for every distinct word once.

Null texts are empty. A text without a piece has only begin and end ids. Repeated rows and null
ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np

from rowflow.llm.ragged import SegmentTable, numbers_of_texts

MARK = "▁"


class CharacterMap:
    """The compiled map of a model: a double-array trie over bytes, and the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """How many bytes from ``at`` the longest known prefix has, and what replaces it."""
        if not self.units:
            return None

        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & (1 << 9)) >> 6)

        node, found = offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def apply(self, text: str) -> tuple[bytes, np.ndarray]:
        """The text with every longest known prefix replaced, and for each of its bytes (and its
        end) the offset of the source it comes from."""
        data = text.encode()
        if not self.units:
            return data, np.arange(len(data) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(data):
            hit = self.longest(data, at)
            if hit is None:
                size = 1
                while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
                    size += 1
                hit = size, data[at : at + size]
                source.extend(range(at, at + size))
            else:
                source.extend([at] * len(hit[1]))
            out += hit[1]
            at += hit[0]
        return bytes(out), np.array([*source, len(data)])


@functools.cache
def model(path: str):
    """The library's processor, the model's specification and the byte length of every id."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(path, "rb") as file:
        spec.ParseFromString(file.read())
    kinds = proto.ModelProto.SentencePiece
    size = np.array([{kinds.BYTE: 1, kinds.CONTROL: 0}.get(p.type, len(p.piece.encode())) for p in spec.pieces], dtype=np.int64)
    return sentencepiece.SentencePieceProcessor(model_file=path), spec, size


@functools.cache
def character_map(path: str) -> CharacterMap:
    return CharacterMap(model(path)[1].normalizer_spec.precompiled_charsmap)


def normalised(text: str, path: str) -> tuple[bytes, np.ndarray]:
    """What the pieces of ``text`` cover, and the source offset of each byte and of the end."""
    spec = model(path)[1].normalizer_spec
    data, source = character_map(path).apply(text)
    if spec.remove_extra_whitespaces:  # blanks at both ends and behind blanks go
        kept = np.frombuffer(data, dtype=np.uint8) != 0x20
        keep = kept | np.concatenate([[False], kept[:-1]]) if len(kept) else kept
        while len(keep) and keep.any() and not kept[np.flatnonzero(keep)[-1]]:
            keep[np.flatnonzero(keep)[-1]] = False
        data, source = np.frombuffer(data, dtype=np.uint8)[keep].tobytes(), np.append(source[:-1][keep], source[-1])
    if not data:
        return b"", source[-1:]
    if spec.add_dummy_prefix:
        data, source = b" " + data, np.concatenate([source[:1], source])
    if spec.escape_whitespaces:
        wide = np.where(np.frombuffer(data, dtype=np.uint8) == 0x20, 3, 1)
        source = np.append(np.repeat(source[:-1], wide), source[-1])
        data = data.replace(b" ", MARK.encode())
    return data, source


def spans(text: str, ids: np.ndarray, path: str) -> np.ndarray:
    """Start and end (bytes of the original text) of every id; control ids have empty spans."""
    data, source = normalised(text, path)
    size = model(path)[2][ids]
    unknown = ids == model(path)[0].unk_id()
    if unknown.any():  # only models without byte pieces; an unknown piece covers what the others leave
        for i in np.flatnonzero(unknown):
            before, piece = int(size[:i].sum()), model(path)[0]
            rest = [piece.id_to_piece(int(x)).encode() for x in ids[i + 1 : i + 2] if x != piece.unk_id()]
            size[i] = (data.find(rest[0], before + 1) if rest and rest[0] and not piece.is_control(int(ids[i + 1])) else len(data)) - before
    ends = np.cumsum(size)
    if len(ends) and ends[-1] != len(data):
        raise ValueError("the pieces don't cover the normalised text")
    return np.stack([source[ends - size], source[ends]], axis=1)


@functools.cache
def words_apart(path: str) -> bool:
    """Whether texts may be cut before blank runs: no map, no trimming, and no piece that holds
    a blank behind something else."""
    spec = model(path)[1]
    rules = spec.normalizer_spec
    pieces = (p.piece for p in spec.pieces)
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
    return plain and not spec.trainer_spec.treat_whitespace_as_suffix and not any(MARK in p.lstrip(MARK) for p in pieces)


def blank_runs(codes: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of a blank run and what follows it; ``apart``: positions that are in no text."""
    blank = (codes == 0x20) | (codes == ord(MARK))
    none = np.zeros(len(codes), dtype=bool)
    none[apart] = True
    first = np.concatenate([[True], none[:-1]])
    cuts = np.flatnonzero(first | none | blank & ~np.concatenate([[False], blank[:-1]]))
    inside = ~none[cuts]
    return cuts[inside], np.append(cuts[1:], len(codes))[inside]


def with_prefix(parts: list[str], begins: list[bool]) -> list[str]:
    """A blank in front of every text that isn't empty, as the model puts one there."""
    return [" " + p if b and p else p for p, b in zip(parts, begins)]


@functools.cache
def _table(path: str) -> SegmentTable:
    library = model(path)[0]
    alone = library.encode("a ")[len(library.encode("a")) :]

    def answer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = library.encode([x[1:] for x in texts], num_threads=1)  # the library puts the blank back
        lists = [found if len(x) > 1 else alone for x, found in zip(texts, lists)]  # but not before nothing
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter((i for x in lists for i in x), dtype=np.uint32, count=int(sizes.sum())), sizes

    return SegmentTable(answer)


def ids_of_texts(texts: Iterable[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text between begin and end id."""
    library = model(path)[0]
    begin, end = np.uint32(library.bos_id()), np.uint32(library.eos_id())
    if words_apart(path):
        found = numbers_of_texts(texts, blank_runs, _table(path), with_prefix)
    else:
        found = (np.array(library.encode(x), dtype=np.uint32) for x in texts)
    for ids in found:
        yield np.concatenate([[begin], ids, [end]]).astype(np.uint32)


def decode(ids: list[list[int]], path: str) -> list[str]:
    return model(path)[0].decode(ids, num_threads=1)


def encoded(texts: Iterable[str], path: str) -> Iterator[tuple[str, np.ndarray, np.ndarray, str]]:
    """Text, ids with begin and end, their spans, and the text decoded from the ids."""
    held: list[str] = []

    def kept():
        for text in texts:
            held.append(text)
            yield text

    for at, ids in enumerate(ids_of_texts(kept(), path)):
        text, held[at] = held[at], ""
        yield text, ids, spans(text, ids, path), decode([ids.tolist()], path)[0]
