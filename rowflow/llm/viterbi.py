"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at a position, the longest
first. Dynamic programming keeps, per position, only the best score, the number of pieces and
whether the last one is unknown. Ties follow the tokenizers library's Unigram model: of equal
scores the one with the longer last piece stays; a character that is no piece itself counts as
unknown (score of the worst piece less UNKNOWN_PENALTY), and unknown neighbours are one token.

Blanks become the mark of the vocabulary, with one in front of a text. If no piece holds the
mark behind another character and the mark is a piece, the best path of a text is those of its
words behind each other, so each worker keeps the answers for the words it has met. Scores are
sums of 64-bit floats (exact for vocabularies with integer scores).

Null and empty texts have no pieces and score 0. Repeated rows and null ids are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np

from rowflow.llm.pieces import MARK, blank_runs
from rowflow.llm.ragged import SegmentTable, batches, joined, segment_hashes

#: Fixed value of the library's Unigram model.
UNKNOWN_PENALTY = 10.0


class Counter:
    """``pieces``: (piece, score) pairs, without control or unknown ones."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.words_apart = MARK in names and not any(MARK in p.lstrip(MARK) for p in names)
        self.table = SegmentTable(self._answer, np.float64)

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path through a marked text."""
        scores, counts, loose, unknown = [0.0], [0], [False], self.unknown
        append, count, lose = scores.append, counts.append, loose.append

        def skip(at: int) -> None:  # the character that ends at ``at`` is unknown
            append(scores[at - 1] + unknown)
            count(counts[at - 1] + (not loose[at - 1]))
            lose(True)

        at, top, pieces, short = 0, None, 0, 0

        def close() -> None:
            """End position ``at`` with the matches seen so far."""
            if short > 1 and scores[at - 1] + unknown > top:
                skip(at)
            else:
                append(top)
                count(pieces)
                lose(False)

        for end, (size, score) in self.automaton.iter(text):
            end += 1
            if end != at:
                if top is not None:
                    close()
                for gap in range(len(scores), end):
                    skip(gap)
                at, top = end, None
            start = end - size
            got = scores[start] + score
            if top is None or got > top:
                top, pieces = got, counts[start] + 1
            short = size
        if top is not None:
            close()
        for gap in range(len(scores), len(text) + 1):
            skip(gap)
        return counts[-1], scores[-1]

    def _answer(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.array([self.best(x.replace(" ", MARK)) for x in texts], dtype=np.float64).reshape(-1)
        return flat, np.full(len(texts), 2, dtype=np.int64)

    def counts(self, texts: Iterable[str]) -> Iterator[tuple[int, float]]:
        """(pieces, score) of every text."""
        if not self.words_apart:
            for text in texts:
                yield self.best(MARK + text.replace(" ", MARK)) if text else (0, 0.0)
            return
        pieces, score, fresh = 0, 0.0, True
        for batch in batches(texts):
            parts = []
            for last, part in batch:
                parts.append(" " + part if fresh and part else part)
                fresh = last
            text, codes, first, ends = joined(parts)
            starts, stops = blank_runs(codes, ends)
            flat, _ = self.table.numbers(text, segment_hashes(codes, starts, stops), starts, stops)
            sums = np.concatenate([np.zeros((1, 2)), np.cumsum(flat.reshape(-1, 2), axis=0)])
            low, high = np.searchsorted(starts, first), np.searchsorted(starts, ends)
            for (last, _), (n, s) in zip(batch, (sums[high] - sums[low]).tolist()):
                pieces, score = pieces + int(n), score + s
                if last:
                    yield pieces, score
                    pieces, score = 0, 0.0


@functools.cache
def counter(path: str) -> Counter:
    """Over the normal pieces of a SentencePiece file, with their scores; one per worker."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(path, "rb") as file:
        spec.ParseFromString(file.read())
    return Counter([(p.piece, p.score) for p in spec.pieces if p.type == proto.ModelProto.SentencePiece.NORMAL])
