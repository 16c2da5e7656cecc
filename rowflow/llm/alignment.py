"""Links between the tokens of two tokenizers, and how common each linked pair is.

A document's tokens of both tokenizers are runs of the same bytes. A merge moves two pointers
over their ends: the one whose token ends earlier moves on, and where both end at the same byte
the text is cut. The tokens between two cuts are a group, and every token of one side is linked
to every token of the other side of its group. The merge runs in lockstep: one NumPy vector
holds the pointers of all lanes of a batch, every step moves them all, appends the cuts it met,
and lanes that are done leave the vector. A lane is a document, or LANE bytes of a long one (a
cut at a byte doesn't depend on what comes before it).

Pair counts are corpus-wide: every task writes its documents in chunks, each with a dictionary
of its distinct id pairs and the number of its documents that hold them. The dictionaries are
summed by pair in a shuffle, and the sums go back to the chunks that asked for them. A pair
comes once per chunk at most, so the most frequent pair has as many rows as there are chunks.

Texts that are null or empty, or whose joined tokens differ from a space and the text, have no
tokens. Repeated rows are separate documents, rows without an id stay, other columns are
ignored, and an empty table gives no rows. A group of many tokens is held as distinct ids with
their numbers, never as pairs of occurrences.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowflow.llm.ragged import gather
from rowflow.session import scratch_path, spread

LANE, BATCH_BYTES, CHUNK_LINKS, WIDE = 1 << 10, 1 << 20, 1 << 20, 64
COUNTS = "n_a long, n_b long, n_groups long, n_links long"
ALIGNED = f"chunk long, doc_id long, {COUNTS}, groups_sha256 string, codes binary, times binary, pairs array<long>, held array<long>"
RESULT = f"doc_id long, {COUNTS}, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """The bytes of every id, behind each other."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.first[ids], self.size[ids])


@functools.cache
def byte_level_vocabulary(path: str) -> Vocabulary:
    """Of a byte-level file: printable bytes stand for themselves, the others for the characters
    from 256 on, in order (a fixed rule of the format)."""
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, number in vocab.items():
        pieces[number] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return Vocabulary(pieces)


@functools.cache
def piece_vocabulary(path: str) -> Vocabulary:
    from rowflow.llm.pieces import MARK, model

    library, spec, _ = model(path)
    return Vocabulary([bytes([int(p.piece[3:5], 16)]) if library.is_byte(i) else p.piece.replace(MARK, " ").encode() for i, p in enumerate(spec.pieces)])


def ends_of(vocabulary: Vocabulary, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids behind each other, the byte each one ends at (counted over all documents), and
    where each document's ids start."""
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))])
    return flat, np.cumsum(vocabulary.size[flat]), first


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before each cut on both sides, over lanes of bytes (low, high], in byte order.

    One vector of pointers per side; each step moves in every lane the pointer whose token ends
    first (both at a cut) and emits the cuts; lanes whose pointers left their bytes are dropped.
    """
    a, b = np.searchsorted(a_ends, lows, side="right"), np.searchsorted(b_ends, lows, side="right")
    a_stop, b_stop = np.searchsorted(a_ends, highs, side="right"), np.searchsorted(b_ends, highs, side="right")
    cuts_a, cuts_b = [], []
    live = (a < a_stop) & (b < b_stop)
    a, b, a_stop, b_stop = a[live], b[live], a_stop[live], b_stop[live]
    while len(a):
        left, right = a_ends[a], b_ends[b]
        met = left == right
        a = a + (left <= right)
        b = b + (right <= left)
        if met.any():
            cuts_a.append(a[met])
            cuts_b.append(b[met])
        live = (a < a_stop) & (b < b_stop)
        if not live.all():
            a, b, a_stop, b_stop = a[live], b[live], a_stop[live], b_stop[live]
    if not cuts_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cuts = np.sort(np.concatenate(cuts_a) << 32 | np.concatenate(cuts_b))  # both grow along the text
    return cuts >> 32, cuts & 0xFFFFFFFF


def linked_pairs(a_ids: np.ndarray, b_ids: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of every document and distinct pair of linked ids; a pair is the
    id of the one side times 2**32 plus that of the other. ``doc``: the document of each group."""
    from_a, from_b = np.concatenate([[0], cut_a[:-1]]), np.concatenate([[0], cut_b[:-1]])
    n_a, n_b = cut_a - from_a, cut_b - from_b
    small = n_a * n_b <= WIDE
    links = (n_a * n_b)[small]
    group = np.repeat(np.arange(len(links)), links)
    turn = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    wide = n_b[small][group]
    left = a_ids[from_a[small][group] + turn // wide].astype(np.int64)
    right = b_ids[from_b[small][group] + turn % wide].astype(np.int64)
    docs, pairs, times = [doc[small][group]], [left << 32 | right], [np.ones(len(group), dtype=np.int64)]
    for i in np.flatnonzero(~small):  # distinct ids of both sides with their numbers
        one, m = np.unique(a_ids[from_a[i] : cut_a[i]].astype(np.int64), return_counts=True)
        two, n = np.unique(b_ids[from_b[i] : cut_b[i]].astype(np.int64), return_counts=True)
        pairs.append((one[:, None] << 32 | two[None, :]).ravel())
        times.append((m[:, None] * n[None, :]).ravel())
        docs.append(np.full(len(pairs[-1]), doc[i]))
    docs, pairs, times = np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)
    known, code = np.unique(pairs, return_inverse=True)
    place = docs * len(known) + code  # both are bounded by the batch
    if len(place) and place.max() < 2**31:
        place = place.astype(np.int32)
    order = np.argsort(place, kind="stable")
    place = place[order]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, dtype=np.int64)
    return docs[order][new], pairs[order][new], np.add.reduceat(times[order], new) if len(new) else times[:0]


@functools.cache
def _names(size: int) -> list[str]:
    """Every id as decimal text, followed by each of the three separators."""
    return [f"{i}{mark}" for i in range(size) for mark in ",|;"]


def group_texts(a_ids: np.ndarray, b_ids: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, bounds: np.ndarray, size: int) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each document; its groups are bounds[i]:bounds[i + 1]."""
    names = _names(size)
    a_codes, b_codes = a_ids.astype(np.int64) * 3, b_ids.astype(np.int64) * 3
    a_codes[cut_a - 1] += 1
    b_codes[cut_b - 1] += 2
    from_a, from_b = np.concatenate([[0], cut_a[:-1]]), np.concatenate([[0], cut_b[:-1]])
    n_a, n_b = cut_a - from_a, cut_b - from_b
    ends = np.cumsum(n_a + n_b)
    codes = np.empty(len(a_codes) + len(b_codes), dtype=np.int64)
    codes[np.arange(len(a_codes)) + np.repeat(ends - n_a - n_b - from_a, n_a)] = a_codes
    codes[np.arange(len(b_codes)) + np.repeat(ends - n_b - from_b, n_b)] = b_codes
    at = np.concatenate([[0], ends])[bounds].tolist()
    words = codes.tolist()
    return ["".join([names[c] for c in words[low:high]])[:-1] for low, high in zip(at, at[1:])]


class Aligned:
    """The alignment of a batch of texts: counts and digests per document, and its pairs."""

    def __init__(self, texts: list[str | None], ids_a: list[np.ndarray], ids_b: list[np.ndarray], vocab_a: Vocabulary, vocab_b: Vocabulary):
        n, none = len(texts), np.zeros(0, dtype=np.int64)
        want = [(" " + x).encode() if x else b"" for x in texts]
        ids_a, ids_b = ([i if w else none for i, w in zip(x, want)] for x in (ids_a, ids_b))
        kept = np.array([self._covers(w, a, vocab_a) and self._covers(w, b, vocab_b) for w, a, b in zip(want, ids_a, ids_b)], dtype=bool)
        ids_a, ids_b = ([i if k else none for i, k in zip(x, kept)] for x in (ids_a, ids_b))
        a_ids, a_ends, a_first = ends_of(vocab_a, ids_a)
        b_ids, b_ends, b_first = ends_of(vocab_b, ids_b)
        size = np.array([len(w) if k else 0 for w, k in zip(want, kept)], dtype=np.int64)
        start = np.cumsum(size) - size
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(n), lanes)
        lows = start[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        highs = np.minimum(lows + LANE, (start + size)[owner])
        cut_a, cut_b = lockstep(a_ends, b_ends, lows, highs)
        bounds = np.searchsorted(cut_a, a_first, side="right")  # cuts up to the end of each document
        bounds[0] = 0
        self.n_a, self.n_b = np.diff(a_first), np.diff(b_first)
        self.n_groups = np.diff(bounds)
        from_a, from_b = np.concatenate([[0], cut_a[:-1]]), np.concatenate([[0], cut_b[:-1]])
        doc = np.repeat(np.arange(n), self.n_groups)
        sums = np.concatenate([[0], np.cumsum((cut_a - from_a) * (cut_b - from_b))])
        self.n_links = sums[bounds[1:]] - sums[bounds[:-1]]
        texts_of_groups = group_texts(a_ids, b_ids, cut_a, cut_b, bounds, max(len(vocab_a.size), len(vocab_b.size)))
        self.digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in texts_of_groups]
        self.doc, self.pair, self.times = linked_pairs(a_ids, b_ids, cut_a, cut_b, doc)

    @staticmethod
    def _covers(want: bytes, ids: np.ndarray, vocab: Vocabulary) -> bool:
        return len(want) > 0 and int(vocab.size[ids].sum()) == len(want) and vocab.joined(ids).tobytes() == want


def batches_of(frames):
    """(ids, texts) with about BATCH_BYTES characters each."""
    ids, texts, size = [], [], 0
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
            ids.append(None if doc_id is None else int(doc_id))
            texts.append(text)
            size += len(text or "") + 1
            if size >= BATCH_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def chunk_rows(aligned: list[tuple[list, Aligned]], chunk: int) -> pd.DataFrame:
    """The documents of a chunk with codes into its dictionary, and the dictionary as last row."""
    pairs = np.concatenate([x.pair for _, x in aligned])
    known, code = np.unique(pairs, return_inverse=True)
    rows, at = [], 0
    for ids, x in aligned:
        own = code[at : at + len(x.pair)].astype("<i4")
        at += len(own)
        cuts = np.searchsorted(x.doc, np.arange(len(ids) + 1)).tolist()
        for i, doc_id in enumerate(ids):
            span = slice(cuts[i], cuts[i + 1])
            rows.append((chunk, doc_id, int(x.n_a[i]), int(x.n_b[i]), int(x.n_groups[i]), int(x.n_links[i]), x.digest[i], own[span].tobytes(), x.times[span].astype("<i8").tobytes(), None, None))
    rows.append((chunk, None, None, None, None, None, None, None, None, known.tolist(), np.bincount(code, minlength=len(known)).tolist()))
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    whole = {"doc_id", "n_a", "n_b", "n_groups", "n_links"}  # with nulls, and all digits kept
    return pd.DataFrame({c: pd.array(v, dtype="Int64") if c in whole else pd.Series(v, dtype=object) for c, v in zip(names, zip(*rows))})


def align(docs: DataFrame, encode_a: Callable, encode_b: Callable, vocabularies: Callable[[], tuple[Vocabulary, Vocabulary]], chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 per document.

    ``encode_a`` and ``encode_b`` turn texts (with their leading space) into id arrays inside
    the tasks; ``vocabularies`` gives the bytes of both sides' ids.
    """
    spark = docs.sparkSession

    def run(frames):
        vocab_a, vocab_b = vocabularies()
        held, links, serial = [], 0, TaskContext.get().partitionId() << 32
        for ids, texts in batches_of(frames):
            found = Aligned(texts, list(encode_a([f" {x}" if x else "" for x in texts])), list(encode_b([f" {x}" if x else "" for x in texts])), vocab_a, vocab_b)
            held.append((ids, found))
            links += len(found.pair)
            if links >= chunk_links:
                yield chunk_rows(held, serial)
                held, links, serial = [], 0, serial + 1
        if held:
            yield chunk_rows(held, serial)

    path = scratch_path(spark, "alignment")
    texts = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    texts.mapInPandas(run, ALIGNED).write.parquet(path)
    aligned = spark.read.schema(ALIGNED).parquet(path)

    entries = aligned.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "held")).alias("pos", "entry"))
    entries = entries.select("chunk", "pos", F.col("entry.pairs").alias("pair"), F.col("entry.held").alias("held"))
    counts = entries.groupBy("pair").agg(F.sum("held").alias("n")).withColumn("left", F.shiftrightunsigned("pair", 32))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("left")))  # one row per id pair
    answers = entries.join(counts, "pair").select("chunk", "pos", "n", "best")

    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(answers), dtype=np.int64), np.zeros(len(answers), dtype=np.int64)
        n[answers["pos"]], best[answers["pos"]] = answers["n"], answers["best"]
        out = rows[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].copy()
        own = [(np.frombuffer(c, dtype="<i4"), np.frombuffer(t, dtype="<i8")) for c, t in zip(rows["codes"], rows["times"])]
        out["n_best"] = [int((best[c] * t).sum()) for c, t in own]
        out["count_sum"] = [int((n[c] * t).sum()) for c, t in own]
        out["groups_sha256"] = rows["groups_sha256"]
        return out

    rows = spark.read.schema(ALIGNED).parquet(path).where("pairs IS NULL").drop("pairs", "held")
    # ids go through the frames as text, so that those beyond 2**53 keep their digits beside nulls
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    done = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, RESULT.replace("doc_id long", "doc_id string"))
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
