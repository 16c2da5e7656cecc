"""Removal of byte strings that occur earlier in the corpus, by a Burrows-Wheeler transform.

A byte goes if it lies in a string of LEAST bytes that also starts earlier: in a document before
it in the order of (doc_id, hash of the text), or earlier in its own. Matches never cross
documents and may overlap; all strings are judged on the input.

Equal strings have to meet without one index of the whole corpus. Each window of LEAST bytes has
a key: the smallest hash of its GRAM-byte grams. Equal windows have equal keys, so segments (runs
of windows with one key) of different keys never match, and a key that occurs once in the corpus
can be left out. The steps are:

1. ``packed``: documents are written in chunks of about CHUNK bytes, one compressed row each.
2. ``shared_keys``: every chunk names its keys once; keys that come twice go back to their chunks.
3. ``cut_out``: the chunks cut out the segments of those keys. Copies within a chunk are removed
   there, and their first one goes on; its bytes go along only if the key has different segments
   or may repeat within one (there is nothing to compare otherwise). A key with more than HOT different segments (or with a very
   long one) is split: its windows go on one by one, under the hash of the window.
4. ``repeated``: tasks hold buckets of whole keys. The different segments of a part of a bucket are
   strung together, and on the transform of that text intervals are extended backwards, breadth
   first, which closes the borders between suffixes by increasing length of their common prefix.
   It stops at LEAST: what no border parts are equal windows, all but the first of which go.
5. The removed ranges go back to the chunks, which put together what is left.

A segment comes once per chunk at most, so the most frequent one has as many rows as chunks.
Copies of whole segments are told by key and a 64-bit hash of their bytes; between different
segments bytes decide. Each step is written before the next one, so a lost executor repeats one.

Null texts are empty. Rows without an id come before all others; rows that share an id come in
the order of the 64-bit hashes of their texts, equal rows in any order (one of them stays whole).
Other columns are ignored; an empty table gives no rows. Texts shorter than LEAST lose nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowflow.llm.ragged import segment_hashes
from rowflow.session import scratch_path, spread

LEAST, GRAM, CHUNK, PIECE, HOT, LONG, BUCKET, PART = 100, 32, 1 << 21, 1 << 20, 1 << 13, 1 << 12, 1 << 22, 1 << 21
SAME, MIXED, SPLIT = range(3)
APART = 0xFF  # no byte of UTF-8, and larger than all of them
#: Spark's setting to delete the shuffle files of a query at its end.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKED = "chunk long, ids array<long>, known array<boolean>, ties array<long>, sizes array<long>, data binary"
SEGMENT = "bucket long, key long, bytes binary, size long, chunk long, known boolean, doc_id long, tie long, place long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def joined_ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as ranges that don't touch."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, top = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > top[:-1]])
    return low[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(top) - 1)]


def order_of_suffixes(text: np.ndarray, least: int) -> np.ndarray:
    """The suffixes by their first ``least`` bytes at least: prefixes of
    eight bytes, doubled for those that are still alike."""
    n = len(text)
    padded, key = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64), np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1], [True]])  # where a group of equal prefixes starts
    rank = np.empty(n, dtype=np.int64)  # the row at which the group of a suffix starts
    rank[order] = np.maximum.accumulate(np.where(new[:-1], np.arange(n), 0))
    span = 8
    while span < least:
        rows = np.flatnonzero(~(new[:-1] & new[1:]))  # of groups of several
        if not len(rows):
            break
        at = order[rows]
        key = rank[at] * (n + 1) + np.where(at + span < n, rank[np.minimum(at + span, n - 1)] + 1, 0)
        by_key = np.argsort(key)
        key, at = key[by_key], at[by_key]
        order[rows] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[rows] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, rows, 0))
        span *= 2
    return order


def repeated(text: np.ndarray, least: int = LEAST) -> np.ndarray:
    """A class for every position: two positions whose ``least`` bytes hold no APART are in one
    class exactly if these bytes are equal. ``text`` ends with APART.

    An interval is the rows of the suffixes that start with one string. At each turn all intervals
    found at the turn before are extended by every byte in front of them; the end of an extended
    interval is a border with a common prefix of ``depth`` bytes if it wasn't one before, and only
    then is the interval kept. Strings with APART are not followed.
    """
    n = len(text)
    suffixes = order_of_suffixes(text, least)
    before = text[suffixes - 1]
    by_byte = np.argsort(before, kind="stable")
    step = np.empty(n, dtype=np.int32)  # the row of the suffix that is one byte longer
    step[by_byte] = np.arange(n, dtype=np.int32)
    first_byte, owner = before[by_byte], np.zeros(n, dtype=np.int32)
    border = np.zeros(n + 1, dtype=bool)
    border[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _depth in range(least):
        size = high - low
        at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        of = np.repeat(np.arange(len(low), dtype=np.int32), size)
        inside = before[at] != APART
        longer, of = step[at[inside]], of[inside]
        owner[longer] = of
        longer.sort()
        if not len(longer):
            break
        own, byte = owner[longer], first_byte[longer]
        cut = np.flatnonzero((longer[1:] != longer[:-1] + 1) | (own[1:] != own[:-1]) | (byte[1:] != byte[:-1])) + 1
        low = longer[np.concatenate([[0], cut])].astype(np.int64)
        high = longer[np.append(cut, len(longer)) - 1].astype(np.int64) + 1
        new = ~border[high]
        border[high[new]] = True
        low, high = low[new], high[new]
        if not len(low):
            break
    classes = np.empty(n, dtype=np.int64)
    classes[suffixes] = np.cumsum(border[:n])
    return classes


def segments(data: np.ndarray, ends: np.ndarray, least: int = LEAST, gram: int = GRAM, piece: int = PIECE):
    """For each piece of the documents (``ends``: where each one ends): its first byte, first and last
    window of every segment, the key, the hash of the bytes, and whether it may repeat itself."""
    fits = np.ones(len(data), dtype=bool)
    for start, end in zip([0, *ends.tolist()], ends.tolist()):
        fits[max(start, end - least + 1) : end] = False
    wide = least - gram + 1
    for at in range(0, len(data) - least + 1, piece):
        part = data[at : at + piece + least - 1]
        places = np.arange(len(part) - gram + 1)
        grams = segment_hashes(part, places, places + gram)
        keys, span = grams, 1
        while span < wide:
            more = min(span, wide - span)
            keys = np.minimum(keys[: len(keys) - more], keys[more:])
            span += more
        ok = fits[at : at + len(keys)]
        edge = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ok[1:] != ok[:-1]), [True]])
        first, last = np.flatnonzero(edge[:-1] & ok), np.flatnonzero(edge[1:] & ok)
        key = keys[first]
        again = np.zeros(len(first), dtype=bool)
        for i in range(0, len(first), 1 << 14):  # whether two of its grams have the key
            some = slice(i, i + (1 << 14))
            left = (grams[first[some, None] + np.arange(wide)] == key[some, None]).argmax(axis=1) + first[some]
            right = last[some] + wide - 1 - (grams[last[some, None] + np.arange(wide)[::-1]] == key[some, None]).argmax(axis=1)
            again[some] = left != right
        yield at, first, last, key.view(np.int64), segment_hashes(part, first, last + least).view(np.int64), again


def packed(docs: DataFrame, chunk: int) -> DataFrame:
    """Chunks of documents, in order within the chunk."""

    def run(frames):
        import zstandard

        pack, serial = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 32
        held, size = [], 0

        def closed() -> pd.DataFrame:
            held.sort(key=lambda x: x[:3])
            known, ids, ties, data = zip(*held)
            row = {"chunk": serial, "ids": list(ids), "known": list(known), "ties": list(ties), "sizes": list(map(len, data)), "data": pack(b"".join(data))}
            return pd.DataFrame({k: [v] for k, v in row.items()})

        for frame in frames:
            for known, doc_id, tie, text in zip(frame["known"].tolist(), frame["doc_id"].tolist(), frame["tie"].tolist(), frame["text"].tolist()):
                held.append((known, doc_id, tie, text.encode()))
                size += len(held[-1][-1]) + 64
                if size >= chunk:
                    yield closed()
                    held, size, serial = [], 0, serial + 1
        if held:
            yield closed()

    text = F.coalesce("text", F.lit(""))
    rows = spread(docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")))
    path = scratch_path(docs.sparkSession, "chunks")
    rows.mapInPandas(run, PACKED).write.parquet(path)
    return docs.sparkSession.read.schema(PACKED).parquet(path)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table; what was shuffled to make it is deleted as soon as it stands."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, name)
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    return spark.read.schema(rows.schema).parquet(path)


def unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a chunk and where each document ends."""
    import zstandard

    ends = np.cumsum(np.asarray(row.sizes, dtype=np.int64))
    data = zstandard.ZstdDecompressor().decompress(row.data, max_output_size=max(1, int(ends[-1]))) if ends[-1] else b""
    return np.frombuffer(data, dtype=np.uint8), ends


def shared_keys(chunks: DataFrame, least: int, hot: int) -> DataFrame:
    """chunk and keys (array of key, kind) of the keys that occur twice in the corpus. ``kind`` is
    SAME if all their segments are copies of one, SPLIT if there are more than ``hot``, else MIXED."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                found = list(segments(*unpacked(row), least))
                if not found:
                    continue
                first, last, key, content, again = (np.concatenate(x) for x in list(zip(*found))[1:])
                order = np.lexsort((content, key))
                key, content, again, long = key[order], content[order], again[order], (last - first)[order] >= LONG
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                fresh = np.concatenate([[True], (content[1:] != content[:-1]) | (key[1:] != key[:-1])])
                number = np.diff(np.append(new, len(key)))
                contents = np.add.reduceat(fresh.astype(np.int64), new) + np.where(np.maximum.reduceat(long, new), hot + 1, 0)
                yield pd.DataFrame({"key": key[new], "chunk": row.chunk, "content": content[new], "contents": contents, "several": number > 1, "again": np.maximum.reduceat(again, new)})

    rows = chunks.select("chunk", "sizes", "data").mapInPandas(run, "key long, chunk long, content long, contents long, several boolean, again boolean")
    same = Window.partitionBy("key")  # at most one row per chunk
    mixed = F.max("again").over(same) | (F.max("contents").over(same) > 1) | (F.min("content").over(same) != F.max("content").over(same))
    shared = F.max(F.col("several") | F.col("again")).over(same) | (F.count(F.lit(1)).over(same) > 1)
    kind = F.when(~mixed, SAME).when(F.sum("contents").over(same) > hot, SPLIT).otherwise(MIXED)
    rows = rows.select("key", "chunk", kind.cast("byte").alias("kind"), shared.alias("shared"))
    return rows.where("shared").groupBy("chunk").agg(F.collect_list(F.struct("key", "kind")).alias("keys"))


def cut_out(row, least: int, buckets: int) -> pd.DataFrame:
    """The first copies of the segments of shared keys in a chunk, with their bytes unless the key
    has no other segment; the ranges of all other copies in a row without a key."""
    data, ends = unpacked(row)
    keys = np.array([k["key"] for k in row.keys], dtype=np.int64)
    order = np.argsort(keys)
    keys, kinds = keys[order], np.array([k["kind"] for k in row.keys], dtype=np.int64)[order]
    group, start, size, content, alike = [], [], [], [], []
    for at, first, last, key, whole, _ in segments(data, ends, least):
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        shared = keys[place] == key
        split, kept = shared & (kinds[place] == SPLIT), shared & (kinds[place] != SPLIT)
        runs = (last - first + 1)[split]
        single = np.repeat(first[split] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        part = data[at : at + PIECE + least - 1]
        hashes = segment_hashes(part, single, single + least).view(np.int64)
        group += [key[kept], hashes]
        start += [at + first[kept], at + single]
        size += [(last - first + least)[kept], np.full(len(single), least)]
        content += [whole[kept], hashes]
        alike += [kinds[place[kept]] == SAME, np.zeros(len(single), dtype=bool)]
    group, start, size, content, alike = (np.concatenate(x) for x in (group, start, size, content, alike))
    order = np.lexsort((start, size, content))
    new = np.concatenate([[True], (content[order][1:] != content[order][:-1]) | (size[order][1:] != size[order][:-1])]) if len(order) else np.zeros(0, dtype=bool)
    first, other = order[new], order[~new]
    low, high = joined_ranges(start[other], start[other] + size[other])
    doc = np.searchsorted(ends, start[first], side="right")
    raw = data.tobytes()
    out = {
        "bucket": np.append((group[first].view(np.uint64) % np.uint64(buckets)).astype(np.int64), row.chunk % buckets),
        "key": pd.array([*group[first].tolist(), None], dtype="Int64"),
        "bytes": [*(None if same else raw[a : a + n] for same, a, n in zip(alike[first].tolist(), start[first].tolist(), size[first].tolist())), np.stack([low, high]).astype("<i8").tobytes()],
        "size": np.append(size[first], 0),
        "chunk": row.chunk,
        "known": np.append(np.asarray(row.known, dtype=bool)[doc], False),
        "doc_id": np.append(np.asarray(row.ids, dtype=np.int64)[doc], 0),
        "tie": np.append(np.asarray(row.ties, dtype=np.int64)[doc], 0),
        "place": np.append(start[first], 0),
    }
    return pd.DataFrame(out)


def later_windows(texts: list[bytes], order: np.ndarray, place: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (number of the text, start, end) covered by windows that occur earlier among the
    texts. ``order`` ranks their documents, ``place`` tells where in it each text starts."""
    number = {x: i for i, x in enumerate(dict.fromkeys(texts))}
    mark = bytes([APART])
    flat = np.frombuffer(mark.join(number) + mark, dtype=np.uint8)
    wide = np.array([len(x) for x in number], dtype=np.int64)
    offset = np.cumsum(wide + 1) - wide - 1
    classes = repeated(flat, least)
    which = np.array([number[x] for x in texts], dtype=np.int64)
    runs = wide[which] - least + 1
    owner = np.repeat(np.arange(len(texts)), runs)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    own = classes[offset[which][owner] + turn]
    when = (order[owner] << 32) + place[owner] + turn
    twice = np.flatnonzero(np.bincount(own)[own] > 1)
    by_class = twice[np.lexsort((when[twice], own[twice]))]
    later = np.zeros(len(owner), dtype=bool)
    later[by_class[1:]] = own[by_class[1:]] == own[by_class[:-1]]
    edge = np.concatenate([[True], (later[1:] != later[:-1]) | (owner[1:] != owner[:-1]), [True]])
    low, high = np.flatnonzero(edge[:-1] & later), np.flatnonzero(edge[1:] & later)
    return owner[low], turn[low], turn[high] + least


def bucket_ranges(frame: pd.DataFrame, least: int, part: int = PART) -> pd.DataFrame:
    """chunk and ranges (starts, then ends) of what goes, for a bucket of whole keys."""
    local = frame["key"].isna().to_numpy()
    chunks, lows, highs = [], [], []
    for chunk, data in zip(frame["chunk"][local].tolist(), frame["bytes"][local].tolist()):
        low, high = np.frombuffer(data, dtype="<i8").reshape(2, -1)
        chunks.append(np.full(len(low), chunk))
        lows.append(low)
        highs.append(high)
    rows = frame[~local].sort_values("key", kind="stable")
    if len(rows):
        columns = [rows[c].to_numpy() for c in ("chunk", "tie", "doc_id", "known")]
        by_doc = np.lexsort(columns)
        new = np.concatenate([[0], np.any([c[by_doc][1:] != c[by_doc][:-1] for c in columns], axis=0)])
        order = np.empty(len(rows), dtype=np.int64)
        order[by_doc] = np.cumsum(new)
        keys, texts = rows["key"].to_numpy(dtype=np.int64), rows["bytes"].to_numpy(dtype=object)
        chunk, place, wide = rows["chunk"].to_numpy(), rows["place"].to_numpy(), rows["size"].to_numpy()
        alike = np.flatnonzero(rows["bytes"].isna().to_numpy())  # copies of one segment per key: the first stays
        alike = alike[np.lexsort((place[alike], order[alike], keys[alike]))]
        later = alike[1:][keys[alike][1:] == keys[alike][:-1]]
        chunks.append(chunk[later])
        lows.append(place[later])
        highs.append(place[later] + wide[later])
        mixed = np.flatnonzero(rows["bytes"].notna().to_numpy())
        keys, texts, chunk, place, order, wide = (x[mixed] for x in (keys, texts, chunk, place, order, wide))
        size = np.cumsum(wide)
        new_key = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]), len(keys)).tolist()
        at = 0
        for stop in new_key[1:]:  # parts of whole keys, with about ``part`` bytes
            if stop < len(keys) and size[stop - 1] - (size[at - 1] if at else 0) < part:
                continue
            owner, low, high = later_windows(texts[at:stop].tolist(), order[at:stop], place[at:stop], least)
            chunks.append(chunk[at + owner])
            lows.append(place[at + owner] + low)
            highs.append(place[at + owner] + high)
            at = stop
    chunk, low, high = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (chunks, lows, highs))
    by_chunk = np.argsort(chunk, kind="stable")
    chunk, low, high = chunk[by_chunk], low[by_chunk], high[by_chunk]
    cuts = np.flatnonzero(chunk[1:] != chunk[:-1]) + 1
    own = [joined_ranges(a, b) for a, b in zip(np.split(low, cuts), np.split(high, cuts))]
    names = chunk[np.concatenate([[0], cuts])] if len(chunk) else chunk
    return pd.DataFrame({"chunk": names, "ranges": [np.stack(x).astype("<i8").tobytes() for x in own][: len(names)]})


def put_together(row) -> pd.DataFrame:
    """What is left of the documents of a chunk."""
    data, ends = unpacked(row)
    change = np.zeros(len(data) + 1, dtype=np.int32)
    for part in row.ranges if row.ranges is not None else []:
        low, high = np.frombuffer(part, dtype="<i8").reshape(2, -1)
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
    gone = np.cumsum(change[:-1]) > 0
    out = []
    for known, doc_id, end, size in zip(row.known, row.ids, ends.tolist(), row.sizes):
        own = gone[end - size : end]
        spans = int((own[1:] & ~own[:-1]).sum() + own[:1].sum())
        kept = data[end - size : end][~own] if spans else data[end - size : end]
        out.append((int(doc_id) if known else None, int(size), int(own.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pd.DataFrame({c: pd.array(v, dtype="Int64") if c == "doc_id" else v for c, v in zip(names, map(list, zip(*out)))})


def remove_repeats(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    chunks = packed(docs, chunk)
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = int(total // bucket) + 1
    shared = written(shared_keys(chunks, least, hot), "repeat-keys")

    def per_row(fn):
        def run(frames):
            for frame in frames:
                for row in frame.itertuples():
                    yield fn(row)

        return run

    cut = chunks.join(shared, "chunk").mapInPandas(per_row(lambda row: cut_out(row, least, buckets)), SEGMENT)
    ranges = cut.groupBy("bucket").applyInPandas(lambda frame: bucket_ranges(frame, least), "chunk long, ranges binary")
    ranges = written(ranges.groupBy("chunk").agg(F.collect_list("ranges").alias("ranges")), "repeat-ranges")
    return chunks.join(ranges, "chunk", "left").mapInPandas(per_row(put_together), RESULT)
