"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is the multiset of its five-word shingles (lower-case words between white space; a text
of fewer words is one shingle). Each shingle with weight w is a Poisson process over the weights
[0, w): its range is cut at powers of two, a range wider than one splits in halves whenever it
has a point, and every half goes on as a process of its own, seeded by the shingle and the
range. So a shingle's points below a weight are the same in every text, and the first point in
each of REGISTERS registers agrees between two texts with the probability of their weighted
Jaccard similarity. Only points up to a text's stop time are made, which is raised for the few
texts whose registers are not yet full.

Texts equal word for word are one node. Nodes that agree in a band of ROWS registers are
candidates. The smallest node of a bucket is its leader, and every node is compared with the one
that leads most of its buckets (ties: the smallest). Where the links found leave a bucket in
several components, members outside its largest one are compared with members of that, at most
LEADERS of a component, the ones with which they share most buckets. What is still apart is dealt
into blocks: BLOCK members outside the largest component meet each other and MAIN members of it
in a task, which compares members of different components until they are joined or all are
compared; it returns only links that join components, never all pairs. Members of the largest
component never meet each other. Pairs whose signatures agree in fewer than LEAST of the
registers (six standard deviations under the threshold) are dropped, all others are verified on
their whole texts. Classes are the connected components of the verified links.

Null texts are empty. Texts without a word are one class. Repeated rows belong to one class; if
rows with one id have different texts, each row gets the class of its own text. Null ids get a
class like all others, but are never its id unless it has no other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowflow.llm.ragged import batches, joined, mixed, segment_hashes
from rowflow.session import cut_lineage, scratch_path

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 6, 30
REGISTERS = ROWS * BANDS
LEAST = THRESHOLD - 6 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
BATCH_WORDS, BLOCK, MAIN, LEADERS = 1 << 17, 256, 1024, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = None


def _blank() -> np.ndarray:
    global _BLANK
    if _BLANK is None:
        _BLANK = np.zeros(0x110000, dtype=bool)
        _BLANK[[c for c in range(0x3001) if chr(c).isspace()]] = True
    return _BLANK


def word_hashes(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words."""
    kept: list[np.ndarray] = []
    for batch in batches(x.lower() for x in texts):
        _, codes, first, ends = joined([part for _, part in batch])
        blank = _blank()[codes]
        blank[ends] = True
        inside = np.concatenate([[True], blank])  # one place ahead
        starts = np.flatnonzero(inside[:-1] & ~blank)
        stops = np.flatnonzero(~inside[:-1] & blank) if len(codes) else starts
        hashes = segment_hashes(codes, starts, stops)
        for (last, _), a, b in zip(batch, np.searchsorted(starts, first).tolist(), np.searchsorted(starts, ends).tolist()):
            kept.append(hashes[a:b])
            if last:
                yield kept[0] if len(kept) == 1 else np.concatenate(kept)
                kept = []


def shingles(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle of texts whose words follow each other."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(words))
    keep = (at + SHINGLE <= ends) | ((ends - lengths[text] == at) & (lengths[text] < SHINGLE))
    at, text, ends = at[keep], text[keep], ends[keep]
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(SHINGLE, dtype=np.uint64)])
    for k in range(SHINGLE):
        out += np.where(at + k < ends, mixed(padded[at + k] + np.array([k + 1], dtype=np.uint64) * _STEP), np.uint64(0))
    return text, mixed(out)


def counted(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])])) if len(text) else np.zeros(0, dtype=int)
    return text[first], shingle[first], np.diff(np.append(first, len(text)))


def _wait(h: np.ndarray) -> np.ndarray:
    """Exponential waiting times."""
    return -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def _register(h: np.ndarray) -> np.ndarray:
    return (mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(33)).astype(np.int64) % REGISTERS


def _narrow(seed: np.ndarray, start: np.ndarray, text: np.ndarray, stop: np.ndarray, out: np.ndarray) -> None:
    """Put the points of processes of rate 1 into the registers ``out`` (texts x registers)."""
    flat, done, size = out.reshape(-1), 0, 1
    while len(seed):
        h = mixed(seed[:, None] + (np.arange(done + 1, done + size + 1, dtype=np.uint64) * _STEP)[None, :])
        x = start[:, None] + np.cumsum(_wait(h), axis=1)
        row, column = np.nonzero(x <= stop[text][:, None])
        np.minimum.at(flat, text[row] * REGISTERS + _register(h[row, column]), x[row, column])
        on = x[:, -1] <= stop[text]
        seed, start, text = seed[on], x[on, -1], text[on]
        done, size = done + size, min(4 * size if size < 4 else 2 * size, 256)


def _wide(element: np.ndarray, low: np.ndarray, width: np.ndarray, text: np.ndarray, weight: np.ndarray, stop: np.ndarray, out: np.ndarray) -> None:
    """The same for weight ranges [low, low + width), of which only what is below ``weight`` counts."""
    flat = out.reshape(-1)
    rows = (element, low, width, text, weight, np.zeros(len(low)), np.zeros(len(low), dtype=np.uint64))
    while len(rows[0]):
        element, low, width, text, weight, x, turn = rows
        turn = turn + np.uint64(1)
        h = mixed(mixed(element ^ mixed(low.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + width.astype(np.uint64))) + turn * _STEP)
        x = x + _wait(h) / width
        on = x <= stop[text]
        element, low, width, text, weight, x, turn, h = (v[on] for v in (element, low, width, text, weight, x, turn, h))
        waiting, none = [], np.uint64(0)
        while len(element):
            single = width == 1
            np.minimum.at(flat, text[single] * REGISTERS + _register(h[single]), x[single])
            waiting.append(tuple(v[single] for v in (element, low, width, text, weight, x, turn)))
            element, low, width, text, weight, x, h = (v[~single] for v in (element, low, width, text, weight, x, h))
            half = width // 2
            right = mixed(h ^ width.astype(np.uint64)) & np.uint64(1) == 1
            own, other = low + np.where(right, half, 0), low + np.where(right, 0, half)
            side = other < weight
            waiting.append((element[side], other[side], half[side], text[side], weight[side], x[side], np.full(side.sum(), none)))
            on = own < weight
            element, low, width, text, weight, x, h = element[on], own[on], half[on], text[on], weight[on], x[on], h[on]
            turn = np.full(len(element), none)
        rows = tuple(np.concatenate(v) for v in zip(*waiting)) if waiting else tuple(v[:0] for v in rows)


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """texts x REGISTERS; the times of the first points. Texts without shingles keep infinity."""
    total = np.bincount(text, weights=count, minlength=texts)
    stop = np.where(total > 0, REGISTERS / np.maximum(total, 1) * (np.log(REGISTERS) + 4), -1.0)
    out = np.full((texts, REGISTERS), np.inf)
    open_ = total > 0
    while open_.any():
        out[open_] = np.inf
        on = open_[text]
        t, s, c = text[on], shingle[on], count[on]
        _narrow(s, np.zeros(len(s)), t, stop, out)
        more = c > 1
        t, s, c, low = t[more], s[more], c[more], 1
        while len(s):
            if low == 1:
                _narrow(mixed(s + np.uint64(1)), np.zeros(len(s)), t, stop, out)
            else:
                _wide(s, np.full(len(s), low), np.full(len(s), low), t, c, stop, out)
            low *= 2
            more = c > low
            t, s, c = t[more], s[more], c[more]
        open_ = open_ & np.isinf(out).any(axis=1)
        stop = np.where(open_, 2 * stop, stop)
    return out


def band_hashes(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number per band, and one byte per register."""
    bits = mixed(out.view(np.uint64) + np.uint64(1))
    parts = bits.reshape(len(out), BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _STEP
    for k in range(ROWS):
        total = mixed(total + parts[:, :, k])
    return total.view(np.int64), (bits & np.uint64(0xFF)).astype(np.uint8)


def node_of(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, which name a row up to repeats of it."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_key"))


def smallest(doc_id: str) -> Column:
    """The smallest id and text_key; null ids come last."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("rep"), "text_key"))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (64-bit hash of the words), bands and digest (both null without words)."""

    def sign(frames):
        for frame in frames:
            held, owners = [], frame["doc_id"]
            first = 0
            for i, words in enumerate(word_hashes(frame["text"].tolist())):
                held.append(words)
                if sum(map(len, held)) >= BATCH_WORDS or i + 1 == len(frame):
                    lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
                    text, shingle, count = counted(*shingles(np.concatenate(held), lengths))
                    bands, digest = band_hashes(signatures(text, shingle, count, len(held)))
                    yield pd.DataFrame(
                        {
                            "doc_id": owners[first : i + 1].astype("Int64").to_numpy(dtype=object, na_value=None),
                            "text_key": frame["text_key"].iloc[first : i + 1].to_numpy(),
                            "node": [node_of(x) for x in held],
                            "bands": [b if n else None for b, n in zip(bands, lengths)],
                            "digest": [d.tobytes() if n else None for d, n in zip(digest, lengths)],
                        }
                    )
                    held, first = [], i + 1

    return keyed(docs).mapInPandas(sign, "doc_id long, text_key long, node long, bands array<long>, digest binary")


def bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text, sorted, and their counts."""
    return counted(*shingles(words, np.array([len(words)])))[1:]


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(one[1][i], two[1][j]).sum())
    total = int(one[1].sum() + two[1].sum()) - both
    return both / total if total else 1.0


def open_pairs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the likely pairs of one task, the likeliest first: of different components, of
    different blocks unless the task is for ``inner`` pairs too, and with no earlier band in
    common than this one."""
    bands = np.stack(frame["bands"].to_numpy())
    digests = np.frombuffer(b"".join(frame["digest"]), dtype=np.uint8).reshape(-1, REGISTERS)
    root, block = frame["root"].to_numpy(), frame["block"].to_numpy()
    inner = frame["inner"].iloc[0]
    left, right, alike = [], [], []
    for a in range(len(frame) - 1):
        b = a + 1 + np.flatnonzero((root[a + 1 :] != root[a]) & ((block[a + 1 :] != block[a]) | inner))
        same = (digests[b] == digests[a]).mean(axis=1)
        b, same = b[same >= LEAST], same[same >= LEAST]
        shared = bands[b] == bands[a]
        here = bands[a][np.argmax(shared, axis=1)] == frame["band"].iloc[0]
        left.append(np.full(here.sum(), a))
        right.append(b[here])
        alike.append(same[here])
    order = np.argsort(-np.concatenate(alike), kind="stable") if alike else np.zeros(0, dtype=int)
    return tuple(np.concatenate(x)[order] if alike else order for x in (left, right))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node in ``links(a, b)``."""
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        near = both.join(found.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = found.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = found.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = cut_lineage(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        done = step.where("root < was").isEmpty()
        found = step.select("node", "root")
        if done:
            return found


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """node, root of the components ``found`` after further ``links(a, b)``, of which only those
    between components are followed."""
    ends = links.join(found.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left")
    ends = ends.join(found.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    new = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a != b"))
    moved = found.join(new.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
    return cut_lineage(moved.select("node", F.coalesce("far", "root").alias("root")).unionByName(new.join(found, "node", "left_anti")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class) of every row."""
    return classified(docs).select("doc_id", "class_id")


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and class_id of every row, and ``chosen``: whether it is the row of its
    class with the smallest id and text_key (or a repeat of it)."""
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    marks = stored(signed(docs), "signatures")
    reps = marks.groupBy("node").agg(smallest("doc_id").alias("first")).select("node", "first.rep", "first.text_key")
    nodes = marks.where("bands IS NOT NULL").dropDuplicates(["node"]).select("node", "bands", "digest")
    rows = nodes.select("node", F.explode("bands").alias("band"))
    leaders = rows.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = stored(rows.join(leaders, "band"), "buckets")
    digests = marks.join(buckets.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "bands", "digest")
    digests = stored(digests, "digests")

    def likely(frames):
        for frame in frames:
            one, two = (np.frombuffer(b"".join(frame[c]), dtype=np.uint8).reshape(-1, REGISTERS) for c in ("x", "y"))
            yield frame.loc[(one == two).mean(axis=1) >= LEAST, ["a", "b"]]

    def linked(frames):
        for frame in frames:
            sides = [list(word_hashes(frame[c].tolist())) for c in ("x", "y")]
            good = [node_of(p) == a and node_of(q) == b and similarity(bag(p), bag(q)) >= THRESHOLD for p, q, a, b in zip(*sides, frame["a"], frame["b"])]
            yield frame.loc[np.array(good, dtype=bool), ["a", "b"]]

    def side(of: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return of.select(F.col("node").alias(key), F.col(value).alias(name))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """node and text, once for every node."""
        texts, rows = keyed(docs).withColumnRenamed("text_key", "key"), wanted.join(reps, "node")
        same = texts.doc_id.eqNullSafe(rows.rep) & (texts.key == rows.text_key)
        return texts.join(rows, same).select("node", "text").dropDuplicates(["node"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(side(digests, "a", "digest", "x"), "a").join(side(digests, "b", "digest", "y"), "b")
        pairs = stored(pairs.select("a", "b", "x", "y").mapInPandas(likely, "a long, b long"), "pairs")
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        texts = stored(texts_of(wanted), "texts")
        full = pairs.join(side(texts, "a", "text", "x"), "a").join(side(texts, "b", "text", "y"), "b").select("a", "b", "x", "y")
        return stored(full.mapInPandas(linked, "a long, b long").distinct(), "links")

    led = buckets.where("node != lead").groupBy("node", "lead").agg((-F.count(F.lit(1))).alias("n"))
    found = components(verified(led.groupBy(F.col("node").alias("a")).agg(F.min_by("lead", F.struct("n", "lead")).alias("b"))))

    def divided() -> tuple[DataFrame, DataFrame]:
        """Members of buckets in several components, and for each such bucket its largest component
        (``main``), ``leads`` of that, and how many members are in it and outside."""
        placed = buckets.join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        leads = F.array(*(F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(LEADERS)))
        sizes = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(leads).alias("leads"))
        most = F.max_by(F.struct("root", "n", "leads"), F.struct("n", "root"))
        apart = sizes.groupBy("band").agg(most.alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        return placed, apart.select("band", F.col("m.root").alias("main"), "m.leads", F.col("m.n").alias("inside"), (F.col("all") - F.col("m.n")).alias("outside"))

    placed, apart = divided()
    more = placed.join(apart.select("band", "main", "leads"), "band").where("root != main").select(F.col("node").alias("a"), "main", F.explode("leads").alias("b"))
    more = more.groupBy("a", "main", "b").agg((-F.count(F.lit(1))).alias("n")).groupBy("a", "main")  # a lead has BANDS buckets with a node at most
    more = more.agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "b"))), 1, LEADERS).alias("leads")).select("a", F.explode("leads.b").alias("b"))
    found = merged(found, verified(more.distinct()))

    placed, apart = divided()
    outer, mains = F.ceil(F.col("outside") / BLOCK).cast("int"), F.ceil(F.col("inside") / MAIN).cast("int")
    placed = placed.join(apart.select("band", "main", outer.alias("outer"), mains.alias("mains")), "band")
    hashed, out = F.xxhash64("node"), F.col("root") != F.col("main")
    placed = placed.withColumn("block", F.when(out, F.pmod(hashed, "outer")).otherwise(F.col("outer") + F.pmod(hashed, "mains")).cast("int"))
    others = F.sequence(F.lit(0), F.col("outer") - 1 + F.when(out, F.col("mains")).otherwise(0))
    placed = placed.withColumn("other", F.explode(F.array_remove(others, F.col("block"))))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    placed = placed.select("band", "node", "root", "block", i.alias("i"), j.alias("j"), (j == F.col("outer")).alias("inner"))
    members = placed.join(digests, "node").select("band", "node", "root", "block", "i", "j", "inner", "bands", "digest")

    def still_open(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[np.unique(np.concatenate(open_pairs(frame)))]

    def joining(frame: pd.DataFrame) -> pd.DataFrame:
        words = list(word_hashes(frame["text"].tolist()))
        nodes, root = frame["node"].to_numpy(), frame["root"].tolist()
        whole = [node_of(w) == n for w, n in zip(words, nodes)]
        bags, owner, out = [bag(w) for w in words], {r: r for r in root}, []

        def top(r: int) -> int:
            while owner[r] != r:
                owner[r] = r = owner[owner[r]]
            return r

        for a, b in zip(*(x.tolist() for x in open_pairs(frame))):
            x, y = top(root[a]), top(root[b])
            if x != y and whole[a] and whole[b] and similarity(bags[a], bags[b]) >= THRESHOLD:
                owner[x] = y
                out.append((nodes[a], nodes[b]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    keys = ["band", "i", "j"]
    waiting = stored(members.groupBy(keys).applyInPandas(still_open, members.schema), "apart")
    if not waiting.isEmpty():
        texts = stored(texts_of(waiting.select("node").distinct()), "texts")
        new = stored(waiting.join(texts, "node").groupBy(keys).applyInPandas(joining, "a long, b long"), "links")
        found = merged(found, new)

    owners = reps.join(found, "node", "left").select("node", "rep", "text_key", F.coalesce("root", "node").alias("root"))
    classes = owners.groupBy("root").agg(smallest("rep").alias("first"))
    owned = owners.join(classes, "root").select("node", F.col("first.rep").alias("class_id"), F.col("first.text_key").alias("class_key"))
    chosen = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    return marks.select("doc_id", "text_key", "node").join(owned, "node").select("doc_id", "text_key", "class_id", chosen.alias("chosen"))
