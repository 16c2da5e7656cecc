"""Token alignment, subvector clusters and repeated bytes against plain versions."""

import functools
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rowflow.llm import alignment as A
from rowflow.llm import clusters as C
from rowflow.llm import repeats as R
from rowflow.llm.queries import byte_level_and_pieces, tokenizer

ONE, TWO = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(ONE)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=TWO)


SIDES = byte_level_and_pieces(ONE, TWO)


def groups(text):
    """[(ids of the one, ids of the other)] by sets of ends."""
    if not text:
        return []
    one, two = libraries()
    vocab_a, vocab_b = SIDES[2]()
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    for ids, vocab in ((a, vocab_a), (b, vocab_b)):
        if b"".join(vocab.joined(np.array([i])).tobytes() for i in ids) != (" " + text).encode():
            return []
    ends_a, ends_b = (np.cumsum([int(v.size[i]) for i in ids]).tolist() for ids, v in ((a, vocab_a), (b, vocab_b)))
    out, low = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        out.append(([i for i, e in zip(a, ends_a) if low < e <= end], [i for i, e in zip(b, ends_b) if low < e <= end]))
        low = end
    return out


def links(found):
    return [(x, y) for a, b in found for x in a for y in b]


TEXTS = ["plain words of a text", "plain words, of a text", "", None, "Привет, мир! 你好 世界 😀😀", "a▁b", " two  blanks ", "<|endoftext|> is text", "<0x41> A", "x" * 3000 + " " + "=" * 700, "é́\t\r\n\x00z", "�", "the " * 900, "word " * 2 + "\n" * 50]


def test_alignment_against_sets_of_ends(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu éñ世") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(40)] + TEXTS[:2]
    rows = [(i if i != 7 else None, x, "n", 9) for i, x in enumerate(texts)] + [(3_000_000_000_000_000_001, "plain words", "n", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string, n_links int").repartition(5)
    found = {r[0]: groups(r[1]) for r in rows}
    count = Counter(p for g in found.values() for p in set(links(g)))
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    for chunk_links in (1 << 20, 300):
        got = A.align(docs, *SIDES, chunk_links=chunk_links)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        got = got.collect()
        assert len(got) == len(rows)
        for r in got:
            g = found[r.doc_id]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            own = links(g)
            want = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own))
            assert tuple(r)[1:7] == want and r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
    assert A.align(docs.limit(0), *SIDES).count() == 0


def test_lockstep_lanes():
    rng = np.random.default_rng(2)
    a, b = (np.unique(np.append(rng.integers(1, 5000, size=900), 5000)) for _ in range(2))
    want = np.intersect1d(a, b)
    for lane in (1, 7, 64, 5000):
        lows = np.arange(0, 5000, lane)
        cut_a, cut_b = A.lockstep(a, b, lows, np.minimum(lows + lane, 5000))
        assert a[cut_a - 1].tolist() == want.tolist() == b[cut_b - 1].tolist()


def plain_clusters(rows, k, rounds, scale):
    """Lists of integers, all distances one by one."""
    x = [(i, [int(np.floor(scale * float(v))) for v in e]) for i, e in rows]
    start = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [c for _, c in start]
    for turn in range(rounds + 1):
        apart = [[sum((p - q) ** 2 for p, q in zip(e, c)) for c in centres] for _, e in x]
        own = [d.index(min(d)) for d in apart]
        if turn < rounds:
            for j in range(len(centres)):
                mine = [e for (_, e), o in zip(x, own) if o == j]
                if mine:
                    centres[j] = [sum(v) // len(mine) for v in zip(*mine)]
    inertia = Counter()
    for d, o in zip(apart, own):
        inertia[o] += d[o]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, o, d[o], inertia[o], sum(inertia.values()), name[o]) for (i, _), d, o in zip(x, apart, own)]


@pytest.mark.parametrize("width,block,chunk,k,rounds", [(6, 2, 37, 4, 3), (5, 3, 1000, 16, 2), (64, 2, 50, 16, 3)])
def test_clusters_against_plain(spark, width, block, chunk, k, rounds):
    rng = np.random.default_rng(width)
    rows = [(int(i), [float(v) for v in rng.normal(size=width).astype(np.float32)]) for i in rng.permutation(150)]
    rows += [(500, [0.25] * width), (501, [0.25] * width), (502, [-0.25] * width), (3, rows[0][1]), rows[1], (None, [1.5] * width), (9_007_199_254_740_993, [0.5] * width)]
    bad = [(600, None), (601, [1.0] * (width + 1)), (602, [None] * width), (603, [float("nan")] * width), (604, [float("inf")] + [0.0] * (width - 1)), (605, [])]
    frame = spark.createDataFrame([(i, e, 1, "x") for i, e in rows + bad], "vec_id long, embedding array<float>, cluster int, codes string").repartition(3)
    got = C.cluster(frame, k, rounds, width, 64, chunk=chunk, block=block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_clusters(rows, k, rounds, 64), key=str)
    assert C.cluster(frame.where("vec_id >= 600 AND vec_id < 700"), k, rounds, width).count() == 0


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, C.cluster(frame, 16, 3, 2).collect())) == sorted(plain_clusters(rows, 16, 3, 64))


def test_dictionaries_are_lossless():
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, size=(500, 7)) * (1 << 20)
    codes, entries = C.encode(x, 3)
    assert np.array_equal(np.concatenate([e[c] for c, e in zip(codes.T, entries)], axis=1), x)
    assert all(len(np.unique(e, axis=0)) == len(e) for e in entries)


def test_classes_of_the_transform():
    rng = random.Random(1)
    for least in (1, 2, 3, 8, 9, 17, 40):
        parts = ["".join(rng.choice("ab"[: rng.randint(1, 2)]) for _ in range(rng.randint(1, 90))) for _ in range(9)]
        raw = "\x00".join(parts).encode().replace(b"\x00", b"\xff") + b"\xff"
        classes, by_window = R.repeated(np.frombuffer(raw, dtype=np.uint8), least), {}
        for i in range(len(raw) - least + 1):
            if 0xFF not in raw[i : i + least]:
                by_window.setdefault(raw[i : i + least], set()).add(int(classes[i]))
        assert all(len(c) == 1 for c in by_window.values()) and len(set.union(set(), *by_window.values())) == len(by_window)


def plain_repeats(rows, least):
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            if data[i : i + least] in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(data[i : i + least])
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot,chunk", [(1024, 1 << 21), (2, 3000)])
def test_repeats_against_plain(spark, hot, chunk):
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abcdefgé世") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = prose(14), prose(90)
    rows = [(i, f"{prose(rng.randint(0, 60))} {line} {prose(rng.randint(0, 30))}") for i in range(120)]
    rows += [(200 + i, prose(5) + passage[i : i + 300] + prose(5)) for i in range(40)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    rows += [(400, "=" * 5000), (401, "=" * 99), (402, "=" * 100 + "x" + "=" * 101), (403, "ab" * 6000), (404, ""), (405, None), (406, prose(4000) + passage)]
    rows.insert(0, (None, passage))
    docs = spark.createDataFrame([(i, x, 0, "c") for i, x in rows], "doc_id long, text string, chunk int, keys string").repartition(6)
    got = R.remove_repeats(docs, hot=hot, chunk=chunk, bucket=20_000)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_repeats(rows, 100), key=str)


def test_repeats_of_equal_rows_and_no_rows(spark):
    text = "some words that are long enough to be found again " * 3
    docs = spark.createDataFrame([(1, text), (1, text), (1, "short")], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in R.remove_repeats(docs).collect())
    assert got == sorted([(5, 0, 0), *[r[1:4] for r in plain_repeats([(1, text), (1, text)], 100)]])
    assert R.remove_repeats(docs.limit(0)).count() == 0


def test_secrets_are_learned_from_their_context(spark):
    """A secret without the strict form is found where strict ones stand; other long words are not."""
    from rowflow.llm import pii

    rng = random.Random(2)
    word = lambda: "w" + rng.choice("abcdefgh") * rng.randint(1, 9) + rng.choice("xyz")
    rows = [(i, f'{word()} {word()} token = "{rng.getrandbits(160):040x}" {word()} {word()}') for i in range(12)]
    rows += [(20, 'or token = "Zx81-weaker_secret77" here'), (21, f"commit {rng.getrandbits(160):040x} stays"), (22, None), (23, "")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, context string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, text in rows[:13]:
        at = text.index('"') + 1
        assert got[i].spans == f"context:{at}:{text.rindex(chr(34))}" and got[i].n_context == 1
    assert all(got[i].n_context == 0 and got[i].spans == "" for i in (21, 22, 23))
    masked = {r.doc_id: (r.text, r.context) for r in pii.redacted(docs).collect()}
    assert masked[20] == ('or token = "[ID]" here', "c") and masked[22] == (None, "c")


def test_graph_scores_against_plain(spark):
    from rowflow.llm import pii

    rng = random.Random(6)
    patterns = {k: rng.choice(["email", "phone", "secret"]) for k in range(12)}
    seeds = {(k, f"s{rng.randint(0, 30)}") for k in patterns for _ in range(rng.randint(1, 12))}
    values = [f"a{i}@b" for i in range(8)] + [f"+1 {i}55 123" for i in range(8)] + [f"plain{i}" for i in range(8)] + [f"{rng.getrandbits(128):032x}" for _ in range(4)]
    edges = {(k, rng.choice(values)) for k in patterns for _ in range(rng.randint(0, 6))}

    def loose(kind, v):
        digits = sum(c.isdigit() for c in v)
        if kind == "email":
            return "@" in v
        if kind == "secret":
            return len(v) >= 16 and all(c.isalnum() or c in "_/+=-" for c in v) and digits > 0 and any(c.isalpha() for c in v)
        return digits >= 5 and all(c in "0123456789+() ./-" for c in v)

    start = {(k, v): float(len(v) == 32 and not v.startswith("plain")) for k, v in edges} | {s: 1.0 for s in seeds}
    trust, precision = {}, {}
    for _ in range(pii.ROUNDS):
        held = {}
        for (k, v), t in start.items():
            held.setdefault(k, []).append(max(t, trust.get(v, 0.0)))
        precision = {k: sum(x) / len(x) for k, x in held.items()}
        trust = {}
        for k, v in edges:
            score = min(1.0, precision[k] + pii.FORM * loose(patterns[k], v))
            if precision[k] >= pii.LEAST_PRECISION - pii.FORM and score >= pii.LEAST_PRECISION:
                trust[v] = max(trust.get(v, 0.0), score)
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    got = pii.scored_graph(frame(seeds, "key long, value string"), frame(edges, "key long, value string"), frame(patterns.items(), "key long, kind string"))
    got = {r.key: r.precision for r in got.collect()}
    assert got.keys() == precision.keys() and all(abs(got[k] - p) < 1e-9 for k, p in precision.items())


def test_clashing_columns_of_the_toxicity_stage(spark):
    from rowflow.llm import toxicity

    docs = spark.createDataFrame([(1, "a b", True, 2.0, 5), (2, None, None, None, None)], "doc_id long, text string, toxic boolean, severity double, grade int")
    kept = toxicity.without_toxic(docs, toxicity.Model())
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))
