"""Operators on tables against brute force, with nulls, empty tables, ties and repeats."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowflow.llm import bagminhash as B
from rowflow.llm import blocks, forest, pii, toxicity
from rowflow.llm.html import main_text
from rowflow.llm.queries import ORACLES, QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m[0]))


def test_base_spans(spark):
    rng = random.Random(4)
    given = ["", None, "a@b.c_d@e.f", "1.2.3.4.5 999.1.1.1 001.002.3.4", "4111 1111 1111 1111", "+1 (132) 555-1352 +12", "é😀 a.b@c-d.e😀"]
    given += ["9" * 20000, "a@" * 3000, "a" * 30000, "x@y.z " * 1500]
    given += ["".join(rng.choice("a1.@ -+()é😀\n9_4") for _ in range(rng.randint(0, 80))) for _ in range(1000)]
    docs = spark.createDataFrame([(i, x, "n") for i, x in enumerate(given)], "doc_id long, text string, spans string").repartition(8)
    for r in pii.personal_data(docs).collect():
        want = spans(given[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans.startswith(want)
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_contexts_find_new_identifiers_and_masking(spark):
    rows = [(i, f"see it then contact mail: user{i}@site{i}.org today", 1) for i in range(20)]
    rows += [(100, "they said contact mail: someone7@intranet today", 1), (101, "clean text of 1999 words", 1), (None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    extra = spark.createDataFrame([(200 + i, f"reach me at contact id: {i}{i}-55 or contact id: 4{i}.4{i}.1.{i}", 1) for i in range(9)], docs.schema)
    got = {r.doc_id: r.text for r in pii.redacted(docs.unionByName(extra)).collect()}
    assert got[3] == "see it then contact mail: [EMAIL] today" and got[101] == rows[21][1] and got[None] is None
    found = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert "context" not in found[101]
    seeds = [(i, f"ping host-{i}.x gateway node 10.0.0.{i} now", 1) for i in range(12)] + [(50, "so the gateway node 10.9.8.777 fell", 1)]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(seeds, docs.schema)).collect()}
    assert found[50] == "context:20:30"


def test_contexts_find_unseen_forms(spark):
    rng = random.Random(9)
    word = lambda: "w" + rng.choice("abcdefgh") * rng.randint(1, 9) + rng.choice("xyz")
    rows = [(i, f"{word()} it then contact mail: user{i}@site{i}.org today {word()}") for i in range(20)]
    rows += [(20 + i, f"{word()} please call us: +1 (132) 555-13{i:02} soon {word()}") for i in range(20)]
    planted = {100: ("they said contact mail: ", "someone7@intranet", " today"), 101: ("so contact mail: ", "bobsmith", " today")}
    planted |= {102: ("now call us: ", "0132 555 1399", " soon"), 103: ("now call us: ", "1234 5678 9012 3456", ", soon"), 104: ("or contact mail: ", "mary ann at home", " today")}
    rows += [(i, "".join(x)) for i, x in planted.items()] + [(105, "clean text of 1999 words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    for i, (before, hit, _) in planted.items():
        assert f"context:{len(before)}:{len(before) + len(hit)}" in found[i].split(","), i
    assert len(found) == len(rows) and all("context" not in found[i] for i in [*range(40), 105])
    masked = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert masked[100] == "they said contact mail: [ID] today" and masked[102] == "now call us: [ID] soon"


def brute_classes(rows):
    owner = {i: i for i, _ in rows}

    def top(x):
        while owner[x] != x:
            x = owner[x]
        return x

    bags = []
    for i, text in rows:
        w = (text or "").lower().split()
        bags.append((i, w, Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))))
    for n, (i, v, a) in enumerate(bags):
        for j, w, b in bags[:n]:
            both = sum((a & b).values())
            if v == w or v and w and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                owner[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i, _ in rows}


def test_near_duplicates(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(150)) for _ in range(12)]
    rows, n = [], 0
    for text in base:
        words = text.split()
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "new" + str(n)
            rows.append((n, " ".join(copy)))
            n += 1
    group = base[0].split()
    for _ in range(60):  # many near copies whose similarity is about the threshold
        copy = list(group)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = "late" + str(n)
        rows.append((n, " ".join(copy)))
        n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "one two"), (n + 3, "ONE two"), (n + 4, "la " * 400), (n + 5, "la " * 420)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, node string").repartition(6)
    got = {r.doc_id: r.class_id for r in B.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)
    assert B.near_duplicates(docs.limit(0)).count() == 0


def test_members_of_the_largest_component_are_dealt_once(spark, monkeypatch):
    """Of a bucket with few members outside its largest component every member lies in one task."""
    monkeypatch.setattr(B, "BLOCK", 8)
    paths, path = {}, B.scratch_path
    monkeypatch.setattr(B, "scratch_path", lambda *x: paths.setdefault(x[1], path(*x)) if x[1] == "apart" else path(*x))
    rows = list(enumerate(varied(61, 1, 51) + varied(6, 4, 51)[1:]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in B.near_duplicates(docs).collect()} == brute_classes(rows)
    apart = spark.read.parquet(paths["apart"])
    assert apart.count() > 0 and apart.groupBy("band", "node").count().agg(F.max("count")).first()[0] == 1
    # the same classes where many are outside and blocks of either kind are many
    monkeypatch.setattr(B, "MAIN", 4)
    paths.clear()
    rows = list(enumerate(varied(30, 1, 52) + varied(40, 2, 52)[1:] + varied(20, 3, 52)[1:]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in B.near_duplicates(docs).collect()} == brute_classes(rows)


def test_comparisons_of_a_group_grow_with_its_nodes(spark, monkeypatch):
    """Near copies are compared with one leader each, then with LEADERS members of a component at
    most, however many buckets they share."""
    paths, path = [], B.scratch_path
    monkeypatch.setattr(B, "scratch_path", lambda *x: paths.append(path(*x)) or paths[-1])
    rows = list(enumerate(varied(80, 3, 53)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in B.near_duplicates(docs).collect()} == brute_classes(rows)
    first = spark.read.parquet(next(x for x in paths if "/pairs-" in x))
    assert first.groupBy("a").count().agg(F.max("count")).first()[0] == 1


def test_links_are_added_to_components(spark):
    links = lambda *x: spark.createDataFrame(x, "a long, b long")
    found = B.components(links((2, 1), (4, 3), (6, 5)))
    got = {r.node: r.root for r in B.merged(found, links((4, 6), (9, 8), (8, 6), (11, 10), (2, 1))).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 8: 3, 9: 3, 10: 10, 11: 10}
    assert {r.node: r.root for r in B.merged(found, links()).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}


def varied(n, changes, seed):
    rng = random.Random(seed)
    words, out = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(150)], []
    for i in range(n):
        copy = list(words)
        for k in range(changes if i else 0):
            copy[rng.randrange(150)] = f"new{i}x{k}"
        out.append(" ".join(copy))
    return out


def test_pipeline_keeps_one_row_per_class_with_repeated_ids(spark):
    import corpus_pipeline

    others = [varied(1, 0, seed)[0] for seed in range(20, 30)]
    a, b = varied(3, 1, 31), varied(2, 1, 32)
    rows = [(0, t) for t in others] + [(5, a[0]), (7, a[1]), (8, a[2]), (5, b[0]), (3, b[1]), (0, others[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(map(tuple, corpus_pipeline.drop_copies(spark, docs, "").collect()))
    assert kept == sorted([*((0, t) for t in others), (5, a[0]), (3, b[1])])


def test_null_ids_have_classes(spark):
    import corpus_pipeline

    a, b = varied(4, 1, 41), varied(3, 1, 42)
    rows = [(None, t) for t in [*a, *a[:2], *b[1:], *b[1:]]] + [(9, b[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [r.class_id for r in B.near_duplicates(docs).where("doc_id IS NULL").collect()].count(9) == 4
    kept = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} == {None, 9} and next(r.text for r in kept if r.doc_id is None) in a


def test_overlapping_spans_are_masked_whole(spark):
    card = next(f"4 5678 9012 3456 78{i:02}" for i in range(100) if good("card", f"4 5678 9012 3456 78{i:02}"))
    rows = [(1, f"x 1.2.3.{card} y"), (2, "x +1 10.0.0.1 5551234 y"), (3, "a@b.org 1.2.3.4, z@q.net"), (4, None)]
    got = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "x [IP] y", 2: "x [PHONE] y", 3: "[EMAIL] [IP], [EMAIL]", 4: None}


def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(5), []
    for _ in range(40):
        names = rng.integers(0, 2**63, size=rng.integers(5, 200), dtype=np.uint64)
        one = rng.integers(0, rng.choice([2, 5, 40]), size=len(names))
        two = np.maximum(0, one + rng.integers(-2, 3, size=len(names)) * (rng.random(len(names)) < 0.5))
        if not one.sum() or not two.sum():
            continue
        text = np.concatenate([np.zeros((one > 0).sum(), int), np.ones((two > 0).sum(), int)])
        a, b = B.signatures(text, np.concatenate([names[one > 0], names[two > 0]]), np.concatenate([one[one > 0], two[two > 0]]), 2)
        errors.append((a == b).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def vectors(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] + [1.0] * 15), (None, [1.0] * 16)]
    return x.astype(np.float64), spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)


def test_forest_recall(spark):
    x, table = vectors(spark)
    rows = forest.search(table, table.where("vec_id % 20 = 0"), 20).collect()
    asked = np.arange(0, len(x), 20)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = {int(q): set(np.lexsort((np.arange(len(x)), -s))[:20].tolist()) for q, s in zip(asked, scores.round(9))}
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(best)
    for q, own in found.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert np.allclose([r.score for r in own], [x[q] @ x[r.vec_id] for r in own])
    assert np.mean([len({r.vec_id for r in found[q]} & best[q]) / 20 for q in best]) >= 0.9
    assert forest.search(table.limit(0), table, 20).count() == 0


def test_forest_with_repeated_ids(spark):
    x, table = vectors(spark)
    many = spark.createDataFrame([(7, (x[40] * f).tolist()) for f in (0.5, 1.0, 2.0) for _ in range(40)], table.schema)
    asked = np.arange(0, len(x), 20)
    scores = x[asked] @ x.T
    scores[:, 7] = np.maximum(scores[:, 7], (x[asked] @ np.outer([0.5, 1, 2], x[40]).T).max(axis=1))
    scores[np.arange(len(asked)), asked] = -np.inf
    best = {int(q): set(np.lexsort((np.arange(len(x)), -s))[:20].tolist()) for q, s in zip(asked, scores.round(9))}
    found = {}
    for r in forest.search(table.unionByName(table).unionByName(many), table.where("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(best) and all(len(own) == len(set(own)) == 20 for own in found.values())
    assert np.mean([len(set(found[q]) & best[q]) / 20 for q in best]) >= 0.9


def test_block_search_is_exact(spark):
    x, table = vectors(spark, 1500)
    whole = np.floor(1024 * np.concatenate([x, np.zeros((1, 16))])).astype(int)
    ids = np.append(np.arange(1500), 1501)
    want = []
    for q in range(0, 1500, 100):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        want += [(q, k + 1, int(ids[i]), int(s[i])) for k, i in enumerate(order)]
    got = sorted(tuple(r) for r in blocks.search(table, table.where("vec_id % 100 = 0"), 10).collect())
    assert got == [w for w in sorted(want)]
    assert blocks.search(table.limit(0), table.limit(0), 10).count() == 0


def test_block_pruning_skips_blocks():
    rng = np.random.default_rng(3)
    centres = rng.integers(-900, 900, size=(20, 8)) * 1.0
    rows = np.repeat(centres, 100, axis=0) + rng.integers(-5, 6, size=(2000, 8))
    *_, scored = blocks.pruned_search(np.arange(2000), rows, np.arange(20) * 100, rows[::100], 5, block=100)
    assert scored < 20 * 20 / 2


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(60)] = "vileword" + rng.choice("abcdefgh")
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (700, None), (None, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.with_scores(docs, model).collect()}
    assert all(got[i].toxic == (i % 5 == 0) for i in range(600)) and not got[700].toxic
    assert (np.diff(model.thresholds) > 0).all() and all(0 <= r.severity <= 3 for r in got.values())
    many = [got[i].severity for i, t in rows if t.count("vileword") >= 5]
    assert min(many) > np.mean([got[i].severity for i, t in rows if t.count("vileword") == 1])
    none = toxicity.with_scores(docs, toxicity.fit(docs, known.limit(0)))
    assert none.where("toxic").count() == 0 and none.count() == docs.count()


PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=a>Home</a></nav>
<div id=content><div class='post-body'><h2>T</h2><p>One, two &amp; three   words
here.<p>Two <i>in</i>line<script>var a="</p>";</script></p><ul><li>a<li>b</ul></div>
<div class='comments'><p>nice, very, good, wow, so many, commas, here</p></div></div><div class=sidebar><p>links, a, b</p></div>
<div class="cookie-notice">We use cookies, many, many</div><form><p>Name,,,,,</p></form><footer>&copy; all</footer></body>"""


@pytest.mark.parametrize(
    "page,text",
    [
        (PAGE, "T\nOne, two & three words here.\nTwo inline\na\nb"),
        (None, ""),
        ("", ""),
        ("just text, no tags", "just text, no tags"),
        ("<article><p>Short.</p></article><footer>long, long, footer, text</footer>", "Short."),
        ("<article><h1>A &quot;b&quot;</h1><p><b>x<br><p>y", 'A "b"\nx\ny'),
        ("<p>a<!-- b --><![CDATA[c]]></p><p>" + "z" * 100_000, "ac\n" + "z" * 100_000),
        ("<div " + "<a \"" * 2000, ""),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


LINE = "A first part, a second part, and a third part that make one sentence of the page."


@pytest.mark.parametrize(
    "body,text",
    [
        (f"<div id=content><h1>Title</h1><div class=entry-body><p>{LINE}</p><p>{LINE}</p></div></div>", f"Title\n{LINE}\n{LINE}"),
        (f"<div id=c><div>{f'<p>{LINE}</p>' * 9}</div><div><h2>Heading</h2><p>Some text.</p></div></div>", "\n".join([LINE] * 9 + ["Heading", "Some text."])),
        (f"<div id=c>{f'<div class=row><div class=col><p>{LINE}</p></div></div>' * 4}</div>", "\n".join([LINE] * 4)),
        (f"<div id=c><h1>T</h1><div>{f'<div class=row><div class=col><p>{LINE}</p></div></div>' * 2}</div></div>", f"T\n{LINE}\n{LINE}"),
        (f"<div id=c><div><p>{LINE}</p><p>{LINE}</p></div><h3>More</h3><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>", f"{LINE}\n{LINE}"),
    ],
)
def test_main_text_without_article(body, text):
    assert main_text(f"<html><body><div class=sidebar><p>{LINE}</p></div>{body}<footer>end</footer></body></html>") == text


def test_queries_and_pipeline(spark):
    import corpus_pipeline
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    name = "op10_block_topk"
    assert sorted(map(tuple, QUERIES[name](spark, folder).collect())) == sorted(con.execute(ORACLES[name]).fetchall())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    unique = corpus_pipeline.drop_copies(spark, docs.unionByName(docs), folder)
    classes = brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in unique.select("doc_id").collect()) == sorted(set(classes.values()))
    masked = corpus_pipeline.mask_personal_data(spark, docs, folder)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    for r in masked.where(F.col("text").contains("@")).collect():
        assert not re.search(PATTERNS["email"], r.text)
    rows = corpus_pipeline.run(spark, folder)
    whole = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("want"))
    assert whole.where("n != want").isEmpty() and whole.count() > 0
