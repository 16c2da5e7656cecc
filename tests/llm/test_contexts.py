"""The word passes of the personal data operator."""

import random

import pytest
from pyspark.sql import functions as F

from rowflow.llm import pii


@pytest.mark.parametrize("listed", [2000, 0])
def test_occurrences_against_the_contexts_of_every_word(spark, monkeypatch, listed):
    """The same occurrences as a look at the contexts of every word, by the list and by the join."""
    monkeypatch.setattr(pii, "LISTED", listed)
    rng = random.Random(8)
    word = lambda: rng.choice(["mail:", "call", "to", "x7", "12 55", "a@b.cd", "(99)", "so"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", " "]
    rows = pii.base_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).localCheckpoint()
    seeds = pii.seeds_of(rows).distinct()
    patterns = seeds.where("key % 3 != 0").select("key", "anchor", "right").distinct().localCheckpoint()
    keys = [r.key for r in patterns.collect()]
    got = sorted(map(tuple, pii.occurrences(rows, patterns).select("doc_id", "at", "words", "key").collect()))
    want, broken = [], {r[0] for r in spark.range(1).select(F.explode(F.array(F.xxhash64(F.lit(pii.MASK)), F.xxhash64(F.lit(pii.EDGE))))).collect()}
    for r in pii.words_of(rows).collect():
        if any(code in r.w for code in pii.CODES) or not any(c.isalnum() for c in r.w):
            continue
        for name, (m, _) in pii.CONTEXTS.items():
            if r[name] in keys and not broken & {r[f"r{i}"] for i in range(1, m)}:
                want.append((r.doc_id, r.at, m, r[name]))
    assert keys and got == sorted(want)
    made = pii.words_of(rows, lambda w, near: near(-1) == F.xxhash64(F.lit("call"))).collect()
    every = pii.words_of(rows).collect()
    call = spark.range(1).select(F.xxhash64(F.lit("call"))).first()[0]
    assert sorted(made, key=str) == sorted((r for r in every if r.l1 == call), key=str) and len(made) < len(every)


def test_only_words_in_a_pattern_become_rows(spark, monkeypatch):
    """A word beside a common neighbour is no row unless its whole context is a pattern."""
    rows = [(i, f"so the user{i}@site{i}.org " + f"{'of the w%d ' % i * 50}and the x") for i in range(8)]
    rows = pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string")).localCheckpoint()
    l2 = pii.words_of(rows).where("doc_id = 0 AND at = 2").first()
    made, words_of = [], pii.words_of
    monkeypatch.setattr(pii, "words_of", lambda *x: made.append(words_of(*x)) or made[-1])
    patterns = spark.createDataFrame([(l2.k_l2, l2.l1, False)], "key long, anchor long, right boolean")
    assert pii.occurrences(rows, patterns).count() == 0 and made[0].count() == 8


@pytest.mark.parametrize("sent", [1_000_000, 3])
def test_many_patterns_go_to_the_words(spark, monkeypatch, sent):
    """Beyond the list no word is shuffled to meet the patterns, however few of them are sent at once, and nothing is made of words outside them."""
    rows = [(i, f"mail: user{i}@site{i}.org, or call +1 555 010 0{i:02d} and w{i} so mail: x{i} or") for i in range(30)]
    rows = pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string")).localCheckpoint()
    patterns = pii.seeds_of(rows).select("key", "anchor", "right").distinct().localCheckpoint()
    want = sorted(map(tuple, pii.occurrences(rows, patterns).collect()))
    monkeypatch.setattr(pii, "LISTED", 0)
    monkeypatch.setattr(pii, "SENT", sent, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = pii.occurrences(rows, patterns)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert want and sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == -(-patterns.select("key").distinct().count() // sent) and "hashpartitioning" not in plan
    assert "regexp_replace(w" not in plan[plan.rindex("BroadcastHashJoin") :].split("\n", 1)[1]


def test_texts_stay_where_they_are(spark):
    """No whole text is shuffled to meet the few spans that contexts add."""
    rows = [(i, f"so token = {i:031x}a and", "x") for i in range(10, 40)] + [(90, "so token = zz9-zz9-zz9-zz9-zz9 and", "x"), (91, None, "x"), (None, "to a@b.cd", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = pii.redacted(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {r.doc_id: r.text for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert len(found) == 33 and found[10] == found[90] == "so token = [ID] and" and found[91] is None and found[None] == "to [EMAIL]"


def test_a_text_is_matched_once(spark):
    """The matches of a text are one expression, not one per chunk of them."""
    told = str(pii.located(F.col("text"), pii.WORD, r"\S")._jc)
    assert told.count("regexp_extract_all") == told.count("split(") == 1
    text = " ".join(f"w{i}" for i in range(5000))
    (spans,) = spark.createDataFrame([(text,)], "text string").select(pii.located(F.col("text"), pii.WORD, r"\S")).first()
    assert [(s.start, s.end) for s in spans] == [(m, m + len(f"w{i}")) for i, m in enumerate(_starts(text))]


def _starts(text):
    at = 0
    for word in text.split(" "):
        yield at
        at += len(word) + 1
