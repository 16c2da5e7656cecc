"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings (4 to 6 characters), counted in a text. They are chosen
on a bounded sample of labelled documents (at most PER_CLASS of either label, the smallest
hashes of their ids) by how much more often toxic documents have them. Labels only say toxic or
not, so a toxic document of the sample is graded 1, 2 or 3 by the terciles of its feature
count, a clean one 0. The model has one weight per feature, shared by the ordered thresholds:
P(grade <= k) = logistic(threshold_k - w . log(1 + counts)). Every document is scored; its
severity is the expected grade. It counts as toxic when P(grade > 0) is above LEAST_CUT and above
that of all but CLEAN_ABOVE of the clean documents of the sample.

Null and empty texts have no features. Labels that are null are not used, of several labels of
a document the toxic one counts. Without toxic or without clean labels nothing can be learned
and nothing is toxic. Repeated rows and null ids are scored like any other.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowflow.llm.ragged import SegmentTable, numbers_of_texts
from rowflow.session import scratch_path

PER_CLASS = 4096
MOST_FEATURES = 4096
LEAST_EVIDENCE = 30.0
LEAST_CUT = 0.15
CLEAN_ABOVE = 0.002
STARTS = (4, 5, 6)
TABLE_BITS = 18  # distinct words that a worker remembers, as a power of two
GRADES = 4
SCHEMA = "severity double, p_toxic double, grade int, toxic boolean"


@dataclass
class Model:
    features: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([1e3, 2e3, 3e3]))
    cut: float = 0.5

    def above(self, line: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, for linear scores."""
        return 1 / (1 + np.exp(-np.clip(line[:, None] - self.thresholds, -700, 700)))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, text and toxic of the documents a model is fitted on; copies that share the least
    hash of their word triples count once, else words of a copied document would look telling."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(per_class)
    picked = picked.unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(per_class))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id")  # at most 2 * per_class ids
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")
    triples = F.expr("transform(sequence(0, greatest(size(words) - 3, 0)), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)))")
    rows = rows.withColumn("words", words).withColumn("copy", F.array_min(triples)).drop("words")
    return rows.groupBy("toxic", "copy").agg(F.min_by("doc_id", F.struct("doc_id", "text")).alias("doc_id"), F.min_by("text", F.struct("doc_id", "text")).alias("text"))


def chosen_features(rows: DataFrame, most: int = MOST_FEATURES) -> list[str]:
    """The features that speak for toxic: eight times as often in toxic documents as in clean ones,
    and more often than chance brings about among a million features (log-likelihood ratio of
    LEAST_EVIDENCE); the clearest first."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))
    starts = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STARTS]
    named = rows.select("doc_id", "toxic", F.explode(words).alias("word")).where("word != ''")
    named = named.select("doc_id", "toxic", F.explode(F.array("word", *starts)).alias("feature")).where("feature IS NOT NULL").distinct()
    counts = named.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    sizes = dict(rows.groupBy("toxic").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return []
    ratio = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    share, both = bad / (bad + good), F.col("bad") + F.col("good")
    evidence = 2 * (F.col("bad") * F.log(F.col("bad") / (share * both)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / ((1 - share) * both))).otherwise(0))
    found = counts.where("bad > 0").withColumn("evidence", evidence).where((F.col("evidence") >= LEAST_EVIDENCE) & (ratio >= 8))
    return [r[0] for r in found.orderBy(F.desc("evidence"), "feature").limit(most).select("feature").collect()]


@functools.cache
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() or c == 0x5F for c in range(0x110000)), dtype=bool, count=0x110000)


def words(codes: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    inside = np.concatenate([[False], _word_characters()[codes], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


_tables: dict[tuple[str, ...], SegmentTable] = {}


def _drop_other_tables() -> None:
    """A reused worker may still hold the table and the tokenizer of another operator."""
    for name, kept in (("bytelevel", "table"), ("pieces", "_table"), ("viterbi", "counter")):
        module = sys.modules.get(f"rowflow.llm.{name}")
        clear = getattr(getattr(module, kept, None), "cache_clear", None)
        if clear:
            clear()


def features_of_texts(texts: Iterable[str], features: list[str]) -> Iterator[np.ndarray]:
    """The numbers of the features of every text, one for each time they occur."""
    key = tuple(features)
    if key not in _tables:
        _tables.clear()
        _drop_other_tables()
        number = {x: i for i, x in enumerate(features)}

        def answer(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lists = [[number[x] for x in (w, *(w[:n] + "*" for n in STARTS if len(w) > n)) if x in number] for w in found]
            return np.array([i for x in lists for i in x], dtype=np.uint32), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))

        _tables[key] = SegmentTable(answer, bits=TABLE_BITS)
    return numbers_of_texts((x.lower() for x in texts), words, _tables[key])


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, size: int, share: float, steps: int = 600, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of least penalised negative log-likelihood, for a sparse
    matrix given by its entries; toxic rows together weigh ``share``, the rest what is left to 1."""
    n = len(grades)
    per = np.bincount(grades > 0, minlength=2)
    weight = np.where(grades > 0, share / max(per[1], 1), (1 - share) / max(per[0], 1))
    w, t = np.zeros(size), np.array([1.0, 0.0, 0.0])  # thresholds: first, then logs of the gaps
    m = [np.zeros(size), np.zeros(GRADES - 1)]
    v = [np.zeros(size), np.zeros(GRADES - 1)]
    for step in range(1, steps + 1):
        cuts = np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])
        line = np.bincount(rows, weights=values * w[columns], minlength=n)
        upper = np.concatenate([cuts, [np.inf]])[grades] - line
        lower = np.concatenate([[-np.inf], cuts])[grades] - line
        up, low = (1 / (1 + np.exp(-np.clip(x, -500, 500))) for x in (upper, lower))
        up, low = np.where(np.isposinf(upper), 1.0, up), np.where(np.isneginf(lower), 0.0, low)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = weight * up * (1 - up) / p, weight * low * (1 - low) / p
        slope_line = d_up - d_low  # of the loss by the linear score
        g_cut = np.zeros(GRADES)
        np.add.at(g_cut, grades, -d_up)
        np.add.at(g_cut, grades - 1, np.where(grades > 0, d_low, 0))
        g_cut = g_cut[: GRADES - 1]
        g_t = np.concatenate([[g_cut.sum()], [np.exp(t[k]) * g_cut[k:].sum() for k in range(1, GRADES - 1)]])
        g_w = np.bincount(columns, weights=values * slope_line[rows], minlength=size) + penalty * w / max(size, 1) ** 0.5
        rate = 0.1 * (1 - step / (steps + 1))
        for i, (x, g) in enumerate(((w, g_w), (t, g_t))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
        np.maximum(w, 0, out=w)  # features were chosen because they speak for toxic
    return w, np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "toxicity-sample")
    sample(docs, labels, per_class).repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    rows = spark.read.parquet(path)  # read several times below
    features = chosen_features(rows)
    if not features:
        return Model()

    def counted(frames):
        for frame in frames:
            lists = [np.unique(x, return_counts=True) for x in features_of_texts(frame["text"].tolist(), features)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "ids": [x.tolist() for x, _ in lists], "counts": [c.tolist() for _, c in lists]})

    found = rows.select("doc_id", "text", F.col("toxic").cast("int")).mapInPandas(counted, "doc_id long, toxic int, ids array<int>, counts array<int>").collect()
    found.sort(key=lambda r: r.doc_id)
    toxic = np.array([r.toxic for r in found])
    total = np.array([sum(r.counts) for r in found])
    bounds = np.quantile(total[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (total > bounds[0]).astype(int) + (total > bounds[1]), 0)
    at = np.repeat(np.arange(len(found)), [len(r.ids) for r in found])
    columns = np.array([i for r in found for i in r.ids], dtype=np.int64)
    values = np.log1p(np.array([c for r in found for c in r.counts], dtype=np.float64))
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    weights, thresholds = fit_ordinal(at, columns, values, grades, len(features), share)
    model = Model(features, weights, thresholds)
    p = model.above(np.bincount(at, weights=values * weights[columns], minlength=len(found)))[:, 0]
    model.cut = max(LEAST_CUT, float(np.quantile(p[toxic == 0], 1 - CLEAN_ABOVE, method="higher")))
    return model


def scores(texts: Iterable[str], model: Model) -> Iterator[tuple[float, float, int, bool]]:
    """severity, p_toxic, grade and toxic of every text."""
    for ids in features_of_texts(texts, model.features):
        found, count = np.unique(ids, return_counts=True)
        above = model.above(np.array([float(np.log1p(count) @ model.weights[found])]))[0]
        each = np.concatenate([[1.0], above]) - np.concatenate([above, [0.0]])
        yield float(above.sum()), float(above[0]), int(np.argmax(each)), bool(above[0] > model.cut)


MARK = "toxicity scores of the row"


def marked(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with the columns of SCHEMA in the struct MARK, which clashes with no
    column of theirs."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(c.replace(' ', ': ') for c in SCHEMA.split(', '))}>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(list(scores(part.tolist(), model)), columns=names)

    return docs.withColumn(MARK, score(F.coalesce("text", F.lit(""))))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with the columns of SCHEMA."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return marked(docs, model).select(*docs.columns, *(F.col(f"`{MARK}`.{n}").alias(n) for n in names))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, with their columns alone."""
    return marked(docs, model).where(f"NOT `{MARK}`.toxic").select(*(F.col(f"`{c}`") for c in docs.columns))
