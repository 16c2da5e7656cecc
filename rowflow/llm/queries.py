"""One registered query per operator, on the whole table it is meant for."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level(path: str, end: int):
    """An encoder of texts that appends the id ``end`` to every document."""

    def encode(texts):
        from rowflow.llm.bytelevel import ids_of_texts

        for ids in ids_of_texts(texts, path, added=True):
            yield np.append(ids, np.uint32(end))

    return encode


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def per_text(docs: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Rows of ``fn(texts)`` (an iterator in, an iterator of tuples out) beside their doc_id."""
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(frames):
        owners: list = []

        def texts():
            for frame in frames:
                owners.extend(None if pd.isna(x) else int(x) for x in frame["doc_id"].tolist())
                yield from frame["text"].tolist()

        rows = []
        for at, row in enumerate(fn(texts())):
            rows.append((owners[at], *row))
            owners[at] = None
            if len(rows) == 2000:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return texts_of(docs).mapInPandas(run, f"doc_id long, {schema}")


@query("op4_token_frames")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from rowflow.llm import frames

    manifest = frames.write(table(spark, folder, "documents"), byte_level(tokenizer("byte_bpe_50k.json"), 2), frames.folder(spark))
    return frames.map_documents(manifest, lambda ids: (zlib.crc32(ids.tobytes()),), "ids_crc32 long")


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens and score of the best unigram path over the pieces of the public file."""
    path = tokenizer("piece_bpe_32k.model")

    def count(texts):
        from rowflow.llm.viterbi import counter

        return counter(path).counts(texts)

    return per_text(table(spark, folder, "documents"), count, "n_tokens long, score double")


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from rowflow.llm.packing import pack

    return pack(table(spark, folder, "documents"), byte_level(tokenizer("byte_bpe_50k.json"), 1))


@query("op9_piece_codec")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Also spans_sha256: of the start and end byte of every id's span in the original text."""
    path = tokenizer("piece_bpe_32k.model")

    def digest(texts):
        from rowflow.llm.pieces import encoded

        for text, ids, spans, back in encoded(texts, path):
            data = ids.astype("<u4").tobytes()
            yield len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest()

    return per_text(table(spark, folder, "documents"), digest, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


@query("op1_html_text")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from rowflow.llm.html import main_text

        for part in parts:
            yield pd.Series([main_text(x) for x in part.tolist()], dtype=object)

    pages = table(spark, folder, "pages").select("page_id", "url", extract(F.coalesce("html", F.lit(""))).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade and toxic of every document."""
    from rowflow.llm import toxicity

    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.with_scores(docs.select("doc_id", "text"), model).drop("text")


@query("op6_forest_neighbours")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from rowflow.llm import forest

    vectors = table(spark, folder, "embeddings")
    return forest.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query(
    "op10_block_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from rowflow.llm import blocks

    vectors = table(spark, folder, "embeddings")
    return blocks.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


@query("op3_bagminhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and class_id of every document."""
    from rowflow.llm.bagminhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op2_personal_data")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from rowflow.llm.pii import personal_data

    return personal_data(table(spark, folder, "documents"))


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Whole numbers below 2**53 are exact as doubles, so distances and quotients are too."""
    parts = [
        """
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = 64
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"""
        c0 AS MATERIALIZED (
            SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), e) - 1 AS k, e FROM v) WHERE k < {k}
        )""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""
        a{r} AS MATERIALIZED (
            SELECT v.rid, min({{'d': list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e), 'k': c.k}}) AS best
            FROM v CROSS JOIN c{r} c GROUP BY v.rid
        )""")
        if r < rounds:
            parts.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (
                SELECT k, list(floor(s / n) ORDER BY i) AS e FROM (
                    SELECT k, i, sum(x) AS s, count(*) AS n FROM (
                        SELECT a.best.k AS k, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS i FROM v JOIN a{r} a USING (rid)
                    ) GROUP BY k, i
                ) GROUP BY k
            ) m ON m.k = c.k
        )""")
    return f"""
        WITH {",".join(parts)}
        SELECT v.vec_id, CAST(a.best.k AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
               CAST(sum(a.best.d) OVER (PARTITION BY a.best.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(c.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM v JOIN a{rounds} a USING (rid) JOIN c{rounds} c ON c.k = a.best.k
    """


@query("op12_subvector_clusters", _clusters_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from rowflow.llm import clusters

    return clusters.cluster(table(spark, folder, "embeddings"))


def byte_level_and_pieces(one: str, two: str):
    """Encoders of texts with a leading space by a byte-level file and by a piece model that adds
    that space itself, and the bytes of their ids."""

    def encode_one(texts):
        from rowflow.llm.bytelevel import ids_of_texts

        return ids_of_texts(texts, one)

    def encode_two(texts):
        from rowflow.llm.pieces import ids_of_texts

        return (ids[1:-1] for ids in ids_of_texts((x[1:] for x in texts), two))

    def vocabularies():
        from rowflow.llm import alignment

        return alignment.byte_level_vocabulary(one), alignment.piece_vocabulary(two)

    return encode_one, encode_two, vocabularies


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from rowflow.llm import alignment

    sides = byte_level_and_pieces(tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    return alignment.align(table(spark, folder, "documents"), *sides)


@query("op13_repeated_bytes")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from rowflow.llm import repeats

    return repeats.remove_repeats(table(spark, folder, "documents"))
