"""Registered queries on tables with nulls, repeated rows, clashing columns, and on empty ones."""

import hashlib
import zlib

import numpy as np
import pytest

from rowflow.llm import blocks
from rowflow.llm.queries import QUERIES

ROWS = [(1, "plain words"), (1, "plain words"), (2, None), (None, ""), (3, "x" * 5000), (4, "late, é 世")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "none"))
    schema = "doc_id long, text string, n_tokens string, start int, rank int, chunk string"
    docs = spark.createDataFrame([(i, t, "n", 7, 7, "c") for i, t in ROWS], schema)
    docs.coalesce(1).write.parquet(f"{full}/documents.parquet")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    return full, empty


def ids_digest(ids, kind):
    data = np.array(ids, dtype="<u4").tobytes()
    return zlib.crc32(data) if kind == "crc" else hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", ["op4_token_frames", "op5_token_counts", "op7_packing", "op9_piece_codec", "op11_token_alignment", "op13_repeated_bytes", "op2_personal_data"])
def test_odd_documents(spark, folders, name):
    got = [r.asDict() for r in QUERIES[name](spark, folders[0]).collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ROWS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    if name == "op4_token_frames":
        assert by[2][0]["n_tokens"] == by[None][0]["n_tokens"] == 1 and by[2][0]["ids_crc32"] == ids_digest([2], "crc")
        spans = sorted((r["start"], r["n_tokens"]) for r in got)
        assert [a for a, _ in spans] == np.concatenate([[0], np.cumsum([n for _, n in spans])[:-1]]).tolist()
    if name == "op5_token_counts":
        assert by[2][0]["n_tokens"] == by[None][0]["n_tokens"] == 0
    if name == "op7_packing":
        assert by[2][0]["length"] == by[2][0]["doc_tokens"] == 1 and by[2][0]["ids_crc32"] == ids_digest([1], "crc")
    if name == "op9_piece_codec":
        assert by[2][0]["n_tokens"] == 2 and by[2][0]["ids_sha256"] == ids_digest([1, 2], "sha") and by[2][0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    if name == "op13_repeated_bytes":  # of 5000 equal bytes the first window stays
        assert by[3][0]["n_removed"] == 4999 and by[1][0]["n_removed"] == 0
    same = [{k: v for k, v in r.items() if k not in ("start", "sequence_id", "offset")} for r in by[1]]
    assert same[0] == same[1]
    assert QUERIES[name](spark, folders[1]).count() == 0


def test_block_search_with_repeated_and_ragged_rows(spark):
    """Repeated rows are candidates of their own; shorter vectors are filled up with zeros."""
    rows = [(0, [1.0, 2.0, 3.0]), (1, [3.0, 2.0]), (1, [3.0, 2.0]), (2, [0.5, 0.5, -1.0]), (3, None), (4, [None, 1.0, 1.0]), (None, [1.0] * 3), (5, [float("nan")] * 3)]
    table = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, score int")
    whole = {0: [(1, [3072, 2048, 0]), (1, [3072, 2048, 0]), (2, [512, 512, -1024])]}
    query = [1024, 2048, 3072]
    want = sorted(((-sum(a * b for a, b in zip(query, e)), i) for i, e in whole[0]))
    got = sorted((r["rank"], r.vec_id, r.score) for r in blocks.search(table, table.where("vec_id = 0"), 10).collect())
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_block_search_beyond_doubles(spark):
    """Scores of more than 53 bits are whole numbers all the same."""
    rows = [(0, [float(1 << 20), 3.0]), (1, [float(1 << 20) + 1, 1.0]), (2, [float(1 << 20) + 1, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in blocks.search(table, table.where("vec_id = 0"), 2).collect()}
    assert got == {i: sum((1024 * int(a)) * (1024 * int(b)) for a, b in zip(rows[0][1], e)) for i, e in rows[1:]}
