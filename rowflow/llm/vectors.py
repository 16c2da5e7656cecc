"""Vector tables for the searches: which rows take part, and matrices of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """vec_id and values (array<double>) of the rows that take part: those with a vec_id and a
    vector without null or non-finite components (and not of zeros only, unless ``zero``)."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("values").isNotNull() & ~bad)
    return rows if zero else rows.where(F.exists("values", lambda x: x != 0))


def matrix(lists, width: int) -> np.ndarray:
    """Rows of equal width; components that a shorter vector lacks are 0."""
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def kept_best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every query: highest score, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    groups = query[order]
    first = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, dtype=bool)
    rank = np.arange(len(groups)) - np.maximum.accumulate(np.where(first, np.arange(len(groups)), 0))
    return order[rank < k]
