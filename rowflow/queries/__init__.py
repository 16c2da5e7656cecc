"""Importing this package fills the registry."""

from rowflow.queries import (  # noqa: F401
    relational,
    expressions,
    rowsets,
    storage,
    parameters,
    corpus,
    lineage,
    workflow,
    catalog,
)
from rowflow.queries.registry import ORACLES, QUERIES  # noqa: F401
