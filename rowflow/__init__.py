"""rowflow: rowset operators and dataset-lineage jobs as plain Spark DataFrame code."""

__version__ = "0.1.0"
