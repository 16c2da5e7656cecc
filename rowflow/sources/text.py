"""EXTRACT: delimited text with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowflow.functions.scalar import script_type


def declared_schema(columns: str) -> T.StructType:
    """``"a:int?, b:string"`` -> schema; a column without a type is text."""
    fields = []
    for column in columns.split(","):
        name, _, kind = column.partition(":")
        kind = kind.strip() or "string"
        fields.append(T.StructField(name.strip(), script_type(kind), True))
    return T.StructType(fields)


def extract(
    spark: SparkSession, path: str | list[str], columns: str, sep: str = "\t", silent: bool = False
) -> DataFrame:
    """Read delimited text. ``silent`` drops lines that do not fit the schema; otherwise such a
    line fails the job. Whole lines are parsed, so that neither depends on which columns the
    query uses (a pruned CSV scan would check only those)."""
    schema = declared_schema(columns)
    checked = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    parsed = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in checked), options)
    lines = spark.read.text(path).select(parsed.alias("row"))
    fits = F.col("row.__bad").isNull()
    if not silent:
        fits = F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("a line does not fit: "), "row.__bad")).cast("boolean"))
    return lines.filter(fits).select(*[f"row.{f.name}" for f in schema])
