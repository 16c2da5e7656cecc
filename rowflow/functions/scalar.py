"""Scalar expressions of the script language as Column functions (all run inside codegen)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

# Declared type name -> Spark type. Unsigned types widen; decimal takes one scale.
SCRIPT_TYPES = {
    "string": T.StringType(),
    "String": T.StringType(),
    "bool": T.BooleanType(),
    "sbyte": T.ByteType(),
    "byte": T.ShortType(),
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "uint": T.LongType(),
    "long": T.LongType(),
    "ulong": T.DecimalType(20, 0),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "decimal": T.DecimalType(28, 8),
    "DateTime": T.TimestampNTZType(),
}

# Literal suffix -> declared type.
LITERAL_SUFFIXES = {"": "int", "L": "long", "UL": "ulong", "M": "decimal", "F": "float"}


def script_type(name: str) -> T.DataType:
    """Spark type of a declared type; a trailing ``?`` only says that nulls are allowed."""
    return SCRIPT_TYPES[name.strip().removesuffix("?")]


def literal(value, suffix: str = "") -> Column:
    """A typed literal: ``literal(0, "UL")``."""
    return F.lit(value).cast(script_type(LITERAL_SUFFIXES[suffix]))


def convert(col: Column, type_name: str) -> Column:
    """``(type)x`` fails on bad input, ``(type?)x`` gives null instead."""
    target = script_type(type_name)
    if type_name.strip().endswith("?"):
        return col.try_cast(target)
    return col.cast(target)


def convert_half_even(col: Column, type_name: str = "uint") -> Column:
    """Numeric conversion that rounds half to even, as the language's Convert calls do."""
    return F.bround(col, 0).cast(script_type(type_name))


def iff(test: Column, then, otherwise) -> Column:
    """``IF(p, a, b)`` and ``p ? a : b``; an unknown test takes the second branch."""
    return F.when(test, then).otherwise(otherwise)


def or_default(col: Column, default) -> Column:
    """``a ?? b``."""
    return F.coalesce(col, default if isinstance(default, Column) else F.lit(default))


def all_of(*tests: Column) -> Column:
    """``ALL(p1, p2, ...)``."""
    return reduce(lambda a, b: a & b, tests)


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def int_div(a: Column, b: Column) -> Column:
    """Division of whole numbers, truncated toward zero."""
    return F.call_function("div", a, b)


def is_null_or_empty(col: Column) -> Column:
    return col.isNull() | (col == "")


def concat_text(*cols) -> Column:
    """``a + "_" + b`` on strings: null counts as the empty string."""
    parts = [c if isinstance(c, Column) else F.lit(c) for c in cols]
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def round_half_even(col: Column, digits: int = 0) -> Column:
    return F.bround(col, digits)


def lookup(table: Column, key: Column, default) -> Column:
    """``D.ContainsKey(k) ? D[k] : default``."""
    return or_default(F.try_element_at(table, key), default)


def item(values: Column, index: int) -> Column:
    """``(xs)[i]``; null when the list is shorter."""
    return F.get(values, F.lit(index))


def first_where(values: Column, test) -> Column:
    """``xs.Where(f).FirstOrDefault()``."""
    return F.get(F.filter(values, test), F.lit(0))


def sum_of(values: Column, value=lambda v: v) -> Column:
    """``xs.Sum(f)`` in double precision, in list order."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + value(v).cast("double"))


def bucket_id(key: Column, buckets: int) -> Column:
    """A bucket that depends on the key only, so a recomputed task gives the same rows."""
    return F.pmod(key, F.lit(buckets))
