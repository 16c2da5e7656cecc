"""Closest name by edit distance, exact at any size.

A small catalog is compared as an array inside the row of each key. Beyond that the distance is
raised step by step, and keys that found a name leave:

* Within one or two edits names are found by equality: two strings within d edits have a common
  string left when at most d characters are deleted from each.
* Within d edits a name cut into d + 1 pieces has a piece that stands unchanged in the key, moved
  by no more than the edits on both sides of it allow. Keys look up the pieces at those places,
  for each length a name may have, and are compared with the names behind the pieces they hit.

The names behind a piece lie in arrays of a bounded size, one row per (key, array) that shares a
piece; no pair of names becomes a row, and names without a common piece never meet.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from rowflow.session import cut_lineage

CHUNK = 2000
MAX_LENGTHS = 1000


def _best(names: Column, key: Column) -> Column:
    """Smallest (distance, name) of an array."""
    return F.array_min(
        F.transform(names, lambda n: F.struct(F.levenshtein(n, key).alias("distance"), n.alias("name")))
    )


def _by_array(keys: DataFrame, names: DataFrame) -> DataFrame:
    """All names in one array, which each key looks up by its number; the caller has counted them."""
    zero = F.pmod(F.xxhash64("name"), F.lit(1))
    packed = F.broadcast(names.groupBy(zero.alias("__array")).agg(F.collect_list("name").alias("__names")))
    each = keys.withColumn("__array", F.explode(F.array(F.lit(0).cast("long"))))
    best = each.join(packed, "__array").select("key", _best(F.col("__names"), F.col("key")).alias("b"))
    return best.filter("b IS NOT NULL").select("key", "b.distance", "b.name")


def _pieces_of_name(name: Column, edits: int) -> Column:
    """(length, number, piece) of a name's edits + 1 pieces; of a shorter name one empty piece."""
    length, parts = F.length(name), edits + 1
    base, short = F.floor(length / parts).cast("int"), F.lit(parts) - F.pmod(length, F.lit(parts))

    def piece(i: Column) -> Column:
        text = F.substring(name, _piece_start(i, base, short) + 1, base + (i >= short).cast("int"))
        return F.struct(length.alias("length"), i.alias("number"), text.alias("piece"))

    whole = F.array(F.struct(length.alias("length"), F.lit(0).alias("number"), F.lit("").alias("piece")))
    return F.when(length < parts, whole).otherwise(F.transform(F.sequence(F.lit(0), F.lit(edits)), piece))


def _piece_start(i: Column, base: Column, short: Column) -> Column:
    """The first ``short`` pieces have ``base`` characters, the others one more."""
    return i * base + F.greatest(i - short, F.lit(0))


def _pieces_of_key(key: Column, edits: int) -> Column:
    """(length, number, piece) that names within ``edits`` may share with the key. A piece moved by
    s, in a name shorter by g, needs |s| edits before it and |g - s| behind it."""
    size, parts = F.length(key), edits + 1

    def of_length(length: Column) -> Column:
        base, short = F.floor(length / parts).cast("int"), F.lit(parts) - F.pmod(length, F.lit(parts))
        gap = size - length

        def of_number(i: Column) -> Column:
            start, wide = _piece_start(i, base, short), base + (i >= short).cast("int")
            moves = F.filter(
                F.sequence(F.lit(-edits), F.lit(edits)),
                lambda s: (F.abs(s) + F.abs(gap - s) <= edits) & (start + s >= 0) & (start + s + wide <= size),
            )
            return F.transform(moves, lambda s: F.struct(length.alias("length"), i.alias("number"), F.substring(key, start + s + 1, wide).alias("piece")))

        empty = F.array(F.struct(length.alias("length"), F.lit(0).alias("number"), F.lit("").alias("piece")))
        return F.when(length < parts, empty).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(edits)), of_number)))

    lengths = F.sequence(F.greatest(size - edits, F.lit(0)), size + edits)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def _by_pieces(keys: DataFrame, names: DataFrame, edits: int, arrays: int) -> DataFrame:
    """The nearest name within ``edits`` of the keys that have one."""
    place = ["length", "number", "piece"]
    index = names.select("name", F.explode(_pieces_of_name(F.col("name"), edits)).alias("p")).select("name", "p.*")
    salt = F.pmod(F.xxhash64("name"), F.lit(arrays)).alias("__salt")  # a piece that many names share lies in several arrays
    index = index.groupBy(*place, salt).agg(F.collect_list("name").alias("__names"))
    asked = keys.select("key", F.explode(_pieces_of_key(F.col("key"), edits)).alias("p")).select("key", "p.*")
    near = F.filter(
        F.transform("__names", lambda n: F.struct(F.levenshtein(n, F.col("key"), edits).alias("distance"), n.alias("name"))),
        lambda x: x["distance"] >= 0,
    )
    found = asked.join(index, place).select("key", F.array_min(near).alias("b")).filter("b IS NOT NULL")
    return found.groupBy("key").agg(F.min("b").alias("b")).select("key", "b.distance", "b.name")


def _deletions(text: Column, edits: int) -> Column:
    """Hashes of all strings left after deleting at most ``edits`` characters."""
    found = F.array(text)
    for _ in range(edits):
        shorter = F.flatten(
            F.transform(
                found,
                lambda t: F.when(
                    F.length(t) > 0,
                    F.transform(
                        F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
                        lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))),
                    ),
                ).otherwise(F.array().cast("array<string>")),
            )
        )
        found = F.array_distinct(F.concat(found, shorter))
    return F.transform(found, lambda t: F.xxhash64(t))


def _within(keys: DataFrame, names: DataFrame, edits: int) -> DataFrame:
    left = keys.select("key", F.explode(_deletions(F.col("key"), edits)).alias("__h"))
    right = names.select("name", F.explode(_deletions(F.col("name"), edits)).alias("__h"))
    near = left.join(right, "__h").select("key", "name").distinct()
    distance = F.levenshtein("key", "name")
    return (
        near.filter(distance <= edits)
        .groupBy("key")
        .agg(F.min(F.struct(distance.alias("distance"), F.col("name"))).alias("b"))
        .select("key", "b.distance", "b.name")
    )


def nearest(keys: DataFrame, names: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``keys(key)``, ``names(name)`` -> ``(key, distance, name)``; ties go to the smallest name. Null
    keys and names take no part."""
    keys, names = keys.dropna().distinct(), names.dropna().distinct()
    size, longest = names.agg(F.count(F.lit(1)), F.max(F.length("name"))).first()
    if size <= chunk:
        return _by_array(keys, names)
    keys, names = cut_lineage(keys), cut_lineage(names)
    done, edits, arrays = [], 1, ceil(size / chunk)
    longest = max(longest, keys.agg(F.max(F.length("key"))).first()[0] or 0)
    while not keys.isEmpty():
        hit = _within(keys, names, edits) if edits <= 2 else _by_pieces(keys, names, edits, arrays)
        done.append(cut_lineage(hit))
        keys = cut_lineage(keys.join(done[-1], "key", "left_anti"))
        if edits >= longest:
            break
        edits = edits + 1 if edits < 4 else min(2 * edits, longest)
    return reduce(DataFrame.unionAll, done) if done else keys.select("key", F.lit(0).alias("distance"), F.col("key").alias("name"))


def containing(cores: DataFrame, texts: DataFrame) -> DataFrame:
    """``cores(core)``, ``texts(text, value)`` -> ``(core, value)`` of the smallest text that has
    ``core`` in it. The texts are cut into pieces of the lengths that occur among the cores,
    which makes the search an equi-join."""
    lengths = cores.select(F.length("core").alias("n")).distinct().filter(F.col("n") > 0)
    known = [r[0] for r in lengths.limit(MAX_LENGTHS + 1).collect()]
    if not known:
        return cores.limit(0).select("core", F.lit(None).cast("string").alias("value"))
    # Beyond the bound every length is cut, which finds the same with more pieces.
    few = F.array(*[F.lit(n) for n in sorted(known)]) if len(known) <= MAX_LENGTHS else None
    wanted = F.sequence(F.lit(1), F.length("text")) if few is None else F.filter(few, lambda n: n <= F.length("text"))
    texts = texts.filter(F.length("text") > 0)
    pieces = F.flatten(
        F.transform(
            wanted,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, n)
            ),
        )
    )
    cut = texts.select("text", "value", F.explode(F.array_distinct(pieces)).alias("core"))
    return cut.join(cores.distinct(), "core").groupBy("core").agg(F.min_by("value", "text").alias("value"))


def closest_process(keys: DataFrame, processes: DataFrame, scripts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``keys(key)`` -> ``(key, process, stage)``: the process of that name (exact), the process of
    the script of that name (script), of a script whose name contains the stem (stem), or the
    process with the least edit distance below twice the key's length (nearest); else the key
    itself (none). ``processes(process)``, ``scripts(script, process)``."""
    distinct = keys.select("key").distinct()
    names = processes.select(F.col("process").alias("name")).distinct()
    by_script = scripts.groupBy(F.col("script").alias("key")).agg(F.min("process").alias("__script"))
    named = names.select(F.col("name").alias("key"), F.col("name").alias("__exact"))
    first = cut_lineage(distinct.join(named, "key", "left").join(by_script, "key", "left"))
    stem = F.regexp_replace("key", r"(?<=.)\.[^./]*$", "")
    open_ = first.filter(F.col("__exact").isNull() & F.col("__script").isNull()).select("key", stem.alias("core"))
    found = containing(open_.select("core"), scripts.select(F.col("script").alias("text"), F.col("process").alias("value")))
    stems = open_.join(found, "core", "left").select("key", F.col("value").alias("__stem"))
    stems = cut_lineage(stems)
    near = nearest(stems.filter(F.col("__stem").isNull()).select("key"), names, chunk)
    near = near.filter(F.col("distance") < F.length("key") * 2).select("key", F.col("name").alias("__near"))
    full = first.join(stems, "key", "left").join(near, "key", "left")
    stage = (
        F.when(F.col("__exact").isNotNull(), "exact")
        .when(F.col("__script").isNotNull(), "script")
        .when(F.col("__stem").isNotNull(), "stem")
        .when(F.col("__near").isNotNull(), "nearest")
        .otherwise("none")
    )
    return full.select(
        "key", F.coalesce("__exact", "__script", "__stem", "__near", "key").alias("process"), stage.alias("stage")
    )
