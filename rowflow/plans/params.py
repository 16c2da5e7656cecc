"""Parameters over tables: substitution, reference chains, job parameters, precedence."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rowflow.functions.dates import format_date
from rowflow.operators.ordered import by_position, max_before, scan
from rowflow.session import cut_lineage, partitioned

EXTERNAL = r"@@.*?@@"
MASTER = r"\$\(.*?\)"
REFERENCE = r"@@\w+@@|@\w+"

# Fixed value: how often a value is searched for further references.
REFERENCE_PASSES = 5

#: A script of at most so many lines is one row while its names are resolved.
ROW_LINES = 500


def external_key(token: Column) -> Column:
    return F.regexp_replace(token, "@@", "")


def master_key(token: Column) -> Column:
    return F.regexp_replace(token, r"^\$\(|\)$", "")


def last_values(params: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of ``params``: of repeated ones the value with the largest ``pos``, or
    the largest value where there is no ``pos``. Null values don't count."""
    known = params.filter(F.col("value").isNotNull())
    last = F.max_by("value", "pos") if "pos" in params.columns else F.max("value")
    return known.groupBy(*keys).agg(last.alias("value"))


def substitute(
    df: DataFrame,
    ids: list[str],
    text: str,
    pattern: str,
    key_of: Callable[[Column], Column],
    params: DataFrame,
    scope: list[str],
) -> DataFrame:
    """Replace each token of ``text`` by its value in ``params(*scope, key, value)``; tokens
    without a value stay, of repeated keys the last one counts. One pass: values are not
    searched again. ``ids`` identify a row.

    The tokens of all texts are looked up by one join; only the hits of one text, which its
    own length bounds, are gathered.
    """
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    keys = list(dict.fromkeys([*ids, *scope]))
    used = df.select(*keys, F.explode(tokens).alias("__token")).withColumn("key", key_of(F.col("__token")))
    found = used.join(last_values(params, [*scope, "key"]), [*scope, "key"])
    hits = found.groupBy(*ids).agg(
        F.map_from_entries(F.collect_list(F.struct("__token", "value"))).alias("__hits")
    )
    return df.join(hits, ids, "left").withColumn(text, _put_values(text, pattern)).select(*df.columns)


def _put_values(text: str, pattern: str) -> Column:
    """``text`` with the tokens of ``__hits`` replaced, in one pass over its pieces."""
    done = put_tokens(F.col(text), F.col("__hits"), pattern)
    return F.when(F.col("__hits").isNull(), F.col(text)).otherwise(done)


def put_tokens(text: Column, hits: Column, pattern: str) -> Column:
    """``text`` with the tokens that are keys of the map ``hits`` replaced by their values."""
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"),
    )

    def put(z: Column) -> Column:
        value = F.coalesce(F.try_element_at(hits, z["token"]), z["token"], F.lit(""))
        return F.concat(z["piece"], value)

    return F.array_join(F.transform(pieces, put), "")


def resolve_external(scripts: DataFrame, params: DataFrame) -> DataFrame:
    """``@@name@@`` in ``scripts(script, text)`` from ``params(key, value)``, or from
    ``params(script, key, value)`` when each script has its own."""
    scope = ["script"] if "script" in params.columns else []
    return substitute(scripts, ["script"], "text", EXTERNAL, external_key, params, scope)


def resolve_master(job: DataFrame, masters: DataFrame) -> DataFrame:
    """``$(name)`` in ``job(process, key, master, value)`` from ``masters(master, key, value)``;
    escaped quotes become quotes."""
    renamed = job.withColumnRenamed("key", "param").withColumnRenamed("value", "text")
    done = substitute(renamed, ["process", "param"], "text", MASTER, master_key, masters, ["master"])
    plain = F.replace("text", F.lit('\\"'), F.lit('"'))
    return done.select("process", F.col("param").alias("key"), "master", plain.alias("value"))


def resolve_references(params: DataFrame, passes: int = REFERENCE_PASSES, row_lines: int = ROW_LINES) -> DataFrame:
    """``@name`` inside the values of ``params(script, key, value)``, by the values of the same
    script; one row per key, a repeated one with its last value (by ``pos`` if there is one).
    A bounded number of passes, so a value that names itself cannot run on. With ``pos`` a name
    means its latest earlier line, see :func:`resolve_definitions`; only names without one are
    then looked up among the last values.

    A script of at most ``row_lines`` keys is one row, whose values search each other in place.
    Longer ones go through a join per pass, which goes on with the values it changed.
    """
    if "pos" in params.columns:
        known = F.when(F.col("value").isNotNull(), F.col("pos"))
        params = resolve_definitions(params, row_lines).groupBy("script", "key").agg(F.max_by("value", known).alias("value"))
    else:
        params = params.groupBy("script", "key").agg(F.max("value").alias("value"))
    params, short, long = short_and_long(params, row_lines)
    found = short(F.struct("key", "value"))
    defs = F.map_from_entries(F.transform(F.filter("lines", lambda x: x["value"].isNotNull()), lambda x: F.struct(F.concat(F.lit("@"), x["key"]), x["value"])))

    def followed(hits: Column, text: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), text, lambda t, _: F.when(t.contains("@"), put_tokens(t, hits, REFERENCE)).otherwise(t))

    lines = found.withColumn("__defs", defs).select("script", "__defs", F.explode("lines").alias("line"))
    done = lines.select("script", "line.key", followed(F.col("__defs"), F.col("line.value")).alias("value"))
    return done if long is None else done.unionAll(_references_by_join(long, passes))


def short_and_long(params: DataFrame, row_lines: int):
    """``params``, a function that gathers the scripts of at most ``row_lines`` lines into one row
    each (script, lines), and the lines of longer scripts (None if there are none)."""
    params = cut_lineage(params)
    count = params.groupBy("script").agg(F.count(F.lit(1)).alias("__n"))
    many = cut_lineage(count.filter(F.col("__n") > row_lines).select("script"))
    some, lines = not many.isEmpty(), params.count()
    rest = params.join(many, "script", "left_anti") if some else params

    def short(line: Column) -> DataFrame:
        # A stated number of partitions, which is not merged by size: little text, much work.
        return partitioned(rest, "script", rows=lines).groupBy("script").agg(F.collect_list(line).alias("lines"))

    return params, short, params.join(many, "script", "left_semi") if some else None


def _references_by_join(params: DataFrame, passes: int) -> DataFrame:
    """Each pass is checkpointed and goes on with the values it changed; the others are final."""
    last = cut_lineage(params.filter(F.col("value").isNotNull()))
    defs = last.select("script", F.concat(F.lit("@"), "key").alias("__token"), F.col("value").alias("__value"))
    open_ = last.withColumnRenamed("value", "text").filter(F.col("text").contains("@"))
    final = params.withColumnRenamed("value", "text").filter(F.col("text").isNull() | ~F.col("text").contains("@"))
    for _ in range(passes):
        tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0)))
        used = open_.select("*", F.explode_outer(tokens).alias("__token"))
        hit = F.when(F.col("__value").isNotNull(), F.struct("__token", "__value"))
        done = cut_lineage(
            used.join(defs, ["script", "__token"], "left")
            .groupBy("script", "key")
            .agg(F.min("text").alias("text"), F.map_from_entries(F.collect_list(hit)).alias("__hits"))
            .select(
                "script", "key", _put_values("text", REFERENCE).alias("text"), (F.size("__hits") > 0).alias("changed")
            )
        )
        final = final.unionAll(done.filter(~F.col("changed")).drop("changed"))
        open_ = done.filter("changed").drop("changed")
        if open_.isEmpty():
            break
    return final.unionAll(open_).select("script", "key", F.col("text").alias("value"))


def resolve_definitions(params: DataFrame, row_lines: int = ROW_LINES) -> DataFrame:
    """``params(script, key, value, pos)`` with every ``@name`` replaced by the resolved value of
    the latest earlier line of the script that gives ``name`` a value; ``pos`` identifies a line.
    Names without such a line stay. What is put in is not searched again."""

    def put(text: Column, names: Column) -> Column:
        by_token = F.transform_keys(names, lambda k, _: F.concat(F.lit("@"), k))
        return put_tokens(text, by_token, REFERENCE)

    return in_order(params, put, "string", row_lines).select("script", "key", "pos", "value")


def in_order(params: DataFrame, evaluate: Callable[[Column, Column], Column], kind: str, row_lines: int = ROW_LINES) -> DataFrame:
    """The lines ``params(script, key, value, pos)`` with their ``value`` renamed ``text`` and, as
    ``value``, what ``evaluate(text, names)`` gives. ``names`` is a map from the names a line can
    see - of the script's earlier lines with a text the latest of each key - to their values.

    A script of at most ``row_lines`` lines is folded in its row. The lines of longer ones are
    bound to the lines they name, strictly backwards, so they cannot form a ring: each round
    closes the lines whose names are all closed, and is written once.
    """
    lines = params.select("script", "key", "pos", F.col("value").alias("text"))
    lines, short, long = short_and_long(lines, row_lines)
    ordered = short(F.struct("pos", "key", "text")).withColumn("lines", F.sort_array("lines"))
    of = lines.schema
    out = f"array<struct<key:{of['key'].dataType.simpleString()},pos:{of['pos'].dataType.simpleString()},text:string,value:{kind}>>"
    start = F.struct(F.create_map().cast(f"map<string,{kind}>").alias("names"), F.array().cast(out).alias("done"))

    def step(state: Column, line: Column) -> Column:
        once = F.array(F.struct(evaluate(line["text"], state["names"]).cast(kind).alias("v")))
        gives = line["text"].isNotNull() & line["key"].isNotNull()

        def put(z: Column) -> Column:
            others = F.when(F.map_contains_key(state["names"], line["key"]), F.map_filter(state["names"], lambda k, _: k != line["key"])).otherwise(state["names"])
            names = F.when(gives, F.map_concat(others, F.map_from_arrays(F.array(line["key"]), F.array(z["v"])))).otherwise(state["names"])
            row = F.struct(line["key"].alias("key"), line["pos"].alias("pos"), line["text"].alias("text"), z["v"].alias("value"))
            return F.struct(names.alias("names"), F.concat(state["done"], F.array(row)).alias("done"))

        return F.get(F.transform(once, put), F.lit(0))

    folded = ordered.select("script", F.explode(F.aggregate("lines", start, step, lambda s: s["done"])).alias("line"))
    folded = folded.select("script", "line.key", "line.pos", "line.text", "line.value")
    return folded if long is None else folded.unionByName(_in_rounds(long, evaluate, kind))


def _in_rounds(lines: DataFrame, evaluate: Callable[[Column, Column], Column], kind: str) -> DataFrame:
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0)))
    used = lines.select("script", "pos", F.explode(tokens).alias("__token")).filter(~F.col("__token").startswith("@@"))
    used = used.select("script", "pos", F.substring("__token", 2, 1 << 30).alias("key"), F.lit(0).alias("__given"))
    given = lines.filter(F.col("text").isNotNull())
    given = given.select("script", "pos", "key", F.lit(1).alias("__given"), F.col("pos").alias("__at"))
    bound = scan(
        used.unionByName(given, allowMissingColumns=True),
        ["script", "key"],
        ["pos", "__given"],
        by_position(),
        {"__line": max_before(F.col("__at"))},
    )
    links = bound.filter((F.col("__given") == 0) & F.col("__line").isNotNull()).select("script", "pos", F.col("key").alias("__name"), "__line")
    links = cut_lineage(links)
    waits = links.select("script", "pos").distinct()
    none = F.create_map().cast(f"map<string,{kind}>")
    closed = cut_lineage(lines.join(waits, ["script", "pos"], "left_anti").withColumn("value", evaluate(F.col("text"), none).cast(kind)))
    open_ = cut_lineage(lines.join(waits, ["script", "pos"], "left_semi"))
    while not open_.isEmpty():
        values = closed.select("script", F.col("pos").alias("__line"), F.col("value").alias("__value"), F.lit(1).alias("__closed"))
        hits = (
            links.join(open_.select("script", "pos"), ["script", "pos"], "left_semi")
            .join(values, ["script", "__line"], "left")
            .groupBy("script", "pos")
            .agg(F.map_from_entries(F.collect_list(F.struct("__name", "__value"))).alias("__hits"), F.count_if(F.col("__closed").isNull()).alias("__left"))
        )
        tried = cut_lineage(open_.join(hits, ["script", "pos"]))
        done = tried.filter("__left = 0").withColumn("value", evaluate(F.col("text"), F.col("__hits")).cast(kind))
        closed = cut_lineage(closed.unionByName(done.select(closed.columns)))
        open_ = tried.filter("__left > 0").select(lines.columns)
    return closed.select("script", "key", "pos", "text", "value")


def job_params(jobs: DataFrame) -> DataFrame:
    """``jobs(process, items array<string>)`` -> ``(process, key, value)`` of the items with
    ``-params k=v,k2=v2``; the last value of a key wins."""
    item = jobs.select("process", F.posexplode("items").alias("__i", "__item"))
    item = item.filter(F.col("__item").contains("-params"))
    words = F.split(F.trim("__item"), r"\s+")
    pairs = item.select("process", "__i", F.posexplode(F.split(F.get(words, F.lit(1)), ",")).alias("__j", "__kv"))
    pairs = pairs.filter(F.col("__kv").contains("="))
    key = F.substring_index("__kv", "=", 1)
    value = F.trim(F.expr("substr(__kv, instr(__kv, '=') + 1)"))
    return pairs.groupBy("process", key.alias("key")).agg(
        F.max_by(value, F.struct("__i", "__j")).alias("value")
    )


def eval_string(value: Column, call: Column) -> Column:
    """``Replace("a", "b")``, ``Trim('c')``, ``TrimEnd('c')`` given as text in ``call``. A trim takes
    the set of characters listed."""
    old = F.regexp_extract(call, r'^Replace\("(.*?)"\s*,\s*"(.*)"\s*\)', 1)
    new = F.regexp_extract(call, r'^Replace\("(.*?)"\s*,\s*"(.*)"\s*\)', 2)
    chars = F.regexp_replace(F.regexp_extract(call, r"^Trim(?:End)?\((.*)\)", 1), "[', ]", "")
    return (
        F.when(call.startswith("Replace("), F.replace(value, old, new))
        .when(call.startswith("TrimEnd("), F.rtrim(value, chars))
        .when(call.startswith("Trim("), F.btrim(value, chars))
        .otherwise(value)
    )


def eval_number(call: Column) -> Column:
    """``int.Parse("…")``, ``Int32.Parse``, ``Math.Abs(…)``."""
    number = F.regexp_extract(call, r'\(\s*"?\s*(-?\s*\d+)\s*"?\s*\)', 1)
    value = F.regexp_replace(number, " ", "").try_cast("long")
    return F.when(call.startswith("Math.Abs"), F.abs(value)).otherwise(value)


def merge_params(
    defaults: DataFrame, job: DataFrame, overrides: DataFrame, target: Column
) -> DataFrame:
    """Precedence default < job < override over ``(process, key, value)`` tables. A date pattern
    under a date, hour or time key without a default is rendered with ``target`` and quoted;
    with a default the pattern replaces it as it is."""
    layers = [defaults, job, overrides]
    stacked = [df.select("process", "key", "value", F.lit(i).alias("__p")) for i, df in enumerate(layers)]
    merged = (
        stacked[0].unionAll(stacked[1]).unionAll(stacked[2])
        .groupBy("process", "key")
        .agg(F.max_by("value", "__p").alias("value"), F.min("__p").alias("__first"))
    )
    dated = F.lower("key").rlike("date|hour|time") & F.col("value").rlike("yyyy|mm|dd")
    bare = F.regexp_replace("value", '[{}@"]', "")
    shown = F.concat(F.lit('"'), format_date(target, bare), F.lit('"'))
    value = F.when((F.col("__first") > 0) & dated, shown).otherwise(F.col("value"))
    return merged.select("process", "key", value.alias("value"))
