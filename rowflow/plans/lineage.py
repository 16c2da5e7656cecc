"""Lineage over statement tables: which version of a dataset each reference means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowflow.functions.dates import fill_path_tokens
from rowflow.operators.ordered import STATEMENTS, by_position, last_before, max_before, scan, scan_whole
from rowflow.plans.declares import resolve_declares
from rowflow.session import cut_lineage, partitioned

# Name of the rowset a script without any named rowset builds, node classes by
# name prefix with their colours, and the colours of outputs and of user operators.
IMPLICIT = "SCOPE_IMPLICIT"
NODE_COLOURS = {
    "SSTREAM": "greenyellow",
    "SSTREAM<STREAMSET>": "wheat",
    "EXTRACT": "honeydew",
    "MODULE": "sandybrown",
    "VIEW": "lightpink",
    "FUNC": "lightblue",
}
IMPLICIT_COLOUR, OUTPUT_COLOUR, USING_COLOUR = "gray", "tomato", "yellow"

EXTERNAL = -1


def bind_versions(
    lookups: DataFrame, defs: DataFrame, block: Column | None = None, hot_rows: int | None = None
) -> DataFrame:
    """The version of each looked-up name: the latest definition strictly before.

    ``lookups(script, name, pos, …)`` and ``defs(script, name, pos)`` are read in one ordered
    pass, lookups before the definition of their own statement: ``X = … FROM X`` reads the
    old X. Adds ``version`` (position of the definition, -1 when there is none). Positions grow
    along a script, so the latest definition is the largest one, a plain hash aggregate.
    """
    stream = lookups.withColumn("__k", F.lit(0)).unionByName(
        defs.select("script", "name", "pos", F.lit(1).alias("__k"), F.col("pos").alias("__def")),
        allowMissingColumns=True,
    )
    bound = scan(
        stream,
        ["script", "name"],
        ["pos", "__k"],
        block if block is not None else by_position(),
        {"version": max_before(F.col("__def"))},
        hot_rows,
    )
    version = F.coalesce("version", F.lit(EXTERNAL).cast(defs.schema["pos"].dataType))
    return bound.filter(F.col("__k") == 0).withColumn("version", version).drop("__k", "__def")


def previous_target(targets: DataFrame, block: Column | None = None, short: bool = False) -> DataFrame:
    """``targets(script, pos, target)``, one row per statement and a null target where none is
    named. Adds ``prev``: the latest target before the statement. ``short`` scripts are not cut."""
    prev = {"prev": last_before(F.col("target"))}
    if short:
        return scan_whole(targets, ["script"], ["pos"], prev)
    return scan(targets, ["script"], ["pos"], block if block is not None else by_position(), prev)


def rowset_facts(fact_rows: DataFrame) -> DataFrame:
    """Statements that build or write rowsets; imports are not followed."""
    return fact_rows.filter(
        (F.col("sources").isNotNull() & (F.col("kind") != "IMPORT")) | F.col("output").isNotNull()
    )


def with_targets(fact_rows: DataFrame, short: bool = False) -> DataFrame:
    """Adds ``target``, the (name, version) a statement assigns, and ``prev``, the latest target
    before it; until a rowset is named that is the implicit one."""
    target = F.when(
        F.col("assign_var").isNotNull(), F.struct(F.col("assign_var").alias("name"), F.col("pos").alias("version"))
    )
    implicit = F.struct(F.lit(IMPLICIT).alias("name"), F.lit(EXTERNAL).alias("version"))
    done = previous_target(fact_rows.withColumn("target", target), short=short)
    return done.withColumn("prev", F.coalesce("prev", implicit))


MENTION = "struct<role string, name string, other string>"


def _mention(role, name: Column | None = None, other: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    role = role if isinstance(role, Column) else F.lit(role)
    return F.struct(role.alias("role"), text(name).alias("name"), text(other).alias("other"))


def _mentions(source_type) -> Column:
    """Every name a statement mentions, with what is asked of it: ``read`` a source, its
    ``parent`` A when it is A.b, ``param`` of a module, ``output`` source, ``def`` of the target. A
    statement that names no source mentions the previous rowset, as a name that is null."""
    none = F.array().cast(f"array<{MENTION}>")
    sources = F.coalesce("sources", F.array().cast(source_type))
    modules = F.filter(sources, lambda s: s["source_type"] == "MODULE")
    dotted = F.filter(sources, lambda s: s["source"].contains("."))
    written = F.coalesce("output.sources", F.array().cast("array<string>"))
    path = F.col("output.path")
    implied = F.when(
        (F.size(sources) == 0) & (F.size(written) == 0),
        F.array(_mention(F.when(path.isNotNull(), "output").otherwise("read"), None, path)),
    ).otherwise(none)
    params = F.transform(
        modules, lambda m: F.transform("params", lambda p: _mention("param", p, m["source"]))
    )
    assigned = F.when(
        F.col("assign_var").isNotNull(), F.array(_mention("def", F.col("assign_var")))
    ).otherwise(none)
    return F.concat(
        F.transform(sources, lambda s: _mention("read", s["source"])),
        F.transform(dotted, lambda s: _mention("parent", F.substring_index(s["source"], ".", 1), s["source"])),
        F.flatten(params),
        F.transform(written, lambda w: _mention("output", w, path)),
        implied,
        assigned,
    )


def edges(fact_rows: DataFrame) -> DataFrame:
    """``(script, kind, src, src_version, dst, dst_version)`` with kind ``read``, ``parent`` (A to
    A.b), ``param`` (rowset to module) or ``output``. Outputs are nodes of version -1 named by
    their path.

    One ordered pass over (script) gives each statement its previous rowset, one over
    (script, name) answers all mentions; both in the same task for a script that has no position
    beyond a block, by blocks for a longer one. ``fact_rows`` is read several times: pass a
    table or a checkpoint of :func:`rowflow.plans.corpus.facts`.
    """
    rows = rowset_facts(fact_rows).select("script", "pos", "assign_var", "sources", "params", "output")
    count, last = rows.agg(F.count(F.lit(1)), F.max("pos")).first()
    dealt = lambda some: partitioned(some, "script", rows=count)
    if last is None or last < STATEMENTS:
        return _edges(dealt(rows), True)
    long = cut_lineage(rows.filter(F.col("pos") >= STATEMENTS).select("script").distinct())
    short = _edges(dealt(rows.join(long, "script", "left_anti")), True)
    return short.unionAll(_edges(rows.join(long, "script", "left_semi"), False))


def _edges(rows: DataFrame, short: bool) -> DataFrame:
    asked = _mentions(rows.schema["sources"].dataType)
    stream = (
        with_targets(rows, short)
        .select("script", "pos", "target", "prev", F.explode(asked).alias("m"))
        .select("script", "pos", "target", "prev", "m.*")
    )
    is_def, is_read = F.col("role") == "def", F.col("role") == "read"
    named = F.col("name").isNotNull()
    stream = stream.withColumn("__k", F.when(is_read, 0).when(is_def, 2).otherwise(1))
    found = {
        "version": max_before(F.when(is_def, F.col("pos"))),
        "seen": max_before(F.when((is_def | is_read) & named, F.col("pos"))),
    }
    by, order = ["script", "name"], ["pos", "__k"]
    bound = scan_whole(stream, by, order, found) if short else scan(stream, by, order, by_position(), found)
    # An output of a name nobody mentioned before writes the previous rowset; a dotted name or
    # a module parameter counts only when it was mentioned before.
    unseen = F.col("seen").isNull()
    to_prev = ~named | ((F.col("role") == "output") & unseen)
    inner = F.col("role").isin("parent", "param")
    to = F.coalesce("target", "prev")
    leaves = inner | (F.col("role") == "output")
    return (
        bound.filter(~is_def & ~(inner & unseen))
        .select(
            "script",
            F.col("role").alias("kind"),
            F.when(to_prev, F.col("prev.name")).otherwise(F.col("name")).alias("src"),
            F.when(to_prev, F.col("prev.version")).otherwise(F.coalesce("version", F.lit(EXTERNAL))).alias("src_version"),
            F.when(leaves, F.col("other")).otherwise(to["name"]).alias("dst"),
            F.when(leaves, F.lit(EXTERNAL)).otherwise(to["version"]).alias("dst_version"),
        )
        .distinct()
    )


def node_class(name: Column, is_output: Column, using: Column) -> Column:
    """Struct (type, fillcolor) of a node."""
    prefix = F.substring_index(name, "_", 1)
    colours = F.create_map(*[F.lit(v) for kv in NODE_COLOURS.items() for v in kv])
    by_prefix = F.when(name.contains("_"), F.try_element_at(colours, prefix))
    colour = (
        F.when(name == IMPLICIT, F.lit(IMPLICIT_COLOUR))
        .when(using.isNotNull(), F.lit(USING_COLOUR))
        .when(is_output, F.lit(OUTPUT_COLOUR))
        .otherwise(by_prefix)
    )
    type_ = F.when(is_output, F.lit("output")).when((name == IMPLICIT) | by_prefix.isNotNull(), F.lit("input"))
    return F.struct(type_.alias("type"), colour.alias("fillcolor"))


def nodes(edge_rows: DataFrame, fact_rows: DataFrame) -> DataFrame:
    """``(script, name, version, type, fillcolor, using)`` of all nodes of the edges."""
    is_out = F.col("kind") == "output"
    ends = edge_rows.select(
        "script",
        F.explode(
            F.array(
                F.struct(F.col("src").alias("name"), F.col("src_version").alias("version"), F.lit(False).alias("out")),
                F.struct(F.col("dst").alias("name"), F.col("dst_version").alias("version"), is_out.alias("out")),
            )
        ).alias("n"),
    ).select("script", "n.*")
    each = ends.groupBy("script", "name", "version").agg(F.max("out").alias("out"))
    users = fact_rows.filter(F.col("using").isNotNull() & F.col("assign_var").isNotNull()).select(
        "script", F.col("assign_var").alias("name"), F.col("pos").alias("version"), "using"
    )
    full = each.join(users, ["script", "name", "version"], "left")
    return full.select(
        "script", "name", "version", node_class(F.col("name"), F.col("out"), F.col("using")).alias("c"), "using"
    ).select("script", "name", "version", "c.type", "c.fillcolor", "using")


def qualify(view: Column, name: Column) -> Column:
    """Node names of a module file carry their view."""
    return F.concat(F.lit("<"), view, F.lit(">_"), name)


def link(value: Column, at: Column, prefix: str, suffix: str = "?property=info") -> Column:
    """Portal address of a dataset path. A path with a query loses it and has its date tokens
    filled; quotes and line ends are dropped."""
    bare = F.substring_index(value, "?", 1)
    filled = F.when(value.contains("?"), fill_path_tokens(bare, at)).otherwise(value)
    return F.concat(F.lit(prefix), F.regexp_replace(filled, '["\n]', ""), F.lit(suffix))


def resolved(declared: DataFrame) -> DataFrame:
    """``(script, key, value)`` of ``declared(script, pos, key, value)``: the evaluated value of the last
    line of each key, if that line is understood."""
    return last_understood(resolve_declares(declared.select("script", "key", "value", "pos")))


def last_understood(lines: DataFrame) -> DataFrame:
    """``(script, key, value)`` of the last line of each key among evaluated declarations."""
    last = lines.groupBy("script", "key").agg(F.max_by(F.struct("value", "understood"), "pos").alias("l"))
    return last.filter("l.understood").select("script", "key", "l.value")


def links(node_rows: DataFrame, declared: DataFrame, at: Column, prefix: str) -> DataFrame:
    """``(script, name, href)`` of stored inputs and of outputs that are not debug files.
    ``declared(script, key, value)`` holds the resolved parameters. They grow with the scripts, but are
    estimated from the size of stored texts that compress well: unhinted, Spark would broadcast them."""
    is_input = F.col("name").startswith("SSTREAM_")
    is_output = (F.col("type") == "output") & ~F.lower("name").contains("debug")
    key = F.when(is_input, F.expr("substr(name, instr(name, '_') + 1)")).otherwise(F.col("name"))
    asked = node_rows.filter(is_input | is_output).select("script", "name", key.alias("key")).distinct()
    keyed = declared.select("script", F.concat(F.lit("@"), "key").alias("key"), "value")
    return asked.join(keyed.hint("merge"), ["script", "key"]).select("script", "name", link(F.col("value"), at, prefix).alias("href"))


def export_edges(edge_rows: DataFrame) -> DataFrame:
    """Edges merged by name, as a graph writer sees them, with their text line."""
    merged = edge_rows.select("script", "src", "dst").distinct()
    esc = lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))
    line = F.concat(F.lit('"'), esc("src"), F.lit('" -> "'), esc("dst"), F.lit('";'))
    return merged.withColumn("line", line)


def export_nodes(node_rows: DataFrame) -> DataFrame:
    return node_rows.groupBy("script", "name").agg(
        F.max("type").alias("type"), F.max_by("fillcolor", "version").alias("fillcolor")
    )
