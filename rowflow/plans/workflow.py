"""Scheduler configs as tables, and the script / event dependency graph over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowflow.functions.dates import event_name, interval_code
from rowflow.operators.aggregate import list_of
from rowflow.operators.ordered import text_block
from rowflow.plans.params import job_params, resolve_master
from rowflow.session import cut_lineage

# The runner class whose configs count, the parameters that hold lists, the path
# part that is always skipped, and the node that stands for "depends on nothing".
RUNNER = "ScopeJobRunner"
LIST_PARAMS = ("EventNamesToCheck", "ScopeJobParams")
EXCLUDED = "/objd/"
NO_EVENT = "None"


def read_config_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)`` of all .config files under ``folder``."""
    files = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.config")
        .text(folder)
    )
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parse_configs(files: DataFrame) -> DataFrame:
    """``(path, text)`` -> one row per file with its parts as arrays; ``valid`` is false for text
    that is not XML, and such text never reaches the path expressions."""
    checked = F.from_xml(
        "text", "Process string, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    )
    seen = files.withColumn("__x", checked)
    safe = F.when(F.col("__x").isNotNull() & F.col("__x.__bad").isNull(), F.col("text"))
    staged = seen.select("path", safe.alias("xml"))
    get = lambda p: F.xpath("xml", F.lit(p))
    text = lambda p: F.xpath_string("xml", F.lit(p))
    params = "/*/Parameters/*"
    plain = f"{params}[Value/text() and not(Value/*)]"
    empty = f"{params}[not(Value/text()) and not(Value/*)]"
    lists = [
        F.struct(F.lit(n).alias("name"), get(f'{params}[Name="{n}"]/Value/*/text()').alias("values"))
        for n in LIST_PARAMS
    ]
    return staged.select(
        "path",
        F.col("xml").isNotNull().alias("valid"),
        F.xpath_boolean("xml", F.lit("/*/SqlConnectionString")).alias("is_master"),
        text("/*/Process").alias("process"),
        text("/*/ClassName").alias("class_name"),
        F.arrays_zip(get(f"{plain}/Name/text()").alias("name"), get(f"{plain}/Value/text()").alias("value")).alias("plain"),
        get(f"{empty}/Name/text()").alias("empty"),
        F.filter(F.array(*lists), lambda v: F.size(v["values"]) > 0).alias("lists"),
        F.arrays_zip(
            get("/*/Workflows/*/Process/text()").alias("process"), get("/*/Workflows/*/Group/text()").alias("group")
        ).alias("members"),
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_name(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def master_key(path: Column) -> Column:
    return F.concat(folder_name(path), F.lit("##"), file_name(path))


def workflow_params(parsed: DataFrame) -> DataFrame:
    """``(path, process, class_name, param, values)``."""
    rows = parsed.filter(F.col("valid") & ~F.col("is_master"))
    each = F.concat(
        F.transform("plain", lambda p: F.struct(p["name"].alias("param"), F.array(p["value"]).alias("values"))),
        F.transform(
            "empty", lambda n: F.struct(n.alias("param"), F.array(F.lit(None).cast("string")).alias("values"))
        ),
        F.transform("lists", lambda v: F.struct(v["name"].alias("param"), v["values"].alias("values"))),
    )
    return rows.select("path", "process", "class_name", F.explode(each).alias("p")).select(
        "path", "process", "class_name", "p.*"
    )


def first_masters(parsed: DataFrame) -> DataFrame:
    """Master files; of several with the same key the first path counts."""
    rows = parsed.filter(F.col("valid") & F.col("is_master") & ~excluded(F.col("path"), [])).withColumn("master", master_key(F.col("path")))
    return rows.groupBy("master").agg(F.min_by(F.struct("plain", "empty", "members"), "path").alias("m"))


def master_params(masters: DataFrame) -> DataFrame:
    """``(master, key, value)``."""
    pair = lambda k, v: F.struct(k.alias("key"), v.cast("string").alias("value"))
    each = F.concat(
        F.transform("m.plain", lambda p: pair(p["name"], p["value"])),
        F.transform("m.empty", lambda n: pair(n, F.lit(None))),
    )
    return masters.select("master", F.explode(each).alias("p")).select("master", "p.*")


def memberships(masters: DataFrame) -> DataFrame:
    """``(process, group, master)``."""
    return masters.select("master", F.explode("m.members").alias("e")).select("e.process", "e.group", "master")


def excluded(path: Column, keys: list[str]) -> Column:
    test = F.lit(False)
    for key in [*keys, EXCLUDED]:
        test = test | path.contains(key)
    return test


def processes(parsed: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """``(process, path, script, script_file, event, interval, deps)`` of runner configs. A process
    is named like its file; of several files with one name the last path counts."""
    rows = parsed.filter(
        F.col("valid") & ~F.col("is_master") & F.col("class_name").contains(RUNNER)
        & ~excluded(F.col("path"), exclude or [])
    )
    value = lambda n: F.get(F.filter("plain", lambda p: p["name"] == n), F.lit(0))["value"]
    deps = F.get(F.filter("lists", lambda v: v["name"] == LIST_PARAMS[0]), F.lit(0))["values"]
    named = rows.select(
        F.regexp_replace(file_name(F.col("path")), r"\.config", "").alias("process"),
        "path",
        file_name(value("ScriptFile")).alias("script"),
        value("ScriptFile").alias("script_file"),
        value("EventName").alias("event"),
        interval_code(value("DeltaInterval")).alias("interval"),
        F.coalesce(deps, F.array(F.lit(NO_EVENT))).alias("deps"),
    )
    rest = ["path", "script", "script_file", "event", "interval", "deps"]
    return named.groupBy("process").agg(F.max_by(F.struct(*rest), "path").alias("p")).select("process", "p.*")


def script_processes(procs: DataFrame) -> DataFrame:
    """``(script, process)``: the first path that runs a script names its process."""
    return procs.groupBy("script").agg(F.min_by("process", "path").alias("process"))


def process_params(parsed: DataFrame, masters: DataFrame) -> DataFrame:
    """``(process, key, master, value)``: the job parameters of each process that a master lists,
    with the master's values filled in. Of several masters the last one counts."""
    runners = F.col("class_name").contains(RUNNER) & ~excluded(F.col("path"), [])
    items = parsed.filter(F.col("valid") & ~F.col("is_master") & runners).select(
        F.regexp_replace(file_name(F.col("path")), r"\.config", "").alias("process"),
        F.get(F.filter("lists", lambda v: v["name"] == LIST_PARAMS[1]), F.lit(0))["values"].alias("items"),
        "path",
    )
    jobs = items.filter(F.col("items").isNotNull()).groupBy("process").agg(F.max_by("items", "path").alias("items"))
    owner = memberships(masters).groupBy("process").agg(F.max("master").alias("master"))
    return resolve_master(job_params(jobs).join(owner, "process"), master_params(masters))


def enabled(procs: DataFrame, members: DataFrame) -> DataFrame:
    """Processes that some master lists."""
    return procs.join(members.select("process"), "process", "left_semi")


def dependency_edges(procs: DataFrame) -> DataFrame:
    """``(src, src_type, dst, dst_type)``: event -> script for each dependency, script -> event for
    the event it raises. Input events are normalised, output events are kept as they are."""
    raised = procs.filter(F.col("event").isNotNull()).select(
        F.col("script").alias("src"), F.lit("SCRIPT").alias("src_type"),
        F.col("event").alias("dst"), F.lit("EVENT").alias("dst_type"),
    )
    needs = procs.select(F.explode("deps").alias("dep"), "script").select(
        event_name(F.col("dep")).alias("src"), F.lit("EVENT").alias("src_type"),
        F.col("script").alias("dst"), F.lit("SCRIPT").alias("dst_type"),
    )
    return raised.unionAll(needs).distinct()


def dependency_nodes(edges: DataFrame, procs: DataFrame) -> DataFrame:
    """``(name, type, label, interval, is_external)``; an event nobody raises at a known interval
    is external."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("name"), F.col("src_type").alias("type")),
                F.struct(F.col("dst").alias("name"), F.col("dst_type").alias("type")),
            )
        ).alias("n")
    ).select("n.*").distinct()
    times = procs.filter(F.col("interval").isNotNull()).groupBy(F.col("event").alias("name")).agg(
        F.max_by("interval", "path").alias("interval")
    )
    is_event = F.col("type") == "EVENT"
    full = ends.join(times, "name", "left").withColumn("interval", F.when(is_event, F.col("interval")))
    shown = F.when(
        F.col("interval").isNotNull(), F.concat("name", F.lit(" ("), "interval", F.lit(")"))
    ).otherwise(F.col("name"))
    return full.select(
        "name", "type", shown.alias("label"), "interval", (is_event & F.col("interval").isNull()).alias("is_external")
    )


def node_colour(type_: Column, interval: Column) -> Column:
    """Daily, hourly and external events."""
    return F.when(
        type_ == "EVENT",
        F.when(interval.endswith("D"), "lightblue").when(interval.endswith("H"), "palegoldenrod").otherwise("gray"),
    )


def rollup(members: DataFrame, chunk: int = 1000, hot_rows: int = 1_000_000) -> DataFrame:
    """``(master, group, part, processes)``: process names of a group in order; a group longer than
    ``chunk`` goes on in further parts. Groups of more than ``hot_rows`` names are cut into ranges
    of names for the work, which changes nothing in the result."""
    rows = cut_lineage(members.select("master", "group", "process").distinct())
    ranges = text_block(rows, "process")
    return list_of(rows, ["master", "group"], ["process"], F.col("process"), ranges, "processes", chunk, hot_rows)


def targets(procs: DataFrame, folder: str | None = None, names: list[str] | None = None) -> DataFrame:
    """``(name)``: scripts to trace, by a folder their config lies in or by script name."""
    test = F.lit(False)
    if folder:
        test = test | procs["path"].contains(folder)
    if names:
        test = test | procs["script"].isin(*names)
    return procs.filter(test).select(F.col("script").alias("name")).distinct()


def failures(parsed: DataFrame) -> DataFrame:
    """``(folder, message, files)`` of configs that could not be used."""
    message = F.when(~F.col("valid"), "not well-formed").when(
        ~F.col("is_master") & (F.col("process") == ""), "no process"
    )
    bad = parsed.filter(~excluded(F.col("path"), [])).select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), message.alias("message"))
    return bad.filter(F.col("message").isNotNull()).groupBy("folder", "message").agg(F.count(F.lit(1)).alias("files"))
