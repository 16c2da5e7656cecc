"""Text jobs over a corpus ``scripts(script, text)``: preparation, statements, references.

Every pass is a Column function of one text, so the whole preparation of a corpus is one map
stage. References come from patterns, not from a grammar: the corpus is scanned for the places
where a dataset can be named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowflow.plans import nesting
from rowflow.plans.params import resolve_external

# ---- fixed values ------------------------------------------------------------------------

COMMENT_OR_STRING = (
    r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')|//[^\n]*|/\*(?s:.*?)\*/"""
)
STATEMENT_KEYWORDS = "OUTPUT REDUCE SELECT PROCESS COMBINE SSTREAM EXTRACT VIEW IMPORT USING".split()
NOT_A_TABLE = "SELECT USING SSTREAM VIEW EXTRACT PRODUCE ON PRESORT STREAMEXPIRY TO".split()
DECLARED_TYPES = "string String int long byte bool double float decimal DateTime".split()

NAME = r"[A-Za-z_]\w*(?:\.\w+)*"
VALUE = r'@?"[^"]*"|@@\w+@@|@\w+'
SUBQUERY = r"\bIN ?\( ?SELECT\b"

# A hint is a bracketed list of items ``Name``, ``Name(…)``, ``Name = 7`` or ``Name = (…)``. An index
# has brackets too, but follows a word or a closing bracket and assigns nothing.
HINT_NAME = r"[A-Za-z][\w.]*"
HINT_VALUE = rf"{HINT_NAME}\s*=\s*(?:\d+|\([^\[\]]*\))"
HINT_ITEM = rf"(?:{HINT_VALUE}|{HINT_NAME}(?:\s*\([^\[\]]*\))?)"
HINT_REST = rf"(?:\s*,\s*{HINT_ITEM})*\s*\]"
HINT = rf"\[\s*{HINT_VALUE}{HINT_REST}|(?<![\w\])])\[\s*{HINT_ITEM}{HINT_REST}"

# ---- passes over one text ----------------------------------------------------------------


def strip_comments(text: Column) -> Column:
    """Comments become one space; comment marks inside quotes are left alone. Matches are
    fenced with two control marks, and a fence with nothing inside was a comment."""
    fenced = F.regexp_replace(text, COMMENT_OR_STRING, "\u0001$1\u0002")
    return F.translate(F.replace(fenced, F.lit("\u0001\u0002"), F.lit(" ")), "\u0001\u0002", "")


def flatten_conditionals(text: Column, keep: bool = True) -> Column:
    """``#IF … #ELSE … #ENDIF`` at any depth: keep the text of all branches, or drop the blocks."""
    return nesting.keep_branches(text) if keep else nesting.drop_branches(text)


def expand_loops(text: Column) -> Column:
    """See :func:`rowflow.plans.nesting.expand_loops`."""
    return nesting.expand_loops(text)


def strip_hints(text: Column) -> Column:
    return F.regexp_replace(text, HINT, "")


def list_hints(text: Column) -> Column:
    """The hints that :func:`strip_hints` removes, in the order of the text."""
    return F.regexp_extract_all(text, F.lit(HINT), F.lit(0))


def drop_quoted_semicolons(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("';'"), F.lit("")), F.lit('";"'), F.lit(""))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def drop_blank_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.regexp_replace(line, r"\s+$", ""))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def prepare(scripts: DataFrame, *externals: DataFrame) -> DataFrame:
    """All passes in order. Each of ``externals([script,] key, value)`` in turn fills the
    ``@@name@@`` that are still open, so the first one wins."""
    flat = scripts.withColumn("text", flatten_conditionals(strip_comments(F.col("text"))))
    for values in externals:
        flat = resolve_external(flat, values)
    text = strip_hints(expand_loops(F.col("text")))
    return flat.withColumn("text", ascii_only(drop_quoted_semicolons(text)))


# ---- statements --------------------------------------------------------------------------


def statements(prepared: DataFrame) -> DataFrame:
    """``(script, pos, text)``: non-blank statements before the first ``#CS``."""
    split = prepared.select("script", F.split("text", ";", -1).alias("parts"))
    foreign = F.array_position(F.transform("parts", lambda p: p.contains("#CS")), True)
    kept = F.when(foreign > 0, F.slice("parts", F.lit(1), foreign.cast("int") - 1)).otherwise(F.col("parts"))
    each = split.select("script", F.posexplode(kept).alias("pos", "text"))
    return each.filter(F.col("text").rlike(r"\S"))


def kind(text: Column) -> Column:
    """``DECLARE`` / ``SET``, else the first whole-word keyword, else ``MODULE``."""
    word = F.regexp_extract(text, rf"(?:^|\s)({'|'.join(STATEMENT_KEYWORDS)})(?:\s|$)", 1)
    return (
        F.when(text.contains("#DECLARE"), F.lit("DECLARE"))
        .when(text.contains("#SET"), F.lit("SET"))
        .when(word == "", F.lit("MODULE"))
        .otherwise(word)
    )


def with_kinds(stmts: DataFrame) -> DataFrame:
    return stmts.select("script", "pos", kind(F.col("text")).alias("kind"), "text")


# ---- references and outputs --------------------------------------------------------------


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _named(found: Column, prefix: str, source_type: str, suffix: str = "") -> Column:
    return F.transform(
        found,
        lambda v: F.struct(
            F.concat(F.lit(prefix), v, F.lit(suffix)).alias("source"), F.lit(source_type).alias("source_type")
        ),
    )


def _blank_strings(text: Column) -> Column:
    return F.regexp_replace(text, r'"[^"]*"', '""')


def _tables(blank: Column) -> Column:
    """Names after FROM, JOIN and the rowset keywords, comma lists included, of a text with its strings
    blanked; the lists of ``IN (SELECT …)`` are not sources of the statement."""
    code = F.when(blank.contains("IN"), nesting.without_groups(blank, SUBQUERY)).otherwise(blank)
    member = rf"{NAME}(?: AS \w+)?"
    lists = _all(
        code,
        rf"(?:\b(?:FROM|REDUCE|PROCESS|COMBINE|WITH|APPLY)|JOIN)\b ?\(? ?((?>{member}(?: ?, ?{member})*))(?! ?[(<:])",
    )
    names = F.transform(
        F.split(F.array_join(lists, ","), " ?, ?"), lambda m: F.regexp_replace(m, r" AS \w+$", "")
    )
    return F.filter(names, lambda n: (n != "") & ~n.isin(*NOT_A_TABLE))


def _sources(flat: Column, blank: Column, kind_: Column) -> Column:
    """Array of (source, source_type) that a rowset statement names. A pattern is tried only on
    statements that have its word, which a plain substring search tells much faster."""

    def having(word: str, pattern: str) -> Column:
        return F.when(flat.contains(word), _all(flat, pattern)).otherwise(F.array().cast("array<string>"))

    stored = having("SSTREAM", rf"SSTREAM ?({VALUE})")
    called = F.when(kind_ == "MODULE", _all(flat, rf"^\w+ ?= ?({NAME}) ?\(")).otherwise(
        having("FROM", rf"\bFROM\b ?\(? ?({NAME}) ?\( ?\w+ ?=[^=]")
    )
    found = F.concat(
        _named(having("STREAMSET", rf"STREAMSET ({VALUE})"), "SSTREAM<STREAMSET>_", "SSTREAM<STREAMSET>"),
        F.when(kind_ == "COMBINE", _named(stored, "(SSTREAM", "SSTREAM", ")")).otherwise(
            _named(stored, "SSTREAM_", "SSTREAM")
        ),
        _named(having("EXTRACT", rf"\bEXTRACT\b.*?\bFROM ({VALUE})"), "EXTRACT_", "EXTRACT"),
        _named(having("VIEW", rf"\bVIEW ({VALUE})"), "VIEW_", "VIEW"),
        _named(having("IMPORT", rf"\bIMPORT ({VALUE})"), "IMPORT_", "IMPORT"),
        _named(called, "MODULE_", "MODULE"),
        _named(nesting.calls_behind(flat, "CROSS APPLY ", rf"{NAME}(?:<[^<>]*>)?"), "FUNC_", "FUNC"),
        _named(_tables(blank), "", "table"),
    )
    return F.array_distinct(found)


def _is_set() -> Column:
    return F.col("kind").isin("DECLARE", "SET")


def _is_rowset() -> Column:
    return ~(_is_set() | F.col("kind").isin("OUTPUT", "USING"))


def facts(stmts: DataFrame) -> DataFrame:
    """What a statement says, without its text: one row per statement, one map stage.

    Columns: script, pos, kind, assign_var, using, sources (source, source_type), params, declare
    (key, type, value) and output (path, is_sstream, is_partitioned, sources). The tables
    below are read off it, so a corpus is scanned once however many of them a job needs.
    """
    rows = with_kinds(stmts).withColumn("flat", _flat(F.col("text")))
    flat, kind_, text, blank = F.col("flat"), F.col("kind"), F.col("text"), F.col("blank")
    rows = rows.withColumn("blank", F.when(flat.contains('"'), _blank_strings(flat)).otherwise(flat))
    is_set, is_rowset = _is_set(), _is_rowset()
    rows = rows.withColumn("sources", F.when(is_rowset, _sources(flat, blank, kind_)))

    types = "|".join(DECLARED_TYPES)
    declare = rf"(?s)#DECLARE\s+(\w+)\s+((?:{types})\??|MAP\s*<[^>]*>)\s*=\s*(.*)"
    assign = r"(?s)#SET\s+(\w+)\s*=\s*(.*)"
    pick = lambda i, j: F.when(kind_ == "DECLARE", F.regexp_extract(text, declare, i)).otherwise(
        F.regexp_extract(text, assign, j)
    )
    value = F.replace(F.regexp_replace(pick(3, 2), r"\s+$", ""), F.lit('""'), F.lit('"'))
    declared = F.struct(
        pick(1, 1).alias("key"),
        F.when(kind_ == "DECLARE", F.regexp_extract(text, declare, 2)).alias("type"),
        value.alias("value"),
    )

    named = F.regexp_extract(flat, rf"^OUTPUT ({NAME})", 1)
    inner = F.when(flat.rlike(r"^OUTPUT ?\("), F.array_distinct(_tables(blank)))
    target = rf"\bTO (SSTREAM ?)?({VALUE})"
    output = F.struct(
        F.regexp_extract(flat, target, 2).alias("path"),
        (F.regexp_extract(flat, target, 1) != "").alias("is_sstream"),
        flat.contains("PARTITIONED BY").alias("is_partitioned"),
        F.when((named != "") & ~named.isin("TO", "USING"), F.array(F.substring_index(named, ".", 1)))
        .otherwise(inner)
        .alias("sources"),
    )

    target_name = F.when(kind_ == "IMPORT", F.regexp_extract(flat, r"\bAS (\w+)", 1)).otherwise(
        F.regexp_extract(flat, r"^(\w+) ?=(?!=)", 1)
    )
    using = F.regexp_extract(blank, rf"\bUSING ({NAME})", 1)
    calls = F.exists("sources", lambda s: s["source_type"] == "MODULE")
    args = F.regexp_extract(flat, rf"{NAME} ?\( ?(\w+ ?=[^=].*)\)", 1)
    values = F.transform(_all(args, r'\w+ ?= ?("[^"]*"|[^,()"]+(?:\([^()]*\))?)'), lambda v: F.trim(v))
    return rows.select(
        "script",
        "pos",
        "kind",
        F.when(is_rowset, F.nullif(target_name, F.lit(""))).alias("assign_var"),
        F.when(kind_.isin("PROCESS", "REDUCE", "COMBINE"), F.nullif(using, F.lit(""))).alias("using"),
        "sources",
        F.when(is_rowset, F.when(calls, F.array_distinct(values)).otherwise(F.array().cast("array<string>"))).alias("params"),
        F.when(is_set, declared).alias("declare"),
        F.when(kind_ == "OUTPUT", output).alias("output"),
    )


def declares(fact_rows: DataFrame) -> DataFrame:
    """``(script, pos, key, type, value)`` of ``#DECLARE`` and ``#SET`` (no type)."""
    # Spark filters below the projection that makes the facts, so each table first asks for the
    # kind: a test of an extracted column alone would extract it twice, of every statement.
    return fact_rows.filter(_is_set() & (F.col("declare.key") != "")).select("script", "pos", "declare.*")


def references(fact_rows: DataFrame) -> DataFrame:
    """``(script, pos, assign_var, source, source_type)`` of rowset statements; a statement that
    names no source has one row with a null source."""
    rows = fact_rows.filter(_is_rowset())
    each = rows.select("script", "pos", "assign_var", F.explode_outer("sources").alias("s"))
    return each.select("script", "pos", "assign_var", "s.source", "s.source_type")


def outputs(fact_rows: DataFrame) -> DataFrame:
    """``(script, pos, source, path, is_sstream, is_partitioned)``; one row per source, a null
    source for ``OUTPUT TO``. All branches of a union are sources."""
    rows = fact_rows.filter(F.col("kind") == "OUTPUT")
    return rows.select(
        "script",
        "pos",
        F.explode_outer("output.sources").alias("source"),
        "output.path",
        "output.is_sstream",
        "output.is_partitioned",
    )


# ---- modules and views -------------------------------------------------------------------


def module_views(modules: DataFrame) -> DataFrame:
    """``(module, text)`` -> ``(module, view, text)``, one row per view of a module file; a view inside
    another one is a row of its own."""
    each = modules.select("module", F.explode(nesting.views(F.col("text"))).alias("v"))
    return each.select("module", "v.view", F.col("v.body").alias("text"))


def view_body(text: Column) -> Column:
    """The statements of a view file; other text is returned as it is."""
    return nesting.file_view_body(text)
