"""Nested text in one pass: blocks, loops, bracketed groups and views of any depth.

A text is cut at its marks (what opens or closes something, and strings, inside which nothing
does), and the pieces are folded from left to right with what is open as the state.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- marks of the language ---------------------------------------------------------------

STRING = r'"[^"\n]*"'
IF_LINE, ENDIF = r"#IF\b[^\n]*(?:\n|$)", r"#ENDIF\b"
BRANCH = rf"{IF_LINE}|#ELSE\b|{ENDIF}"
LOOP_HEAD = r"\bLOOP\s*\(\s*\w+\s*,\s*@?\s*\w+\s*\)\s*\{"
INT_VALUE = r"#DECLARE\s+{}\s+int\s*=\s*(\d+)"
VIEW_HEAD = r"\bVIEW\b(?:(?!\bBEGIN\b)[\s\S])*?\bRETURN\b(?:(?!\bBEGIN\b)[\s\S])*?\bBEGIN\b"
VIEW_END = r"\bEND\s+VIEW\b"
FILE_VIEW = r"\bCREATE\s+VIEW\b[\s\S]*?\bAS\s+BEGIN"


def _cut(text: Column, marks: str) -> Column:
    """Array of (piece, the mark behind it); the last piece has none."""
    return F.arrays_zip(
        F.split(text, marks, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(marks), F.lit(0)).alias("mark"),
    )


def _top(frames: Column) -> Column:
    return F.try_element_at(frames, F.lit(-1))


def _once(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once (expressions inside folds are not shared)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without_top(frames: Column, n: int = 1) -> Column:
    return F.slice(frames, F.lit(1), F.greatest(F.size(frames) - n, F.lit(0)))


def drop_branches(text: Column) -> Column:
    """Without the blocks from ``#IF`` to its own ``#ENDIF``; marks that belong to none go alone."""

    def step(state: Column, z: Column) -> Column:
        kept = F.when(state["depth"] == 0, F.concat(state["out"], F.array(z["piece"]))).otherwise(state["out"])
        depth = (
            F.when(z["mark"].startswith("#IF"), state["depth"] + 1)
            .when(z["mark"].startswith("#ENDIF"), F.greatest(state["depth"] - 1, F.lit(0)))
            .otherwise(state["depth"])
        )
        return F.struct(depth.alias("depth"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(_cut(text, BRANCH), start, step, lambda s: F.array_join(s["out"], ""))


def keep_branches(text: Column) -> Column:
    """The text of all branches, without the marks."""
    return F.regexp_replace(text, BRANCH, "")


def _copies(body: Column, var: Column, n: Column) -> Column:
    """``n`` copies of a loop's body; what stands on the line of its bracket comes once, behind."""
    token = F.concat(F.lit("@@"), var, F.lit("@@"))

    def copied(z: Column) -> Column:
        line = F.when(z["body"].contains("\n"), F.length(z["last"]) + 1).otherwise(0)
        core = F.substring(z["body"], F.lit(1), F.length(z["body"]) - line)
        return _once(core, lambda c: F.concat(F.when(n < 1, F.lit("")).otherwise(repeated(c)), F.substring(z["body"], F.length(c) + 1, F.length(z["body"]))))

    def repeated(core: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.replace(core, token, i.cast("string")))
        return F.array_join(each, "")

    made = _once(body, lambda b: _once(F.struct(b.alias("body"), F.substring_index(b, "\n", -1).alias("last")), copied))
    return F.when(n.isNull(), body).otherwise(made)


def expand_loops(text: Column) -> Column:
    """``LOOP(v, n) { … }``: n copies of the body with ``@@v@@`` = 0 … n-1, inner loops first; n is a
    number or a declared int. A body whose count is unknown is kept once, and an open loop stays."""
    frame = "struct<head:string,var:string,n:int,text:string>"

    def made(head: Column, var: Column, n: Column, body: Column) -> Column:
        return F.struct(head.alias("head"), var.alias("var"), n.alias("n"), body.alias("text"))

    def count(head: Column) -> Column:
        given = F.regexp_replace(F.regexp_extract(head, r",([^)]*)\)", 1), r"\s", "")
        name = F.ltrim(given, F.lit("@"))
        declared = F.element_at(
            F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.replace(F.lit(INT_VALUE), F.lit("{}"), name), F.lit(1))), -1
        )
        return F.when(given.startswith("@"), declared).otherwise(given).try_cast("int")

    def step(frames: Column, z: Column) -> Column:
        top, mark = _top(frames), z["mark"]
        own = F.concat(top["text"], z["piece"])
        none = F.lit(None).cast("string")

        def put(body: Column) -> Column:
            return F.concat(_without_top(frames), F.array(made(top["head"], top["var"], top["n"], body)))

        def closed() -> Column:
            outer = F.try_element_at(frames, F.lit(-2))
            body = F.when(top["var"].isNull(), F.concat(top["head"], own, F.lit("}"))).otherwise(_copies(own, top["var"], top["n"]))
            return F.concat(_without_top(frames, 2), F.array(made(outer["head"], outer["var"], outer["n"], F.concat(outer["text"], body))))

        opened = made(mark, F.regexp_extract(mark, r"\(\s*(\w+)", 1), count(mark), F.lit(""))
        return (
            F.when(mark.isNull(), put(own))
            .when(mark.startswith("LOOP"), F.concat(put(own), F.array(opened)))
            .when(mark == "{", F.concat(put(own), F.array(made(mark, none, F.lit(None).cast("int"), F.lit("")))))
            .when((mark == "}") & (F.size(frames) > 1), closed())
            .otherwise(put(F.concat(own, mark)))
        )

    start = F.array(F.struct(F.lit("").alias("head"), F.lit(None).alias("var"), F.lit(None).alias("n"), F.lit("").alias("text"))).cast(f"array<{frame}>")
    rest = lambda frames: F.array_join(F.transform(frames, lambda f: F.concat(f["head"], f["text"])), "")
    done = F.aggregate(_cut(text, rf"{LOOP_HEAD}|{STRING}|[{{}}]"), start, step, rest)
    return F.when(text.rlike(LOOP_HEAD), done).otherwise(text)


def without_groups(text: Column, opening: str) -> Column:
    """``text`` without the groups that start with ``opening`` (a pattern that ends behind the
    bracket it opens) and end with the bracket that closes it."""

    def step(state: Column, z: Column) -> Column:
        outside, depth, mark = state["skip"] == 0, state["depth"], z["mark"]
        is_open = mark.contains("(")
        starts = outside & is_open & (mark != "(")
        ends = ~outside & (mark == ")") & (depth == state["skip"])
        shown = F.when(starts | ends | mark.isNull(), F.lit("")).otherwise(mark)
        kept = F.when(outside, F.concat(state["out"], F.array(z["piece"], shown))).otherwise(state["out"])
        skip = F.when(starts, depth + 1).when(ends, F.lit(0)).otherwise(state["skip"])
        moved = F.when(is_open, depth + 1).when(mark == ")", F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        return F.struct(moved.alias("depth"), skip.alias("skip"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(_cut(text, rf"{opening}|[()]"), start, step, lambda s: F.array_join(s["out"], ""))
    return F.when(text.rlike(opening), done).otherwise(text)


def calls_behind(text: Column, word: str, name: str) -> Column:
    """The calls ``name(…)`` that follow ``word``, with the members behind their closing bracket."""

    def step(state: Column, z: Column) -> Column:
        depth = state["depth"] + (z["mark"] == "(").cast("int") - (z["mark"] == ")").cast("int")
        open_ = ~state["closed"] & z["mark"].isNotNull()
        out = F.when(open_, F.concat(state["out"], F.array(z["piece"], z["mark"]))).otherwise(state["out"])
        now = F.when(open_, depth).otherwise(state["depth"])
        return F.struct(now.alias("depth"), (state["closed"] | (open_ & (depth <= 0) & (z["mark"] == ")"))).alias("closed"), out.alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("closed"), F.array().cast("array<string>").alias("out"))

    def call(part: Column) -> Column:
        head = F.aggregate(
            _cut(part, rf"{STRING}|[()]"), start, step, lambda s: F.when(s["closed"], F.array_join(s["out"], ""))
        )
        return F.get(
            F.transform(F.array(head), lambda h: F.concat(h, F.regexp_extract(F.substring(part, F.length(h) + 1, F.length(part)), r"^(?:\.\w+)*", 0))),
            F.lit(0),
        )

    parts = F.split(text, word, -1)
    behind = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    found = F.transform(F.filter(behind, lambda p: p.rlike(rf"^{name}\(")), call)
    return F.when(text.contains(word), F.filter(found, lambda f: f.isNotNull())).otherwise(F.array().cast("array<string>"))


def views(text: Column) -> Column:
    """Array of (at, view, body), in the order in which the views of a module begin. The body of a
    view is without the views inside it."""
    frame, view = "struct<at:int,view:string,text:string>", "struct<at:int,view:string,body:string>"

    def step(state: Column, z: Column) -> Column:
        open_, mark = state["open"], z["mark"]
        top = _top(open_)
        own = F.concat(top["text"], z["piece"])
        put = F.when(F.size(open_) == 0, open_).otherwise(
            F.concat(_without_top(open_), F.array(F.struct(top["at"].alias("at"), top["view"].alias("view"), own.alias("text"))))
        )
        ends = mark.startswith("END") & (F.size(open_) > 0)
        starts = mark.isNotNull() & ~mark.startswith("END")
        name = F.trim(F.regexp_replace(F.regexp_extract(mark, r"(?s)\bVIEW\b(.*?)\bRETURN\b", 1), r"\s+", " "))
        opened = F.struct(state["n"].alias("at"), name.alias("view"), F.lit("").alias("text"))
        closed = F.struct(top["at"].alias("at"), top["view"].alias("view"), own.alias("body"))
        return F.struct(
            F.when(starts, F.concat(put, F.array(opened))).when(ends, _without_top(open_)).otherwise(put).alias("open"),
            F.when(ends, F.concat(state["done"], F.array(closed))).otherwise(state["done"]).alias("done"),
            (state["n"] + F.coalesce(starts.cast("int"), F.lit(0))).alias("n"),
        )

    start = F.struct(F.array().cast(f"array<{frame}>").alias("open"), F.array().cast(f"array<{view}>").alias("done"), F.lit(0).alias("n"))
    return F.aggregate(_cut(text, rf"{VIEW_END}|{VIEW_HEAD}"), start, step, lambda s: F.sort_array(s["done"]))


def file_view_body(text: Column) -> Column:
    """What stands between the head of a view file and its last ``END;``; other text as it is."""
    head = F.regexp_extract(text, FILE_VIEW, 0)
    rest = F.substring(text, F.position(head, text) + F.length(head), F.length(text))
    behind = F.substring_index(rest, "END;", -1)
    body = F.substring(rest, F.lit(1), F.length(rest) - F.length(behind) - 4)
    return F.when((head != "") & rest.contains("END;"), body).otherwise(text)
