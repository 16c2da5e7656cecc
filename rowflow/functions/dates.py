"""Date formats, path tokens and date expressions of the script language, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values: .NET format part -> the field it stands for, in the order they are replaced.
FORMAT_PARTS = {
    "yyyy": ("year", 4),
    "MM": ("month", 2),
    "dd": ("day", 2),
    "HH": ("hour", 2),
    "mm": ("minute", 2),
    "ss": ("second", 2),
}

# Path token -> field.
PATH_TOKENS = {
    "%Y": ("year", 4),
    "%m": ("month", 2),
    "%d": ("day", 2),
    "%H": ("hour", 2),
    "%h": ("hour", 2),
    "%M": ("minute", 2),
    "%S": ("second", 2),
}

# A brace token whose parts are all optional.
YMD_TOKEN = r"\{(yyyy)?([-_/]?MM)?([-_/]?dd)?([-_/]?HH)?\}"


def _field(at: Column, field: str, width: int) -> Column:
    return F.lpad(getattr(F, field)(at).cast("string"), width, "0")


def _fill(text: Column, at: Column, parts: dict[str, tuple[str, int]]) -> Column:
    for part, (field, width) in parts.items():
        text = F.replace(text, F.lit(part), _field(at, field, width))
    return text


def format_date(at: Column, fmt: Column) -> Column:
    """``d.ToString(fmt)`` where ``fmt`` may differ by row."""
    return _fill(fmt, at, FORMAT_PARTS)


def is_date_format(fmt: Column) -> Column:
    return fmt.rlike("yyyy|MM|dd|HH")


def date_text(at: Column) -> Column:
    """A date as text when no format is given: ``2018-08-03 00:00:00``."""
    year, month, day, hour, minute, second = (_field(at, *part) for part in FORMAT_PARTS.values())
    lit = F.lit
    return F.concat(year, lit("-"), month, lit("-"), day, lit(" "), hour, lit(":"), minute, lit(":"), second)


def parse_date(text: Column) -> Column:
    """Text to timestamp, null when it is not a date (ISO forms and ``yyyyMMdd``)."""
    text = F.trim(text)
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    looks_like = compact.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?.*)?$")
    return F.when(looks_like, compact.try_cast("timestamp_ntz"))


def fill_path_tokens(path: Column, at: Column) -> Column:
    """``%Y %m %d %H %h %M %S`` from ``at``; unchanged when it is null."""
    return F.when(at.isNull(), path).otherwise(_fill(path, at, PATH_TOKENS))


def fill_ymd_token(text: Column, at: Column) -> Column:
    """Render the first distinct ``{yyyy-MM-dd}``-like token, in all its copies."""
    token = F.regexp_extract(text, YMD_TOKEN, 0)
    body = token.substr(F.lit(2), F.length(token))
    body = F.regexp_replace(body, r"\}$", "")
    return F.when(token == "", text).otherwise(F.replace(text, token, format_date(at, body)))


def add_days(at: Column, days: Column) -> Column:
    return at + F.make_dt_interval(days=days)


def eval_date(text: Column) -> Column:
    """``DateTime.Parse("…").AddDays(n).ToString("…")`` as text; ParseExact takes its first
    argument, adjacent string literals are joined, spaces inside AddDays do not matter."""
    flat = F.regexp_replace(text, r'"\s*\+\s*"', "")
    at = parse_date(F.regexp_extract(flat, r'DateTime\.Parse(?:Exact)?\(\s*"([^"]*)"', 1))
    days = F.regexp_replace(F.regexp_extract(flat, r"AddDays\(([^)]*)\)", 1), " ", "")
    moved = add_days(at, F.coalesce(days.try_cast("int"), F.lit(0)))
    fmt = F.regexp_extract(flat, r'ToString\("?(.*?)"?\)', 1)
    return F.when(is_date_format(fmt), format_date(moved, fmt)).otherwise(date_text(moved))


def days_of_range(text: Column) -> Column:
    """``2018-01-01...2018-01-05`` as an array of days."""
    low = F.to_date(F.substring_index(text, "...", 1))
    return F.sequence(low, F.to_date(F.substring_index(text, "...", -1)))


def _put_dated(at: Column, text: Column, start: int):
    """Replaces one placeholder ``{i:fmt}``, whose format begins at ``start``."""

    def put(filled: Column, token: Column) -> Column:
        fmt = F.regexp_replace(token.substr(F.lit(start), F.length(token)), r"\}$", "")
        value = F.when(is_date_format(fmt), format_date(at, fmt)).otherwise(text)
        return F.replace(filled, token, value)

    return put


def string_format(template: Column, args: list[tuple[str, Column]]) -> Column:
    """``string.Format(template, a0, a1, …)`` with the path tokens of the language.

    ``args`` are ("text", column) or ("date", column). ``{i}`` is the argument as text,
    ``{i:fmt}`` the argument as a date in that format. Path tokens are then filled from the
    last dated placeholder, else the last date argument, else the first text argument that
    is a date; ``%n`` is 1.
    """
    dates = [F.coalesce(c.cast("timestamp_ntz")) if kind == "date" else parse_date(c) for kind, c in args]
    texts = [F.coalesce(date_text(c), F.lit("")) if kind == "date" else c for kind, c in args]
    filled = F.replace(template, F.lit("%n"), F.lit("1"))
    placed = F.regexp_extract_all(filled, F.lit(r"\{\d+:[^}]*\}"), F.lit(0))
    dated = F.filter(placed, lambda p: is_date_format(F.substring_index(p, ":", -1)))
    for i, (at, text) in enumerate(zip(dates, texts)):
        filled = F.replace(filled, F.lit(f"{{{i}}}"), text)
        own = F.array_distinct(F.filter(placed, lambda p: p.startswith(f"{{{i}:")))

        filled = F.aggregate(own, filled, _put_dated(at, text, len(str(i)) + 3))
    last = F.regexp_extract(F.element_at(dated, -1), r"^\{(\d+):", 1).cast("int")
    by_placeholder = F.when(F.size(dated) > 0, F.get(F.array(*dates), last))
    date_args = [d for (kind, _), d in zip(args, dates) if kind == "date"]
    text_args = [d for (kind, _), d in zip(args, dates) if kind == "text"]
    implied = F.coalesce(by_placeholder, *date_args[::-1], *text_args)
    # One struct holds both values, so that neither expression is repeated per token.
    once = F.array(F.struct(filled.alias("path"), implied.alias("at")))
    return F.get(F.transform(once, lambda z: fill_path_tokens(z["path"], z["at"])), F.lit(0))


def interval_code(text: Column) -> Column:
    """``1.00:00:00`` -> ``1D``, ``03:00:00`` -> ``3H``, ``P1D`` / ``P2D`` -> ``1D`` / ``2D``. Zeros
    in front of hours are dropped, so less than an hour gives ``H`` (see interval_minutes)."""
    return (
        F.when(text.isin("P1D", "P2D"), F.substring(text, 2, 2))
        .when(text.contains("."), F.concat(F.substring_index(text, ".", 1), F.lit("D")))
        .otherwise(F.concat(F.ltrim(F.substring_index(text, ":", 1), F.lit("0")), F.lit("H")))
    )


def interval_minutes(text: Column) -> Column:
    """The same interval in whole minutes."""
    days = F.when(text.contains("."), F.substring_index(text, ".", 1).try_cast("int")).otherwise(0)
    clock = F.substring_index(text, ".", -1)
    minutes = F.substring_index(clock, ":", 1).try_cast("int") * 60 + F.get(F.split(clock, ":"), F.lit(1)).try_cast("int")
    iso = F.regexp_extract(text, r"^P(\d+)D$", 1).try_cast("int") * 1440
    return F.coalesce(iso, days * 1440 + minutes)


def event_name(text: Column) -> Column:
    """``D:Name/part`` -> ``Name``."""
    return F.regexp_extract(text, r"^(?:[dD]:)?([^/]*)", 1)
