"""Exact strings of parameters, dates and path templates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rowflow.functions import dates as D
from rowflow.plans import params as P


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def day(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "template, args, want",
    [
        ("{1}/{0}/{1}.txt", [("text", "km"), ("text", "van")], "van/km/van.txt"),
        ("no places", [("text", "x")], "no places"),
        ("/fleet/{0:yyyyMM}/d{0:dd}.ss", [("date", "2021-03-09")], "/fleet/202103/d09.ss"),
        ("/fleet/%Y/d_%m%d.ss?x={0:yyyy}", [("date", "2020-02-29")], "/fleet/2020/d_0229.ss?x=2020"),
        ("{0}/%Y/legs.ss?date={1}&hour={2}", [("text", "/geo"), ("text", "2022-07-31"), ("text", "5")], "/geo/2022/legs.ss?date=2022-07-31&hour=5"),
    ],
)
def test_string_format(spark, template, args, want):
    cols = [(k, day(v) if k == "date" else F.lit(v)) for k, v in args]
    assert one(spark, D.string_format(F.lit(template), cols)) == want


def test_last_date_argument_fills_path_tokens(spark):
    # Two dates: a dated place wins over the last date argument.
    args = [("date", day("2024-07-09")), ("text", F.lit("west")), ("date", day("2023-11-30"))]
    got = one(spark, D.string_format(F.lit("{1}/%d.%m/{0:yyyy}"), args))
    assert got == "west/09.07/2024"
    got = one(spark, D.string_format(F.lit("{1}/%d.%m/%Y"), args))
    assert got == "west/30.11/2023"


@pytest.mark.parametrize(
    "text, want",
    [
        ('DateTime.Parse("2020-02-27").AddDays(2).ToString("dd.MM.yyyy")', "29.02.2020"),
        ('DateTime.Parse("2021-01-01").AddDays( - 1 ).ToString("yyyyMMdd")', "20201231"),
        ('DateTime.Parse("1999-12-31")', "1999-12-31 00:00:00"),
        ('DateTime.ParseExact("2022-07-04" + " 00:00:00", "yyyy-MM-dd HH:mm:ss", Culture)', "2022-07-04 00:00:00"),
        ('DateTime.Parse("20231001").AddDays(-30).ToString("yyyy/MM/dd")', "2023/09/01"),
    ],
)
def test_date_chain(spark, text, want):
    assert one(spark, D.eval_date(F.lit(text))) == want


@pytest.mark.parametrize(
    "text, code, minutes",
    [
        ("1.00:00:00", "1D", 1440),
        ("2.00:00:00", "2D", 2880),
        ("5.00:00:00", "5D", 7200),
        ("01:00:00", "1H", 60),
        ("03:00:00", "3H", 180),
        ("P1D", "1D", 1440),
        ("P2D", "2D", 2880),
        ("00:30:00", "H", 30),
    ],
)
def test_intervals(spark, text, code, minutes):
    assert one(spark, D.interval_code(F.lit(text))) == code
    assert one(spark, D.interval_minutes(F.lit(text))) == minutes


@pytest.mark.parametrize("text, want", [("D:Ev/x/y", "Ev"), ("d:Ev", "Ev"), ("Ev/z", "Ev"), ("Ev", "Ev")])
def test_event_name(spark, text, want):
    assert one(spark, D.event_name(F.lit(text))) == want


@pytest.mark.parametrize(
    "value, call, want",
    [
        ("aa.ss", 'Replace(".ss", "_fakeForSanityCheck.ss")', "aa_fakeForSanityCheck.ss"),
        ("a/;/", "TrimEnd('/', ';')", "a"),
        ("/a/", "Trim('/')", "a"),
    ],
)
def test_string_functions(spark, value, call, want):
    assert one(spark, P.eval_string(F.lit(value), F.lit(call))) == want


def test_numbers(spark):
    assert one(spark, P.eval_number(F.lit('int.Parse("1000")'))) == 1000
    assert one(spark, P.eval_number(F.lit("Math.Abs(-1000)"))) == 1000
    assert one(spark, P.eval_number(F.lit("Math.Abs(-0)"))) == 0


def test_ymd_token_first_only(spark):
    at = day("2018-03-04 05:00:00")
    assert one(spark, D.fill_ymd_token(F.lit("{yyyy-MM-dd}/{yyyy-MM-dd}/{HH}"), at)) == "2018-03-04/2018-03-04/{HH}"
    assert one(spark, D.fill_ymd_token(F.lit("a{}b"), at)) == "ab"
    assert one(spark, D.fill_ymd_token(F.lit("{other}"), at)) == "{other}"


def test_days_of_range(spark):
    got = one(spark, D.days_of_range(F.lit("2017-12-30...2018-01-02")))
    assert got == [dt.date(2017, 12, 30), dt.date(2017, 12, 31), dt.date(2018, 1, 1), dt.date(2018, 1, 2)]


def test_substitution_is_one_pass(spark):
    scripts = spark.createDataFrame([("s", "@@A@@ @@B@@ @@C@@"), ("t", "plain"), ("u", None)], "script string, text string")
    params = spark.createDataFrame([("A", "@@B@@"), ("B", "b"), ("C", None)], "key string, value string")
    got = {r.script: r.text for r in P.resolve_external(scripts, params).collect()}
    assert got == {"s": "@@B@@ b @@C@@", "t": "plain", "u": None}


def test_master_substitution(spark):
    jobs = spark.createDataFrame([("p", "K", "m", '\\"$(A)/$(B)\\"')], "process string, key string, master string, value string")
    masters = spark.createDataFrame([("m", "A", "x$(B)"), ("m", "B", None)], "master string, key string, value string")
    assert P.resolve_master(jobs, masters).first()["value"] == '"x$(B)/$(B)"'


def test_reference_chain_depth(spark):
    chain = [("s", "K0", "v")] + [("s", f"K{i}", f"@K{i - 1}") for i in range(1, 8)]
    got = {r.key: r.value for r in P.resolve_references(spark.createDataFrame(chain, "script string, key string, value string")).collect()}
    # Each pass replaces by the value as written, so five passes follow five references.
    assert got["K5"] == "v"
    assert got["K7"] == "@K1"


def test_repeated_keys_take_the_last_value(spark):
    from rowflow.plans import params as P

    scripts = spark.createDataFrame([("s", "a @@k@@ b")], "script string, text string")
    values = spark.createDataFrame([("k", "1", 1), ("k", "2", 2)], "key string, value string, pos int")
    assert P.resolve_external(scripts, values).first().text == "a 2 b"
    declares = spark.createDataFrame(
        [("s", "Out", "x", 1), ("s", "Out", "@In/y", 2), ("s", "In", "root", 3), ("s", "None", None, 4)],
        "script string, key string, value string, pos int",
    )
    got = {r.key: r.value for r in P.resolve_references(declares).collect()}
    assert got == {"Out": "root/y", "In": "root", "None": None}


def test_long_tokens_are_read_whole(spark):
    from rowflow.functions import dates as D

    body = "yyyy" + "-" * 1100 + "MM"
    rows = spark.createDataFrame([("{0:" + body + "}",)], "t string")
    at = F.to_timestamp(F.lit("2020-03-01")).cast("timestamp_ntz")
    assert rows.select(D.string_format(F.col("t"), [("date", at)]).alias("x")).first().x.endswith("-03")


def test_references_bind_to_the_latest_earlier_line(spark):
    rows = [
        ("s", "Root", "/a", 0), ("s", "One", "@Root/1", 1), ("s", "Root", "@Root/b", 2), ("s", "Two", "@Root/2@One", 3),
        ("s", "Early", "@Later", 4), ("s", "Later", "z", 5), ("s", "Own", "@Own", 6), ("s", "Nil", None, 7),
        ("t", "Root", "/t", 9), ("t", "One", "@@Root@@;@None", 10),
    ]
    got = P.resolve_references(spark.createDataFrame(rows, "script string, key string, value string, pos int"))
    assert {(r.script, r.key): r.value for r in got.collect()} == {
        ("s", "Root"): "/a/b", ("s", "One"): "/a/1", ("s", "Two"): "/a/b/2/a/1", ("s", "Early"): "z",
        ("s", "Later"): "z", ("s", "Own"): "@Own", ("s", "Nil"): None, ("t", "Root"): "/t", ("t", "One"): "@@Root@@;@None",
    }


def test_long_reference_chain(spark):
    """Every line names the one before: as many steps as lines."""
    rows = [("s", "K", "x", 0)] + [("s", "K", "@K.", i) for i in range(1, 9)]
    got = P.resolve_references(spark.createDataFrame(rows, "script string, key string, value string, pos int"))
    assert got.first().value == "x" + "." * 8
