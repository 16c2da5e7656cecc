"""Sources and sinks on fresh folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from rowflow.plans import catalog as H, workflow as W
from rowflow.session import partitioned, scratch_path, shared_root
from rowflow.sources import sinks, streams, text


def test_declared_schema():
    schema = text.declared_schema("AccountId : int?, Org : string, Big:ulong, When:DateTime, Plain")
    assert [f.dataType for f in schema] == [
        T.IntegerType(), T.StringType(), T.DecimalType(20, 0), T.TimestampNTZType(), T.StringType(),
    ]


def test_extract_fails_fast_unless_silent(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\ta\nbad\tb\n3\tc\tmore\n4\td\n")
    path = str(tmp_path / "t.tsv")
    with pytest.raises(Exception):
        text.extract(spark, path, "id:int?, name:string").collect()
    rows = text.extract(spark, path, "id:int?, name:string", silent=True)
    assert {tuple(r) for r in rows.collect()} == {(1, "a"), (4, "d")}
    assert rows.select("name").count() == 2 and rows.count() == 2


def test_members():
    assert streams.members("f%n.ss", "__serialnum", "0", "2") == ["f0.ss", "f1.ss", "f2.ss"]
    days = streams.members("%Y/%m/D_%Y%m%d.ss", "__date", "2018-02-28", "2018-03-01")
    assert days == ["2018/02/D_20180228.ss", "2018/03/D_20180301.ss"]
    hours = streams.members("%Y%m%d%h", "__hour", "2018-01-01 22:00:00", "2018-01-02 00:00:00")
    assert hours == ["2018010122", "2018010123", "2018010200"]
    assert streams.members("%Y", "__year", "2017-12-30", "2018-01-02") == ["2017", "2018"]


@pytest.fixture()
def days(spark, tmp_path):
    for d in (1, 2, 4):
        spark.range(d).write.parquet(f"{tmp_path}/2018/01/D_2018-01-{d:02d}.ss")
    return str(tmp_path)


def test_streamset_missing_member(spark, days):
    pattern = "%Y/%m/D_%Y-%m-%d.ss"
    with pytest.raises(Exception):
        streams.read_streamset(spark, days, pattern, "__date", "2018-01-01", "2018-01-04").count()
    rows = streams.read_streamset(spark, days, pattern, "__date", "2018-01-01", "2018-01-04", sparse=True)
    got = {r["__date"]: r.n for r in rows.groupBy("__date").agg(F.count("*").alias("n")).collect()}
    assert got == {dt.date(2018, 1, 1): 1, dt.date(2018, 1, 2): 2, dt.date(2018, 1, 4): 4}


def test_dated_path(spark, days):
    path = f"{days}/%Y/%m/D_%Y-%m-%d.ss?date=2018-01-02...2018-01-03&sparsestreamset=true"
    assert streams.read_dated_path(spark, path).count() == 2
    assert streams.read_dated_path(spark, f"{days}/%Y/%m/D_%Y-%m-%d.ss?date=2018-01-04").count() == 4


def test_hour_range(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/E_2018-01-01_05")
    rows = streams.read_dated_path(spark, f"{tmp_path}/E_%Y-%m-%d_%h?date=2018-01-01&hour=5")
    assert rows.count() == 3


def test_hot_cluster_key_continues_in_other_files(spark, tmp_path):
    df = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("k"), "id")
    sinks.cluster(df, "k", 8, target_rows=50).write.parquet(str(tmp_path / "c"))
    files = spark.read.parquet(str(tmp_path / "c")).select("k", "id", F.col("_metadata.file_path").alias("f"))
    assert files.count() == 300
    spread = {r.k: r.n for r in files.groupBy("k").agg(F.count_distinct("f").alias("n")).collect()}
    assert spread.pop(0) > 1 and set(spread.values()) == {1}


def test_rows_of_a_hot_key_never_meet_in_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the counts seem large
    try:
        df = spark.range(300).select((F.col("id") % 2).alias("k"), "id")
        dealt = sinks.cluster(df, "k", target_rows=50)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning") == 1 and "__share" in plan.split("hashpartitioning(")[1].split(")")[0]
        assert dealt.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("b1", "b2"):
            sinks.output_bucketed(spark.range(50).toDF("k"), name, "k", 4, sorted_by="k")
        joined = spark.table("b1").join(spark.table("b2"), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sorted_output(spark, tmp_path):
    df = spark.range(100).select((F.col("id") * 37 % 11).alias("k"))
    path = sinks.output(df, str(tmp_path / "s"), clustered_by="k", files=3, sorted_by="k")
    parts = spark.read.parquet(path).select("k", F.col("_metadata.file_path").alias("f")).collect()
    by_file = {}
    for r in parts:
        by_file.setdefault(r.f, []).append(r.k)
    assert all(v == sorted(v) for v in by_file.values())


def test_expiry(spark, tmp_path):
    path = str(tmp_path / "e")
    sinks.output(spark.range(2), path, expires=(dt.date(2018, 1, 1), 5))
    sinks.output(spark.range(3), path, expires=(dt.date(2018, 1, 3), 5))
    assert sinks.purge_expired(spark, path, dt.date(2018, 1, 6)) == []
    assert sinks.purge_expired(spark, path, dt.date(2018, 1, 7)) == ["_expires_on=2018-01-06"]
    assert spark.read.parquet(path).count() == 3


def test_shared_folder_comes_from_the_session(spark, shared_folder):
    assert shared_root(spark) == shared_folder
    assert scratch_path(spark, "x").startswith(shared_folder)


def test_config_folder(spark, tmp_path):
    (tmp_path / "G" / "objd").mkdir(parents=True)
    body = (
        "<C><Process>{p}</Process><ClassName>x.ScopeJobRunner</ClassName><Parameters>"
        "<P><Name>ScriptFile</Name><Value>d/S.script</Value></P><P><Name>EventName</Name><Value>Ev</Value></P>"
        "<P><Name>DeltaInterval</Name><Value>03:00:00</Value></P></Parameters></C>"
    )
    (tmp_path / "G" / "A.config").write_text(body.format(p="A"))
    (tmp_path / "G" / "B.config").write_text(body.format(p="Wrong"))
    (tmp_path / "G" / "objd" / "C.config").write_text(body.format(p="C"))
    (tmp_path / "G" / "Bad.config").write_text("<C><Process>")
    (tmp_path / "G" / "M.config").write_text(
        "<M><SqlConnectionString/><Parameters/><Workflows><W><Process>A</Process><Group>g</Group></W></Workflows></M>"
    )
    parsed = W.parse_configs(W.read_config_files(spark, str(tmp_path)))
    procs = W.processes(parsed)
    assert {(r.process, r.script, r.interval, tuple(r.deps)) for r in procs.collect()} == {
        ("A", "S.script", "3H", ("None",)), ("B", "S.script", "3H", ("None",)),
    }
    assert [(r.script, r.process) for r in W.script_processes(procs).collect()] == [("S.script", "A")]
    members = W.memberships(W.first_masters(parsed))
    assert [r.process for r in W.enabled(procs, members).collect()] == ["A"]
    assert [r.master for r in members.collect()] == ["G##M.config"]
    assert [(r.message, r.files) for r in W.failures(parsed).collect()] == [("not well-formed", 1)]


@pytest.mark.parametrize(
    "raw, want",
    [("169,299 Bytes", "165.3 K"), ("12 Bytes", "12.0 "), ("1023 Bytes", "1023.0 "), ("1024 Bytes", "1.0 K"),
     ("169,216 Bytes", "165.2 K"), ("169,728 Bytes", "165.8 K"), ("1,048,575 Bytes", "1024.0 K"), ("1,048,576 Bytes", "1.0 M")],
)
def test_sizes(spark, raw, want):
    assert spark.range(1).select(H.size_pretty(F.lit(raw)).alias("v")).first()["v"] == want


def test_size_cache(spark):
    log = [("a", "s", "1", True, 1), ("a", "s", "2", True, 2)] + [("b", "s", None, False, i) for i in range(4)] + [("c", "s", None, False, 1)]
    log += [("d", "s", "9", True, 3)] + [("d", "s", None, False, i) for i in (1, 3, 4, 5, 6, 7)]
    log += [("e", "s", "9", True, 9)] + [("e", "s", None, False, i) for i in range(4)]
    got = H.size_cache(spark.createDataFrame(log, "url string, key string, value string, ok boolean, ts int"))
    assert {(r.url, r.value, r.failures) for r in got.collect()} == {
        ("a", "1", 0), ("b", "NA", 4), ("c", "", 1), ("d", "9", 1), ("e", "NA", 4)
    }


def test_file_inventory_tells_path_and_length(spark, tmp_path):
    import os

    from rowflow.sources.streams import file_inventory

    (tmp_path / "deep").mkdir()
    for name, size in (("a.ss", 3), ("deep/b.ss", 0), ("deep/c.ss", 5000), ("d.txt", 9)):
        (tmp_path / name).write_bytes(b"x" * size)
        os.utime(tmp_path / name, (1_600_000_000, 1_600_000_000))
    got = {r.path.split(str(tmp_path))[1]: (r.length, r.age_seconds) for r in file_inventory(spark, str(tmp_path), ".ss").collect()}
    assert {k: n for k, (n, _) in got.items()} == {"/a.ss": 3, "/deep/b.ss": 0, "/deep/c.ss": 5000}
    import time

    assert all(abs(age - (time.time() - 1_600_000_000)) < 600 for _, age in got.values())


def test_disordered_files_are_found(spark, tmp_path):
    from rowflow.sources import sinks

    frames = {"up": [None, 1, 2, 2, 9], "down": [1, 3, 2], "null": [1, None, 2], "one": [5], "nulls": [None, None]}
    for name, values in frames.items():
        spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (row,) = sinks.file_order(spark, f"{tmp_path}/{name}", "v").collect()
        assert (row.rows, row.in_order) == (len(values), name not in ("down", "null"))
    spark.range(0, 300_000).select(F.col("id").alias("v")).coalesce(1).write.option("parquet.block.size", 100_000).parquet(f"{tmp_path}/long")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert [(r.rows, r.in_order) for r in sinks.file_order(spark, f"{tmp_path}/long", "v").collect()] == [(300_000, True)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tasks_of_heavy_work_grow_with_the_rows(spark):
    dealt = lambda n: partitioned(spark.range(9), "id", rows=n).rdd.getNumPartitions()
    assert dealt(0) == dealt(100_000) == 8
    assert dealt(1_000_001) == 11
