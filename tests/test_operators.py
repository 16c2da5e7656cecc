"""Operators on small fixtures: skew, cycles, ties, empty input, nulls, and plan shape."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from rowflow.operators import aggregate as A, graph as G, joins as J, ordered as O, rowset as R, setops as S
from rowflow.operators.closest import closest_process, nearest
from rowflow.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a null key, ties and nulls in the value."""
    rng = random.Random(1)
    rows = [(0 if i % 3 == 0 else rng.choice([1, 2, 3, None]), i, rng.randint(0, 40), rng.choice([None, 5, 7, 9])) for i in range(900)]
    return spark.createDataFrame(rows, "k int, pos int, v int, w int").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("hot_rows", [None, 200, 10_000])
def test_scans_equal_plain_windows(skewed, hot_rows):
    w = Window.partitionBy("k").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    through = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = O.scan(
        skewed, ["k"], ["pos"], F.floor(F.col("pos") / 50),
        {"n": O.row_number(), "s": O.running_sum(F.col("w")), "m": O.max_before(F.col("v")), "l": O.last_before(F.col("w")),
         "t": O.group_total(F.col("v"))},
        hot_rows,
    )
    want = skewed.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.sum("w").over(through).alias("s"),
        F.max("v").over(before).alias("m"), F.last("w", ignorenulls=True).over(before).alias("l"),
        F.sum("v").over(Window.partitionBy("k")).alias("t"),
    )
    same(got, want)


def test_rank_with_blocks_of_two_columns(skewed):
    order = [F.col("v"), F.col("w")]
    rows = skewed.filter(F.col("w").isNotNull())
    got = O.rank(rows, ["k"], order, F.struct("v", F.floor(F.col("w") / 6).alias("s")), descending=True)
    w = Window.partitionBy("k").orderBy(*[c.desc() for c in order])
    same(got, rows.select("*", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense_rank")))


@pytest.mark.parametrize("descending", [False, True])
def test_rank_equals_plain_window(skewed, descending):
    v = F.col("v").desc() if descending else F.col("v").asc()
    w = Window.partitionBy("k").orderBy(v)
    got = O.rank(skewed, ["k"], [F.col("v")], F.floor(F.col("v") / 7), descending=descending)
    same(got, skewed.select("*", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense_rank")))


@pytest.mark.parametrize("descending", [False, True])
def test_rank_by_range(spark, skewed, descending):
    """Ties and nulls; and one key that has only distinct values, which lies in several ranges."""
    turn = (lambda x: x.desc()) if descending else (lambda x: x.asc())
    one = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("v"), (F.col("id") % 7).alias("w"))
    more = spark.createDataFrame([(None, 1, None), (None, 1, None), (None, None, 2), ("z", 3, 3)], "k string, v long, w long")
    for rows in (skewed, one.unionByName(more), one.limit(0)):
        w = Window.partitionBy("k").orderBy(turn(F.col("v")), turn(F.col("w")))
        got = O.rank(rows, ["k"], [F.col("v"), F.col("w")], descending=descending)
        same(got, rows.select("*", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense_rank")))
    cells = O.rank(one, ["k"], [F.col("v")], descending=descending)
    assert cells.filter(F.col("rank") != (20_000 - F.col("v") if descending else F.col("v") + 1)).isEmpty()


def test_quantile_blocks_follow_the_order(skewed):
    block = O.quantile_block(skewed, "pos", 8)
    sizes = skewed.groupBy(block.alias("b")).agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rows = sizes.orderBy("b").collect()
    assert len(rows) == 8 and max(r.n for r in rows) < 200
    assert all(a.hi < b.lo for a, b in itertools.pairwise(rows))


def test_over_partition_keeps_null_keys(skewed):
    got = A.over_partition(skewed, ["k"], {"c": F.count("*")})
    same(got, skewed.select("*", F.count("*").over(Window.partitionBy("k")).alias("c")))


def test_list_is_cut_in_parts(skewed):
    rows = A.list_of(skewed, ["k"], ["pos"], F.col("pos"), F.floor(F.col("pos") / 100), "items", chunk=64)
    got = {}
    for r in rows.orderBy("k", "part").collect():
        assert len(r["items"]) <= 64
        got.setdefault(r.k, []).extend(r["items"])
    want = {}
    for r in skewed.orderBy("pos").collect():
        want.setdefault(r.k, []).append(r.pos)
    assert got == want


def test_others_in_group_equals_self_join(skewed):
    df = skewed.filter(F.col("k").isNotNull()).select("k", (F.col("pos") % 5).alias("p"), F.coalesce("w", F.lit(0)).alias("w"))
    got = A.others_in_group(df, "k", "p", F.floor(F.col("p") / 2), {"w": "w"})
    l, r = df.select("k", "p").distinct().alias("l"), df.alias("r")
    want = l.join(r, (F.col("l.k") == F.col("r.k"))).groupBy("l.k", "l.p").agg(
        F.count_if(F.col("r.p") == F.col("l.p")).alias("rows"),
        F.count_if(F.col("r.p") != F.col("l.p")).alias("others"),
        F.count_if(F.col("r.p") < F.col("l.p")).alias("above"),
        F.sum(F.when(F.col("r.p") != F.col("l.p"), F.col("r.w"))).alias("w"),
    )
    same(got, want)


def test_reduce_blocks_over_batches(spark, skewed):
    """Blocks longer than one Arrow batch reach the user code whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        seen = R.reduce_rows(
            skewed.select("k", "pos", "v"), ["k"], ["pos"], F.floor(F.col("pos") / 200), "k int, pos int, s long",
            lambda rows: pd.DataFrame(
                {"k": rows["k"], "pos": rows["pos"], "s": rows.groupby("group")["v"].cumsum() + rows["seed"].fillna(0)}
            ),
            state={"seed": O.running_sum(F.col("v"))},
        )
        through = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        same(seen, skewed.select("k", "pos", F.sum("v").over(through).alias("s")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_combine_reduces_a_hot_right_side(spark, skewed):
    left = skewed.select("k", "pos").filter(F.col("k").isNotNull())
    got = R.combine(
        left, skewed, ["k"], "k int, pos int, s long", lambda rows: rows[["k", "pos", "s"]], {"s": F.sum("v")}, presort=["pos"]
    )
    same(got, left.join(skewed.groupBy("k").agg(F.sum("v").alias("s")), "k").select("k", "pos", "s"))


def test_combine_sees_the_right_rows(spark, skewed):
    def spans(left, right):
        high, low = right.groupby("k")["v"].max(), right.groupby("k")["v"].min()
        return left.assign(span=left["k"].map(high - low).astype("Int64"))[["k", "pos", "span"]]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        left = skewed.select("k", "pos")
        got = R.combine_rows(left, skewed, ["k"], "k int, pos int, span long", spans, presort=["pos"], right_presort=["pos"])
        right = skewed.groupBy("k").agg((F.max("v") - F.min("v")).alias("span"))
        same(got, left.join(right, "k", "left").select("k", "pos", "span"))
        empty = R.combine_rows(left, skewed.limit(0), ["k"], "k int, pos int, span long", spans)
        same(empty, left.select("k", "pos", F.lit(None).cast("long").alias("span")))
        assert R.combine_rows(left.limit(0), skewed, ["k"], "k int, pos int, span long", spans).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_combine_splits_a_hot_key_in_blocks(spark, skewed):
    """Each left row's value before it; the last right row of a block also goes to the next."""

    def before(left, right):
        right = right.drop_duplicates(["k", "pos"]).assign(prev=lambda r: r.groupby("k")["v"].shift())
        return left.merge(right[["k", "pos", "prev"]], how="left", on=["k", "pos"]).astype({"prev": "Int64"})

    rows = skewed.filter("k IS NOT NULL").select("k", "pos", F.col("v").cast("long").alias("v")).dropDuplicates(["k", "pos"])
    last = rows.groupBy("k", F.floor(F.col("pos") / 50).alias("b")).agg(F.max("pos").alias("pos"))
    after = last.select("k", "pos", F.lead("b").over(Window.partitionBy("k").orderBy("b")).alias("next"))
    marked = rows.join(after, ["k", "pos"], "left").select(
        "k", "pos", "v", F.array_compact(F.array(F.floor(F.col("pos") / 50), "next")).alias("need")
    )
    left = rows.select("k", "pos")
    got = R.combine_rows(
        left, marked, ["k"], "k int, pos int, prev long", before, ["pos"], ["pos"], (F.floor(F.col("pos") / 50), F.col("need"))
    )
    same(got, rows.select("k", "pos", F.lag("v").over(Window.partitionBy("k").orderBy("pos")).alias("prev")))


# ---- joins -------------------------------------------------------------------------------


def test_attach_rows(spark):
    facts = spark.range(3)
    assert J.attach_rows(facts, spark.range(2).toDF("c")).count() == 6
    assert J.attach_rows(facts, spark.range(0).toDF("c")).count() == 0
    wide = J.attach_rows(facts, spark.range(50).toDF("c"), max_rows=4)
    assert sorted(map(tuple, wide.collect())) == [(i, j) for i in range(3) for j in range(50)]
    assert "CartesianProduct" not in plan(wide) and "NestedLoop" not in plan(wide)
    assert "Join" not in plan(J.attach_rows(facts, spark.range(1).toDF("c")))


def test_not_in_with_nulls(spark):
    keys = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    frame = lambda vs: spark.createDataFrame([(v,) for v in vs], "v int")
    for values, want in (([], [1, 2, None]), ([2], [1]), ([2, None], []), ([None], []), ([7, 7], [1, 2])):
        got = J.not_in(keys, F.col("k"), frame(values))
        assert got.columns == ["k"] and sorted((r.k for r in got.collect()), key=str) == sorted(want, key=str)


def test_whole_lists(spark):
    rows = spark.createDataFrame([(i % 2, i, f"v{i}") for i in range(5000)], "k int, pos int, v string")
    got = {r.k: r["items"] for r in A.list_of(rows, ["k"], ["pos"], F.col("v"), F.lit(0)).collect()}
    assert got == {k: [f"v{i}" for i in range(k, 5000, 2)] for k in (0, 1)}


def test_range_lookup_edges(spark):
    ranges = spark.createDataFrame([("a", 0, 10), ("b", 10, 35), ("none", 5, 5)], "name string, lo long, hi long")
    keys = spark.createDataFrame([(0,), (9,), (10,), (34,), (35,), (-1,)], "k long")
    got = J.range_lookup(keys, F.col("k"), ranges, "lo", "hi", 7)
    assert {(r.k, r.name) for r in got.collect()} == {(0, "a"), (9, "a"), (10, "b"), (34, "b")}


def test_broadcast_hint_only_within_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        l, r = spark.range(100).toDF("a"), spark.range(50).toDF("b")
        assert "BroadcastHashJoin" in plan(J.broadcast_right(l, r, l.a == r.b, max_rows=50))
        assert "BroadcastHashJoin" not in plan(J.broadcast_right(l, r, l.a == r.b, max_rows=49))
        assert "BroadcastHashJoin" not in plan(J.broadcast_right(l, r, l.a == r.b, max_bytes=1000))
        assert "ShuffledHashJoin" in plan(J.hash_join(l, r, l.a == r.b))
        assert "ShuffledHashJoin" not in plan(J.hash_join(l, r, l.a == r.b, max_rows=49))
        assert "ShuffledHashJoin" not in plan(J.hash_join(l, r, l.a == r.b, max_bytes=1000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---- plan shape --------------------------------------------------------------------------


def test_top_n_is_one_operator(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_n"](spark, FOLDER))


def test_metrics_scan_once(spark):
    assert plan(QUERIES["agg_tagged_metrics"](spark, FOLDER)).count("FileScan") == 1


def test_top_per_key_trims_before_the_shuffle(spark):
    text = plan(QUERIES["rs_reduce_topn"](spark, FOLDER))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["src_sstream"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_in_any_plan(spark, name):
    """Of the frame that is returned; some queries run jobs while it is built."""
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


# ---- graph -------------------------------------------------------------------------------


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], "src string, dst string")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def pairs(df):
    return {">".join(r) for r in df.collect()}


def test_trace_on_a_cycle(spark):
    g = edges(spark, "a>b b>c c>a c>d x>a y>z a>b")
    below, walked = G.trace(g, names(spark, "b", "nowhere"), "down")
    assert {r.name for r in below.collect()} == {"a", "b", "c", "d"}
    assert pairs(walked) == {"a>b", "b>c", "c>a", "c>d"}
    _, above = G.trace(g, names(spark, "d"), "up")
    assert pairs(above) == {"a>b", "b>c", "c>a", "c>d", "x>a"}


def test_trace_target_without_out_edges_still_walks_up(spark):
    nodes, walked = G.trace(edges(spark, "a>b b>c q>r"), names(spark, "c"), "both")
    assert pairs(walked) == {"a>b", "b>c"}
    assert {r.name for r in nodes.collect()} == {"a", "b", "c"}


def test_trace_long_chain(spark):
    chain = " ".join(f"n{i:02d}>n{i + 1:02d}" for i in range(12))
    assert G.trace(edges(spark, chain), names(spark, "n00"), "down")[1].count() == 12


def test_trace_leaves_stored_links_in_place(spark):
    """The join of a level shuffles neither the links nor the visited nodes."""
    store = G.Stored(spark)
    try:
        links = store.write(edges(spark, " ".join(f"n{i}>n{i + 1}" for i in range(50))), "src")
        seen = store.write(names(spark, "n3", "n9"), "name")
        plan = links.join(seen.hint("merge"), F.col("src") == seen["name"], "left_semi")
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        store.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in store.names]


def test_trace_of_nothing(spark):
    nodes, walked = G.trace(edges(spark, "a>b"), names(spark, "zz"), "both")
    assert nodes.count() == 0 and walked.count() == 0


def test_contract(spark):
    rows = [("s1", "SCRIPT", "e1", "EVENT"), ("e1", "EVENT", "s2", "SCRIPT"), ("e1", "EVENT", "s3", "SCRIPT"),
            ("s2", "SCRIPT", "e2", "EVENT"), ("r", "EVENT", "s1", "SCRIPT"), ("e1", "EVENT", "s2", "SCRIPT"),
            ("alone", "SCRIPT", "e3", "EVENT")]
    nodes, got = G.contract(spark.createDataFrame(rows, "src string, src_type string, dst string, dst_type string"))
    assert pairs(got) == {"s1>s2", "s1>s3", "r>s1"}
    assert sorted(r.name for r in nodes.collect()) == ["alone", "r", "s1", "s2", "s3"]
    assert plan(got).split("Initial Plan")[0].count("Scan ") <= 4


# ---- closest names -----------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("chunk", [2000, 30])
def test_nearest_equals_brute_force(spark, chunk):
    """With a small chunk the catalog counts as large: deletions first, then array chunks."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    catalog, keys = sorted({word() for _ in range(120)}), sorted({word() for _ in range(60)} | {"zzzzzzzz", ""})
    frame = lambda vs, c: spark.createDataFrame([(v,) for v in vs], f"{c} string")
    got = {r.key: (r.distance, r.name) for r in nearest(frame(keys, "key"), frame(catalog, "name"), chunk).collect()}
    assert got == {k: min((distance(k, n), n) for n in catalog) for k in keys}


def test_nearest_far_away(spark):
    """Keys many edits from every name: found by pieces, and with names shorter than the edits."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    catalog = sorted({word(rng.randint(8, 24)) for _ in range(150)} | {"same start " + word(6) for _ in range(60)} | {"x", ""})
    keys = [word(20) for _ in range(8)] + ["same start", "yyyyyy", catalog[5][2:-4] + "zz", "", "q" * 40]
    frame = lambda vs, c: spark.createDataFrame([(v,) for v in [*vs, None]], f"{c} string")
    got = {r.key: (r.distance, r.name) for r in nearest(frame(keys, "key"), frame(catalog, "name"), 40).collect()}
    assert got == {k: min((distance(k, n), n) for n in catalog) for k in keys}
    assert nearest(frame(keys, "key"), frame([], "name"), 40).count() == 0


def test_closest_stages(spark):
    procs = spark.createDataFrame([("Alpha",), ("Beta",), ("Bets",)], "process string")
    scripts = spark.createDataFrame([("MPIPrepare3.script", "Alpha"), ("Other.script", "Beta")], "script string, process string")
    keys = spark.createDataFrame([("Beta",), ("Other.script",), ("MPIPrepare.script",), ("Bete",), ("q",)], "key string")
    got = {r.key: (r.process, r.stage) for r in closest_process(keys, procs, scripts).collect()}
    assert got == {
        "Beta": ("Beta", "exact"), "Other.script": ("Beta", "script"), "MPIPrepare.script": ("Alpha", "stem"),
        "Bete": ("Beta", "nearest"), "q": ("q", "none"),
    }


def test_set_operators_match_by_position(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "x int, y int")
    b = spark.createDataFrame([(1, 2)], "p int, q int")
    assert S.union_all(a, b).count() == 4
    assert S.union_distinct(a, b).count() == 2
    assert {tuple(r) for r in S.except_distinct(a, b).collect()} == {(3, 4)}
    assert sorted(map(tuple, S.except_all(a, b).collect())) == [(1, 2), (3, 4)]


def test_items_are_counted_in_their_row(spark):
    """Keys with one row are counted without a shuffle of items; repeated and null keys are summed."""
    items = {1: ["b", "a", "b"], 2: [], 3: None, 4: ["x", None, "x", "", None]}
    once = spark.createDataFrame(list(items.items()), "k int, items array<string>")
    got = A.item_counts(once, "k", F.col("items"), "item", "n")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "b", 2), (4, "", 1), (4, "x", 2)]
    assert "Exchange" not in plan(got)
    rows = [*items.items(), (1, ["a", "c"]), (None, ["a", "a"]), (None, ["a"]), (5, ["a"])]
    many = spark.createDataFrame(rows, "k int, items array<string>")
    got = sorted(map(tuple, A.item_counts(many, "k", F.col("items"), "item", "n").collect()), key=str)
    assert got == sorted([(1, "a", 2), (1, "b", 2), (1, "c", 1), (4, "", 1), (4, "x", 2), (5, "a", 1), (None, "a", 3)], key=str)
