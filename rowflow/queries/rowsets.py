"""User-defined rowset operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rowflow.functions import all_of
from rowflow.operators import aggregate as A, joins as J, ordered as O, rowset as R
from rowflow.queries.registry import query, table
from rowflow.session import scratch_path, spread

c = F.col
BY_CUSTOMER_DATE = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def customer_orders(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")


# Customers with more orders than this are cut by day.
HOT = 1_000_000


def by_day():
    return F.date_trunc("day", "o_orderdate")


def net_price(rows: pd.DataFrame) -> pd.DataFrame:
    out = rows[["l_orderkey", "l_linenumber"]].copy()
    out["net"] = rows["l_extendedprice"] * (1 - rows["l_discount"])
    out["bulk"] = rows["l_quantity"] >= 30
    return out


NET_SCHEMA = "l_orderkey bigint, l_linenumber int, net double, bulk boolean"


@query(
    "rs_process",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity >= 30 AS bulk
       FROM lineitem""",
)
def rs_process(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    return R.process(spread(l, "l_orderkey"), net_price, NET_SCHEMA)


@query(
    "rs_process_having",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem
       WHERE l_extendedprice * (1 - l_discount) > 50000""",
)
def rs_process_having(spark, d):
    # Column user code: the HAVING is pushed below the projection by Catalyst.
    return R.process(
        table(spark, d, "lineitem"),
        {
            "l_orderkey": c("l_orderkey"),
            "l_linenumber": c("l_linenumber"),
            "net": c("l_extendedprice") * (1 - c("l_discount")),
        },
        having=c("net") > 50000,
    )


def running_rows(rows: pd.DataFrame) -> pd.DataFrame:
    out = rows[["o_custkey", "o_orderkey"]].copy()
    out["balance"] = rows["cents"].groupby(rows["group"]).cumsum() + rows["before"].fillna(0).astype("int64")
    return out


@query(
    "rs_reduce",
    f"""SELECT o_custkey, o_orderkey, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) OVER
       ({BY_CUSTOMER_DATE} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM orders""",
)
def rs_reduce(spark, d):
    cents = F.round(c("o_totalprice") * 100).cast("long")
    return R.reduce_rows(
        customer_orders(spark, d).select("o_custkey", "o_orderdate", "o_orderkey", cents.alias("cents")),
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        by_day(),
        "o_custkey bigint, o_orderkey bigint, balance bigint",
        running_rows,
        state={"before": O.running_sum(c("cents"))},
        hot_rows=HOT,
    )


@query(
    "rs_reduce_topn",
    """SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER
       (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""",
)
def rs_reduce_topn(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return A.top_per_key(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query(
    "rs_reduce_rank",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity,
         rank() OVER w AS rank, dense_rank() OVER w AS dense_rank
       FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_suppkey DESC)""",
)
def rs_reduce_rank(spark, d):
    l = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    ranked = O.rank(l, ["l_returnflag"], [c("l_quantity"), c("l_suppkey")], descending=True)
    return ranked.drop("l_suppkey")


@query(
    "rs_reduce_sample",
    f"""SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER ({BY_CUSTOMER_DATE}) AS rn FROM orders)
       WHERE (rn - 1) % 3 = 0""",
)
def rs_reduce_sample(spark, d):
    o = customer_orders(spark, d).select("o_custkey", "o_orderdate", "o_orderkey")
    numbered = O.scan(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], by_day(), {"rn": O.row_number()}, HOT)
    return R.every_nth(numbered, "rn", 3).select("o_custkey", "o_orderkey", "rn")


@query(
    "rs_reduce_monotone",
    f"""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER
       ({BY_CUSTOMER_DATE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders)
       WHERE before IS NULL OR o_totalprice >= before""",
)
def rs_reduce_monotone(spark, d):
    seen = O.scan(
        customer_orders(spark, d),
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        by_day(),
        {"before": O.max_before(c("o_totalprice"))},
        HOT,
    )
    keep = c("before").isNull() | (c("o_totalprice") >= c("before"))
    return seen.filter(keep).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "rs_reduce_pack",
    f"""SELECT o_custkey, (rn - 1) // 1000 AS part,
       '[' || string_agg('{{"id":' || o_orderkey || ',"state":"' || o_orderstatus || '"}}', ',' ORDER BY rn) || ']' AS record
       FROM (SELECT *, row_number() OVER ({BY_CUSTOMER_DATE}) AS rn FROM orders) GROUP BY 1, 2""",
)
def rs_reduce_pack(spark, d):
    node = F.struct(c("o_orderkey").alias("id"), c("o_orderstatus").alias("state"))
    lists = A.list_of(
        customer_orders(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], node, by_day(), "record", hot_rows=HOT
    )
    return lists.withColumn("record", F.to_json("record"))


def line_share(rows: pd.DataFrame) -> pd.DataFrame:
    out = rows[["l_orderkey", "l_linenumber", "l_quantity"]].copy()
    out["share"] = rows["l_extendedprice"] / rows["o_totalprice"]
    return out


@query(
    "rs_combine",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / o_totalprice AS share
       FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def rs_combine(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return R.combine(
        l,
        o,
        ["l_orderkey"],
        "l_orderkey bigint, l_linenumber int, l_quantity double, share double",
        line_share,
        {"o_totalprice": F.max("o_totalprice")},
        presort=["l_linenumber"],
    )


def price_steps(orders: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
    step = lines.groupby("key")["l_extendedprice"].diff().abs().groupby(lines["key"]).max()
    return orders.assign(step=orders["key"].map(step))[["key", "o_custkey", "step"]]


@query(
    "rs_combine_steps",
    """SELECT o_orderkey AS key, ANY_VALUE(o_custkey) AS o_custkey, MAX(step) AS step FROM orders LEFT JOIN
         (SELECT l_orderkey, ABS(l_extendedprice - LAG(l_extendedprice) OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_extendedprice)) AS step FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def rs_combine_steps(spark, d):
    """The largest step between the prices of an order's successive lines."""
    o = table(spark, d, "orders").select(c("o_orderkey").alias("key"), "o_custkey")
    l = table(spark, d, "lineitem").select(c("l_orderkey").alias("key"), "l_linenumber", "l_extendedprice")
    return R.combine_rows(
        o, l, ["key"], "key bigint, o_custkey bigint, step double", price_steps, right_presort=["l_linenumber", "l_extendedprice"]
    )


def name_lines(rows: pd.DataFrame) -> pd.DataFrame:
    return rows[["l_suppkey", "l_orderkey", "l_linenumber", "s_name"]]


@query(
    "rs_combine_presort",
    "SELECT l_suppkey, l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey",
)
def rs_combine_presort(spark, d):
    l = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), "s_name")
    return R.combine(
        l,
        s,
        ["l_suppkey"],
        "l_suppkey bigint, l_orderkey bigint, l_linenumber int, s_name string",
        name_lines,
        {"s_name": F.min("s_name")},
    )


@query(
    "rs_combine_tfidf",
    """WITH tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, UNNEST(string_split(text, ' ')) AS term FROM documents)
         WHERE term <> '' GROUP BY 1, 2),
       df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1), n AS (SELECT COUNT(*) AS n FROM documents)
       SELECT doc_id, term, round(tf * ln(n::DOUBLE / df), 6) AS score FROM tf JOIN df USING (term), n""",
)
def rs_combine_tfidf(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    # Read twice, for the counts by term and for the scores: the texts are split once.
    path = scratch_path(spark, "term-counts")
    A.item_counts(spread(docs, "doc_id"), "doc_id", F.array_remove(F.split("text", " "), ""), "term", "tf").write.parquet(path)
    tf = spark.read.parquet(path)
    used_in = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = J.attach_rows(used_in, docs.agg(F.count(F.lit(1)).alias("n")), max_rows=1)
    score = c("tf") * F.ln(c("n").cast("double") / c("df"))
    return tf.join(df, "term").select("doc_id", "term", F.round(score, 6).alias("score"))


@query(
    "rs_partition_lookup",
    """WITH w AS (SELECT (MAX(o_orderkey) + (SELECT COUNT(*) FROM supplier)) // (SELECT COUNT(*) FROM supplier) AS w FROM orders)
       SELECT o_orderkey, s_suppkey AS stripe FROM orders, w JOIN supplier
       ON o_orderkey >= s_suppkey * w AND o_orderkey < (s_suppkey + 1) * w""",
)
def rs_partition_lookup(spark, d):
    o, s = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "supplier")
    stripes = s.count()
    width = (o.agg(F.max("o_orderkey")).first()[0] + stripes) // stripes
    ranges = s.select(
        c("s_suppkey").alias("stripe"), (c("s_suppkey") * width).alias("lo"), ((c("s_suppkey") + 1) * width).alias("hi")
    )
    return J.range_lookup(o, c("o_orderkey"), ranges, "lo", "hi", width).select("o_orderkey", "stripe")
