"""Projection, filter, join, aggregation, window and set-operator queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rowflow.functions import all_of, iff, literal
from rowflow.operators import aggregate as A, joins as J, setops as S
from rowflow.queries.registry import query, table
from rowflow.session import spread

MONEY = "decimal(18,2)"


def money(name: str):
    return F.col(name).cast(MONEY)


def total(name: str):
    """Exact sum of a money column, given as double."""
    return F.sum(money(name)).cast("double")


# ---- projection and filter ---------------------------------------------------------------


@query(
    "prj_star_plus",
    "SELECT o.*, o.o_totalprice * 2 AS doubled, o.o_orderstatus AS status FROM orders o",
)
def prj_star_plus(spark, d):
    o = table(spark, d, "orders").alias("o")
    return o.select("o.*", (F.col("o.o_totalprice") * 2).alias("doubled"), F.col("o.o_orderstatus").alias("status"))


@query("prj_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def prj_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query(
    "flt_compare",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
       WHERE (l_quantity >= 10 AND l_quantity < 40 AND l_discount <= 0.05)
          OR (l_returnflag = 'R' AND l_linestatus <> 'O' AND l_tax > 0.02)""",
)
def flt_compare(spark, d):
    c = F.col
    return (
        table(spark, d, "lineitem")
        .filter(
            ((c("l_quantity") >= 10) & (c("l_quantity") < 40) & (c("l_discount") <= 0.05))
            | ((c("l_returnflag") == "R") & (c("l_linestatus") != "O") & (c("l_tax") > 0.02))
        )
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    )


@query(
    "flt_in_list",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def flt_in_list(spark, d):
    o = table(spark, d, "orders")
    return o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query(
    "flt_not_in_params",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('P', 'F')",
)
def flt_not_in_params(spark, d):
    return spark.sql(
        "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus NOT IN (:first, :second)",
        args={"first": "P", "second": "F"},
        orders=table(spark, d, "orders"),
    )


@query(
    "flt_in_subquery",
    """SELECT c_custkey, c_name FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
)
def flt_in_subquery(spark, d):
    big = table(spark, d, "orders").filter(F.col("o_totalprice") > 400000).select("o_custkey")
    c = table(spark, d, "customer")
    return J.semi(c, big, c.c_custkey == big.o_custkey).select("c_custkey", "c_name")


NOT_IN_KEY = "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey END"
NOT_IN_LISTS = {
    "plain": "SELECT o_custkey FROM orders WHERE o_totalprice > 400000",
    "nulls": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders WHERE o_totalprice > 400000",
    "empty": "SELECT o_custkey FROM orders WHERE o_totalprice < 0",
}


@query(
    "flt_not_in_subquery",
    " UNION ALL ".join(
        f"SELECT '{name}' AS list, c_custkey, c_name FROM customer WHERE {NOT_IN_KEY} NOT IN ({listed})" for name, listed in NOT_IN_LISTS.items()
    ),
)
def flt_not_in_subquery(spark, d):
    """Null keys against a list without nulls, one with nulls and an empty one."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    big = o.filter(F.col("o_totalprice") > 400000)
    lists = {
        "plain": big.select("o_custkey"),
        "nulls": big.select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey")),
        "empty": o.filter(F.col("o_totalprice") < 0).select("o_custkey"),
    }
    key = F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey"))
    return reduce(DataFrame.unionAll, (J.not_in(c, key, x).select(F.lit(n).alias("list"), "c_custkey", "c_name") for n, x in lists.items()))


@query(
    "flt_all_of",
    "SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND p_retailprice < 1500 AND p_type IN ('ECONOMY', 'STANDARD')",
)
def flt_all_of(spark, d):
    tests = all_of(F.col("p_size") > 10, F.col("p_retailprice") < 1500, F.col("p_type").isin("ECONOMY", "STANDARD"))
    return table(spark, d, "part").filter(tests).select("p_partkey", "p_name")


@query(
    "flt_not",
    "SELECT doc_id, lang, n_chars FROM documents WHERE NOT (lang = 'en' AND n_chars < 1000)",
)
def flt_not(spark, d):
    keep = ~((F.col("lang") == "en") & (F.col("n_chars") < 1000))
    return table(spark, d, "documents").filter(keep).select("doc_id", "lang", "n_chars")


@query(
    "flt_null_after_outer",
    """SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o
       ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL OR o.o_totalprice > 400000""",
)
def flt_null_after_outer(spark, d):
    """Customers without a dear order, and those with a very dear one: an outer join and a test of its nulls."""
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").filter(F.col("o_totalprice") > 300000)
    both = c.join(o, c.c_custkey == o.o_custkey, "left")
    return both.filter(F.col("o_orderkey").isNull() | (F.col("o_totalprice") > 400000)).select("c_custkey", "o_orderkey")


@query(
    "prj_inner_select",
    """SELECT status, tag, COUNT(*) AS n, CAST(SUM(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM (SELECT o_orderstatus AS status, 'urgent' AS tag, o_totalprice AS price FROM orders WHERE o_orderpriority = '1-URGENT'
             UNION ALL SELECT l_linestatus, 'line', l_extendedprice FROM (SELECT * FROM lineitem WHERE l_quantity > 25) x WHERE l_discount < 0.05
             UNION ALL SELECT * FROM (SELECT o_orderstatus, 'high', o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH') y)
       GROUP BY status, tag""",
)
def prj_inner_select(spark, d):
    """A union of inner selects over two tables, one of them nested again."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    by = lambda p, tag: o.filter(F.col("o_orderpriority") == p).select(
        F.col("o_orderstatus").alias("status"), F.lit(tag).alias("tag"), F.col("o_totalprice").alias("price")
    )
    lines = li.filter(F.col("l_quantity") > 25).filter(F.col("l_discount") < 0.05).select("l_linestatus", F.lit("line"), "l_extendedprice")
    inner = by("1-URGENT", "urgent").unionAll(lines).unionAll(by("2-HIGH", "high"))
    return inner.groupBy("status", "tag").agg(F.count(F.lit(1)).alias("n"), total("price").alias("total"))


@query(
    "prj_literals",
    """SELECT c_custkey, CAST(0 AS BIGINT) AS above_cnt, CAST(7 AS DOUBLE) AS uid,
       CAST(1.5 AS DOUBLE) AS amount, CAST(0.5 AS FLOAT) AS rate, 'tag' AS tag FROM customer""",
)
def prj_literals(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey",
        literal(0, "L").alias("above_cnt"),
        literal(7, "UL").cast("double").alias("uid"),
        literal(1.5, "M").cast("double").alias("amount"),
        literal(0.5, "F").alias("rate"),
        F.lit("tag").alias("tag"),
    )


@query("prj_bool_col", "SELECT c_custkey, c_acctbal < 0 AS in_debt, c_nationkey = 0 AS first_nation FROM customer")
def prj_bool_col(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", (F.col("c_acctbal") < 0).alias("in_debt"), (F.col("c_nationkey") == 0).alias("first_nation")
    )


@query(
    "prj_param_sql",
    """SELECT o_orderkey, o_totalprice * 1.5 AS scaled, 'batch-7' AS batch FROM orders
       WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderpriority = '5-LOW'""",
)
def prj_param_sql(spark, d):
    return spark.sql(
        """SELECT o_orderkey, o_totalprice * :factor AS scaled, :batch AS batch FROM {orders}
           WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) AND o_orderpriority = :priority""",
        args={"factor": 1.5, "batch": "batch-7", "since": "1997-01-01", "priority": "5-LOW"},
        orders=table(spark, d, "orders"),
    )


# ---- joins -------------------------------------------------------------------------------


@query(
    "join_inner",
    "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
)
def join_inner(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


@query(
    "join_self_theta",
    """SELECT l.l_orderkey, l.l_linenumber, COUNT(DISTINCT l.rid) AS rows,
              COUNT(r.rid) // COUNT(DISTINCT l.rid) AS others,
              SUM(CASE WHEN r.l_linenumber < l.l_linenumber THEN 1 ELSE 0 END)::BIGINT // COUNT(DISTINCT l.rid) AS above,
              CAST(SUM(CAST(COALESCE(r.l_quantity, 0) AS BIGINT)) // COUNT(DISTINCT l.rid) AS BIGINT) AS other_qty
       FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) l
       LEFT JOIN (SELECT *, row_number() OVER () AS rid FROM lineitem) r
         ON l.l_orderkey = r.l_orderkey AND l.l_linenumber <> r.l_linenumber
       GROUP BY l.l_orderkey, l.l_linenumber""",
)
def join_self_theta(spark, d):
    l = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q")
    )
    whole = A.others_in_group(l, "l_orderkey", "l_linenumber", F.floor(F.col("l_linenumber") / 1000), {"other_qty": "q"})
    return whole.withColumn("other_qty", F.coalesce("other_qty", F.lit(0)))


@query(
    "join_left",
    """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders
       ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'""",
)
def join_left(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query(
    "join_right",
    """SELECT c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')
       RIGHT JOIN orders ON c_custkey = o_custkey""",
)
def join_right(spark, d):
    c = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    o = table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "right").select("c_name", "o_orderkey")


@query(
    "join_full",
    """SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')
       FULL OUTER JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey""",
)
def join_full(spark, d):
    c = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    o = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    return c.join(o, c.c_custkey == o.o_custkey, "full").select("c_custkey", "o_orderkey")


def region_revenue(spark, d):
    """Revenue and orders by region and status, over the whole star."""
    l = table(spark, d, "lineitem")
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    # Exact in whole units: hundredths of the price times hundredths of what is left to pay.
    # Lines are reduced to one row per order before the joins; an order has one customer.
    units = F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
    per_order = l.groupBy("l_orderkey").agg(F.sum(units).alias("units"), F.count(F.lit(1)).alias("lines"))
    joined = (
        per_order.join(o, per_order.l_orderkey == o.o_orderkey)
        .join(c, F.col("o_custkey") == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .join(r, F.col("n_regionkey") == r.r_regionkey)
    )
    return A.implicit_group(
        joined,
        {"region": F.col("r_name"), "status": F.col("o_orderstatus")},
        {
            "revenue": (F.sum(F.col("units").cast("decimal(20,0)")) / 10000).cast("double"),
            "lines": F.sum("lines"),
            "orders": F.count(F.lit(1)),
        },
        having=F.col("orders") > 5,
    )


query(
    "join_multiway",
    """SELECT r_name AS region, o_orderstatus AS status,
              CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
              COUNT(*) AS lines, COUNT(DISTINCT o_orderkey) AS orders
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       GROUP BY r_name, o_orderstatus HAVING COUNT(DISTINCT o_orderkey) > 5""",
)(region_revenue)


@query(
    "join_semi",
    "SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
)
def join_semi(spark, d):
    o = table(spark, d, "orders")
    l = table(spark, d, "lineitem").filter(F.col("l_quantity") > 45)
    return J.semi(o, l, o.o_orderkey == l.l_orderkey)


@query(
    "join_anti",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
def join_anti(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return J.semi(c, o, c.c_custkey == o.o_custkey, anti=True).select("c_custkey", "c_name")


@query(
    "join_right_semi",
    "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09)",
)
def join_right_semi(spark, d):
    s = table(spark, d, "supplier")
    l = table(spark, d, "lineitem").filter(F.col("l_discount") > 0.09)
    return J.right_semi(l, s, l.l_suppkey == s.s_suppkey).select("s_suppkey", "s_name")


@query(
    "join_right_anti",
    "SELECT s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)",
)
def join_right_anti(spark, d):
    s = table(spark, d, "supplier")
    l = table(spark, d, "lineitem").filter((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.09))
    return J.right_semi(l, s, l.l_suppkey == s.s_suppkey, anti=True).select("s_suppkey", "s_name")


@query(
    "join_cross",
    """SELECT o_orderkey, o_totalprice / regions AS share, top_region
       FROM orders, (SELECT COUNT(*) AS regions, MAX(r_name) AS top_region FROM region)""",
)
def join_cross(spark, d):
    config = table(spark, d, "region").agg(F.count(F.lit(1)).alias("regions"), F.max("r_name").alias("top_region"))
    each = J.attach_rows(table(spark, d, "orders"), config, max_rows=1)
    return each.select("o_orderkey", (F.col("o_totalprice") / F.col("regions")).alias("share"), "top_region")


@query(
    "join_cross_apply",
    """SELECT vec_id, pos, v FROM (SELECT vec_id, UNNEST(embedding) AS v,
       UNNEST(range(len(embedding))) AS pos FROM embeddings) WHERE v > 0""",
)
def join_cross_apply(spark, d):
    each = J.cross_apply(table(spark, d, "embeddings"), F.col("embedding"), "v", position="p")
    return each.filter(F.col("v") > 0).select("vec_id", F.col("p").cast("long").alias("pos"), "v")


@query(
    "join_cross_apply_words",
    """SELECT doc_id, word, COUNT(*) AS n FROM (SELECT doc_id, UNNEST(string_split(text, ' ')) AS word FROM documents)
       WHERE word <> '' GROUP BY doc_id, word""",
)
def join_cross_apply_words(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    each = J.cross_apply(docs, F.split("text", " "), "word")
    return each.filter(F.col("word") != "").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_pair",
    """SELECT l_orderkey, l_linenumber, p_name, l_quantity * p_size AS score
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def join_pair(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    joined = J.hash_join(l, p, l.l_partkey == p.p_partkey)
    return joined.select("l_orderkey", "l_linenumber", "p_name", (F.col("l_quantity") * F.col("p_size")).alias("score"))


@query(
    "join_hint_broadcast",
    "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
)
def join_hint_broadcast(spark, d):
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    joined = J.broadcast_right(l, s, l.l_suppkey == s.s_suppkey)
    return joined.select("l_orderkey", "l_linenumber", "s_name")


@query(
    "join_on_all",
    """SELECT o_orderkey, l_linenumber, l_shipdate FROM orders JOIN lineitem
       ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND o_orderstatus = 'F'""",
)
def join_on_all(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    on = all_of(o.o_orderkey == l.l_orderkey, l.l_shipdate > o.o_orderdate, o.o_orderstatus == "F")
    return o.join(l, on).select("o_orderkey", "l_linenumber", "l_shipdate")


# ---- aggregation -------------------------------------------------------------------------


@query(
    "agg_implicit",
    """SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
       COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def agg_implicit(spark, d):
    return A.implicit_group(
        table(spark, d, "lineitem"),
        {"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus")},
        {"qty": F.sum(F.col("l_quantity").cast("long")), "n": F.count(F.lit(1))},
    )


@query(
    "agg_basic",
    """SELECT o_orderpriority, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
              ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice), 4) AS mean,
              MAX(o_totalprice) AS hi, MIN(o_totalprice) AS lo, COUNT(o_totalprice) AS n
       FROM orders GROUP BY o_orderpriority""",
)
def agg_basic(spark, d):
    mean = F.round(total("o_totalprice") / F.count("o_totalprice"), 4)
    return A.implicit_group(
        table(spark, d, "orders"),
        {"o_orderpriority": F.col("o_orderpriority")},
        {
            "total": total("o_totalprice"),
            "mean": mean,
            "hi": F.max("o_totalprice"),
            "lo": F.min("o_totalprice"),
            "n": F.count("o_totalprice"),
        },
    )


@query("agg_count_star", "SELECT COUNT(*) AS n FROM events")
def agg_count_star(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_count_distinct",
    "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type",
)
def agg_count_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query(
    "agg_first",
    """SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority,
       MIN(o_orderdate) AS first_date FROM orders GROUP BY o_custkey""",
)
def agg_first(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        A.first_of(F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")).alias("first_priority"),
        F.min("o_orderdate").alias("first_date"),
    )


@query(
    "agg_ratio",
    """SELECT l_returnflag,
       ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE)
             / CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE), 8) AS ratio
       FROM lineitem GROUP BY l_returnflag""",
)
def agg_ratio(spark, d):
    price, disc = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    ratio = F.sum(price * disc).cast("double") / F.sum(price).cast("double")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(ratio, 8).alias("ratio"))


@query(
    "agg_conditional",
    """SELECT l_suppkey, COUNT(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS deep,
       COUNT(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_suppkey""",
)
def agg_conditional(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(all_of(F.col("l_quantity") > 25, F.col("l_discount") > 0.05)).alias("deep"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )


@query(
    "agg_having",
    "SELECT l_orderkey, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 150",
)
def agg_having(spark, d):
    return A.implicit_group(
        table(spark, d, "lineitem"),
        {"l_orderkey": F.col("l_orderkey")},
        {"n": F.count(F.lit(1)), "qty": F.sum(F.col("l_quantity").cast("long"))},
        having=F.col("qty") > 150,
    )


@query(
    "agg_list",
    """SELECT o_custkey, (rn - 1) // 1000 AS part, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS orders
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
       GROUP BY 1, 2""",
)
def agg_list(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    block = F.floor(F.col("o_orderkey") / 1_000_000)
    text = F.col("o_orderkey").cast("string")
    lists = A.list_of(o, ["o_custkey"], ["o_orderkey"], text, block, "orders", hot_rows=1_000_000)
    return lists.withColumn("orders", F.array_join("orders", ","))


@query(
    "agg_list_whole",
    "SELECT o_orderstatus, COUNT(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY o_orderstatus",
)
def agg_list_whole(spark, d):
    """Lists of thousands of items, each in one row."""
    lists = A.list_of(table(spark, d, "orders"), ["o_orderstatus"], ["o_orderdate", "o_orderkey"], F.col("o_orderkey").cast("string"), F.lit(0))
    return lists.select("o_orderstatus", F.size("items").cast("long").alias("n"), F.array_join("items", ";").alias("orders"))


@query(
    "agg_list_struct",
    """SELECT o_custkey, (rn - 1) // 1000 AS part,
       string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, ';' ORDER BY rn) AS nodes
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
       GROUP BY 1, 2""",
)
def agg_list_struct(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    node = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    day = F.date_trunc("day", "o_orderdate")
    lists = A.list_of(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], node, day, "nodes", hot_rows=1_000_000)
    text = F.transform("nodes", lambda n: F.concat_ws(":", n["id"].cast("string"), n["state"]))
    return lists.withColumn("nodes", F.array_join(text, ";"))


@query(
    "agg_first_if",
    """SELECT c_nationkey, arg_min(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END, c_custkey) AS bal
       FROM customer GROUP BY c_nationkey""",
)
def agg_first_if(spark, d):
    # sqrt of a negative balance is NaN, the value this FIRST replaces.
    bal = F.col("c_acctbal")
    value = iff(F.isnan(F.sqrt(bal)), F.lit(0.0), bal)
    return table(spark, d, "customer").groupBy("c_nationkey").agg(A.first_of(value, F.col("c_custkey")).alias("bal"))


@query(
    "agg_tagged_metrics",
    """SELECT 'OrderCount' AS Tag, COUNT(DISTINCT l_orderkey) AS Num FROM lineitem
       UNION ALL SELECT 'LineCount', COUNT(*) FROM lineitem
       UNION ALL SELECT 'SupplierCount', COUNT(DISTINCT l_suppkey) FROM lineitem""",
)
def agg_tagged_metrics(spark, d):
    return A.tagged_metrics(
        table(spark, d, "lineitem"),
        {
            "OrderCount": F.count_distinct("l_orderkey"),
            "LineCount": F.count(F.lit(1)),
            "SupplierCount": F.count_distinct("l_suppkey"),
        },
    )


# ---- windows, top, set operators ---------------------------------------------------------


@query(
    "win_count_over",
    "SELECT l_orderkey, l_linenumber, l_partkey, COUNT(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS srpv FROM lineitem",
)
def win_count_over(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return A.over_partition(l, ["l_suppkey", "l_returnflag"], {"srpv": F.count(F.lit(1))}).drop("l_suppkey", "l_returnflag")


@query(
    "win_sum_over",
    """SELECT l_orderkey, l_linenumber, l_quantity,
       CAST(SUM(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_partkey) AS BIGINT) AS part_qty FROM lineitem""",
)
def win_sum_over(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return A.over_partition(l, ["l_partkey"], {"part_qty": F.sum(F.col("l_quantity").cast("long"))}).drop("l_partkey")


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return S.top(o, 25, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(
    "set_union_all",
    "SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
)
def set_union_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return S.union_all(c, table(spark, d, "supplier").select("s_nationkey", "s_acctbal"))


@query(
    "set_union_distinct",
    """SELECT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'
       UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.05
       UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 5""",
)
def set_union_distinct(spark, d):
    l = table(spark, d, "lineitem")
    pair = [F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s")]
    return S.union_distinct(
        l.filter(F.col("l_returnflag") == "R").select(*pair),
        l.filter(F.col("l_discount") > 0.05).select(*pair),
        l.filter(F.col("l_quantity") < 5).select(*pair),
    )


@query(
    "set_except",
    "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
)
def set_except(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return S.except_distinct(c, table(spark, d, "supplier").filter(F.col("s_acctbal") > 5000).select("s_nationkey"))


@query(
    "set_except_all",
    "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def set_except_all(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return S.except_all(o, table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey"))


@query(
    "set_chain",
    """(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
       EXCEPT ALL (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
       UNION ALL SELECT s_suppkey FROM supplier""",
)
def set_chain(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("k"))
    c = table(spark, d, "customer")
    first = S.union_distinct(o, c.filter(F.col("c_acctbal") > 9000).select("c_custkey"))
    second = S.except_all(first, c.filter(F.col("c_nationkey") == 3).select("c_custkey"))
    return S.union_all(second, table(spark, d, "supplier").select("s_suppkey"))
