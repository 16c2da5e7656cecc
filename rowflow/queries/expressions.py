"""Scalar-expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowflow import functions as X
from rowflow.queries.registry import query, table

c = F.col


@query(
    "ex_if_nested",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt'
         ELSE CASE WHEN c_acctbal > 5000 OR c_mktsegment = 'BUILDING' THEN 'high' ELSE 'mid' END END AS band,
         CASE WHEN c_nationkey IS NOT NULL THEN 1 << ((c_custkey % 4)::INT + 3) ELSE 0 END AS traffic
       FROM customer""",
)
def ex_if_nested(spark, d):
    band = X.iff(
        c("c_acctbal") < 0,
        F.lit("debt"),
        X.iff(X.any_of(c("c_acctbal") > 5000, c("c_mktsegment") == "BUILDING"), F.lit("high"), F.lit("mid")),
    )
    shift = (X.bucket_id(c("c_custkey"), 4) + 3).cast("int")
    traffic = X.iff(c("c_nationkey").isNotNull(), F.call_function("shiftleft", F.lit(1), shift), F.lit(0))
    return table(spark, d, "customer").select("c_custkey", band.alias("band"), traffic.alias("traffic"))


@query(
    "ex_ternary",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END AS cost,
       CASE WHEN starts_with(l_linestatus, 'O') THEN 1 ELSE 0 END AS is_open FROM lineitem""",
)
def ex_ternary(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        X.iff(c("l_returnflag") == "R", F.lit(0.0), c("l_extendedprice")).alias("cost"),
        X.iff(c("l_linestatus").startswith("O"), F.lit(1), F.lit(0)).alias("is_open"),
    )


@query(
    "ex_null_coalesce",
    """SELECT c_custkey, COALESCE(spend, 0) AS spend FROM customer LEFT JOIN
       (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders GROUP BY 1)
       ON c_custkey = o_custkey""",
)
def ex_null_coalesce(spark, d):
    spend = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend")
    )
    cust = table(spark, d, "customer")
    joined = cust.join(spend, cust.c_custkey == spend.o_custkey, "left")
    return joined.select("c_custkey", X.or_default(c("spend"), F.lit(0.0)).alias("spend"))


@query(
    "ex_casts",
    """SELECT p_partkey, CAST(p_size AS BIGINT) AS size_l, TRY_CAST(p_brand AS INT) AS brand_n,
         CAST(substr(p_brand, 7) AS BIGINT) AS brand_id, CAST(round_even(p_retailprice * 10 + 0.5, 0) AS BIGINT) AS dimes,
         CAST(p_size AS DOUBLE) / 7 AS weeks
       FROM part""",
)
def ex_casts(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        X.convert(c("p_size"), "long").alias("size_l"),
        X.convert(c("p_brand"), "int?").alias("brand_n"),
        X.convert(F.substring("p_brand", 7, 10), "long").alias("brand_id"),
        X.convert_half_even(c("p_retailprice") * 10 + 0.5).alias("dimes"),
        (X.convert(c("p_size"), "double") / 7).alias("weeks"),
    )


@query(
    "ex_arith_bits",
    """SELECT p_partkey, p_size * 3 - 1 AS lin, p_size // 7 AS weeks, (0 - p_size) // 7 AS neg_weeks,
       (p_size << 8) | CAST(p_partkey % 256 AS INT) AS packed FROM part""",
)
def ex_arith_bits(spark, d):
    low = F.pmod(c("p_partkey"), F.lit(256)).cast("int")
    return table(spark, d, "part").select(
        "p_partkey",
        (c("p_size") * 3 - 1).alias("lin"),
        X.int_div(c("p_size"), F.lit(7)).alias("weeks"),
        X.int_div(-c("p_size"), F.lit(7)).alias("neg_weeks"),
        F.shiftleft("p_size", 8).bitwiseOR(low).alias("packed"),
    )


@query(
    "ex_concat",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '_' || CAST(o_custkey AS VARCHAR) AS temp_id,
       o_orderstatus || COALESCE(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE '!' END, '') AS marked FROM orders""",
)
def ex_concat(spark, d):
    mark = F.when(c("o_orderstatus") != "F", F.lit("!"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        X.concat_text(c("o_orderkey"), "_", c("o_custkey")).alias("temp_id"),
        X.concat_text(c("o_orderstatus"), mark).alias("marked"),
    )


@query(
    "ex_string_preds",
    """SELECT doc_id, NOT (lang IS NULL OR lang = '') AS has_lang, starts_with(source, 'src1') AS src1,
       contains(text, 'the') AS has_the FROM documents""",
)
def ex_string_preds(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        (~X.is_null_or_empty(c("lang"))).alias("has_lang"),
        c("source").startswith("src1").alias("src1"),
        c("text").contains("the").alias("has_the"),
    )


@query(
    "ex_math",
    """SELECT p_partkey, CAST(ceil(p_retailprice / 7 - 0.01) AS BIGINT) AS up, CAST(round_even(p_size * 0.5, 0) AS DOUBLE) AS half,
       LEAST(p_size, 25) AS lo, ABS(p_size - 25) AS dist, isnan(CASE WHEN p_size > 25 THEN 'nan'::DOUBLE ELSE 1.0 END) AS bad
       FROM part""",
)
def ex_math(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        F.ceil(c("p_retailprice") / 7 - 0.01).alias("up"),
        X.round_half_even(c("p_size") * 0.5).alias("half"),
        F.least("p_size", F.lit(25)).alias("lo"),
        F.abs(c("p_size") - 25).alias("dist"),
        F.isnan(F.sqrt(25 - c("p_size").cast("double"))).alias("bad"),
    )


@query(
    "ex_map_lookup",
    """SELECT c_custkey, CASE n_regionkey WHEN 0 THEN 1.5 WHEN 1 THEN 2.5 WHEN 3 THEN 0.5 ELSE 1.0 END AS rate
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def ex_map_lookup(spark, d):
    rates = F.create_map(*[F.lit(v) for v in (0, 1.5, 1, 2.5, 3, 0.5)])
    cust, nat = table(spark, d, "customer"), table(spark, d, "nation")
    joined = cust.join(nat, cust.c_nationkey == nat.n_nationkey)
    return joined.select("c_custkey", X.lookup(rates, c("n_regionkey"), F.lit(1.0)).alias("rate"))


@query(
    "ex_list_index",
    """SELECT vec_id, embedding[1] AS first_v, CASE WHEN len(embedding) > 500 THEN embedding[501] END AS beyond
       FROM embeddings""",
)
def ex_list_index(spark, d):
    points = F.transform("embedding", lambda v: F.struct(v.alias("Bid")))
    return table(spark, d, "embeddings").select(
        "vec_id", X.item(points, 0)["Bid"].alias("first_v"), X.item(points, 500)["Bid"].alias("beyond")
    )


@query(
    "ex_split_transform",
    """SELECT doc_id, len(string_split(text, '.')) AS parts,
       array_to_string([CAST(length(x) AS VARCHAR) for x in string_split(text, '.')], ',') AS sizes FROM documents""",
)
def ex_split_transform(spark, d):
    parts = F.split("text", "\\.", -1)
    sizes = F.transform(parts, lambda p: F.length(p).cast("string"))
    return table(spark, d, "documents").select(
        "doc_id", F.size(parts).cast("long").alias("parts"), F.array_join(sizes, ",").alias("sizes")
    )


@query(
    "ex_list_hof",
    """SELECT vec_id, [x for x in embedding if x > 0.1][1] AS first_big,
       len([x for x in embedding if x > 0.3]) > 0 AS any_huge,
       len([x for x in embedding if x < 0]) AS negatives FROM embeddings""",
)
def ex_list_hof(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id",
        X.first_where(c("embedding"), lambda v: v > 0.1).alias("first_big"),
        F.exists("embedding", lambda v: v > 0.3).alias("any_huge"),
        X.sum_of(F.filter("embedding", lambda v: v < 0), lambda v: F.lit(1)).cast("long").alias("negatives"),
    )


@query(
    "ex_struct",
    "SELECT c_custkey, c_name AS node_name, c_nationkey + 1 AS node_nation, upper(c_mktsegment) AS node_seg FROM customer",
)
def ex_struct(spark, d):
    node = F.struct(
        c("c_name").alias("name"), (c("c_nationkey") + 1).alias("nation"), F.upper("c_mktsegment").alias("seg")
    )
    built = table(spark, d, "customer").select("c_custkey", node.alias("node"))
    return built.select(
        "c_custkey",
        c("node.name").alias("node_name"),
        c("node.nation").alias("node_nation"),
        c("node.seg").alias("node_seg"),
    )


@query("ex_bucket_id", "SELECT c_custkey, c_custkey % 16 AS bucket FROM customer")
def ex_bucket_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.bucket_id(c("c_custkey"), 16).alias("bucket"))
