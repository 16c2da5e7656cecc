"""Sources and sinks. Each query writes the given tables to the shared folder and reads back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from rowflow.queries.registry import query, table
from rowflow.session import scratch_path
from rowflow.sources import sinks, streams
from rowflow.sources.registry import RowsetRegistry, sql_view
from rowflow.sources.text import extract

c = F.col


# ---- sources -----------------------------------------------------------------------------


def customer_text(spark, d):
    """Customers as tab-separated lines; each customer of nation 7 also has one bad line."""
    cust = table(spark, d, "customer")
    line = F.concat_ws("\t", c("c_custkey").cast("string"), c("c_name"), c("c_nationkey").cast("string"), c("c_acctbal").cast("string"))
    bad = cust.filter(c("c_nationkey") == 7).select(F.concat_ws("\t", F.lit("x"), c("c_name"), F.lit("n"), F.lit("y")))
    path = scratch_path(spark, "customer-text")
    cust.select(line.alias("value")).unionAll(bad).write.text(path)
    return path


@query("src_extract", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS bal FROM customer")
def src_extract(spark, d):
    return extract(spark, customer_text(spark, d), "id:long?, name:string, nation:int?, bal:double", silent=True)


@query("src_extract_count", "SELECT COUNT(*) AS C FROM customer")
def src_extract_count(spark, d):
    rows = extract(spark, customer_text(spark, d), "id:long?, name:string, nation:int?, bal:double", silent=True)
    return rows.agg(F.count(F.lit(1)).alias("C"))


@query("src_sstream", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40")
def src_sstream(spark, d):
    l = streams.read_stream_table(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    return l.filter(c("l_quantity") > 40)


@query(
    "src_streamset_serial",
    "SELECT CAST(o_orderkey % 7 AS INT) AS __serialnum, COUNT(*) AS n, SUM(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1",
)
def src_streamset_serial(spark, d):
    path = scratch_path(spark, "orders-serial")
    o = table(spark, d, "orders").select("o_orderkey").withColumn("f", F.pmod("o_orderkey", F.lit(7)))
    o.write.partitionBy("f").parquet(path)
    rows = streams.read_streamset(spark, path, "f=%n", "__serialnum", "0", "6")
    return rows.groupBy("__serialnum").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def events_by_day(spark, d, name, skip=()):
    path = scratch_path(spark, name)
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    if skip:
        e = e.filter(~c("day").isin(*skip))
    e.write.partitionBy("day").parquet(path)
    return path


@query(
    "src_streamset_date",
    """SELECT event_id, CAST(ts AS DATE) AS __date FROM events
       WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'""",
)
def src_streamset_date(spark, d):
    path = events_by_day(spark, d, "events-day")
    return streams.read_streamset(spark, path, "day=%Y-%m-%d", "__date", "2024-01-05", "2024-01-11").select("event_id", "__date")


@query(
    "src_streamset_hour",
    """SELECT event_id, date_trunc('hour', ts) AS __hour FROM events
       WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-06 06:00:00'""",
)
def src_streamset_hour(spark, d):
    """One table per hour; hours without events have none."""
    path = scratch_path(spark, "events-hour")
    e = table(spark, d, "events").filter(F.to_date("ts").between(date(2024, 1, 4), date(2024, 1, 7)))
    e.select("event_id", F.date_format("ts", "yyyy-MM-dd-HH").alias("h")).write.partitionBy("h").parquet(path)
    rows = streams.read_streamset(spark, path, "h=%Y-%m-%d-%H", "__hour", "2024-01-05 06:00:00", "2024-01-06 05:00:00", sparse=True)
    return rows.select("event_id", "__hour")


@query(
    "src_streamset_year",
    "SELECT CAST(year(o_orderdate) AS INT) AS __year, COUNT(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1997 GROUP BY 1",
)
def src_streamset_year(spark, d):
    path = scratch_path(spark, "orders-year")
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    o.write.partitionBy("y").parquet(path)
    rows = streams.read_streamset(spark, path, "y=%Y", "__year", "1996", "1997")
    return rows.groupBy("__year").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_sparse_range",
    """SELECT event_id, CAST(ts AS DATE) AS __date FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'
       AND CAST(ts AS DATE) NOT IN (DATE '2024-01-05', DATE '2024-01-08')""",
)
def src_sparse_range(spark, d):
    path = events_by_day(spark, d, "events-sparse", skip=[date(2024, 1, 5), date(2024, 1, 8)])
    text = f"{path}/day=%Y-%m-%d?date=2024-01-03...2024-01-09&sparsestreamset=true"
    return streams.read_dated_path(spark, text).select("event_id", "__date")


@query(
    "src_view_params",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""",
)
def src_view_params(spark, d):
    views = RowsetRegistry()
    views.register("OrderWindow")(
        sql_view(
            """SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate >= CAST(:start AS TIMESTAMP_NTZ)
               AND o_orderdate < CAST(:stop AS TIMESTAMP_NTZ)""",
            orders=table(spark, d, "orders"),
        )
    )
    return views.view("OrderWindow", spark, start="1997-01-01", stop="1998-01-01")


@query(
    "src_module_call",
    """SELECT c_custkey, n_name, 'config' AS mode FROM customer JOIN nation ON c_nationkey = n_nationkey
       WHERE n_regionkey = 2""",
)
def src_module_call(spark, d):
    modules = RowsetRegistry()

    @modules.register("Geo.AssignNation")
    def assign(Input, Config, Mode, Region):
        joined = Input.join(Config, c("c_nationkey") == c("n_nationkey")).filter(c("n_regionkey") == Region)
        return joined.select("c_custkey", "n_name", F.lit(Mode).alias("mode"))

    return modules.call(
        "Geo.AssignNation", Input=table(spark, d, "customer"), Config=table(spark, d, "nation"), Mode="config", Region=2
    )


@query("src_import_as", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 1000")
def src_import_as(spark, d):
    scripts = RowsetRegistry()
    scripts.register("suppliers.script")(
        lambda session, floor: table(session, d, "supplier").filter(c("s_acctbal") >= floor)
    )
    scripts.import_as("suppliers.script", "rowflow_imported_suppliers", spark, floor=1000)
    return spark.table("rowflow_imported_suppliers").select("s_suppkey", "s_acctbal")


@query("src_comma_tables", "SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey")
def src_comma_tables(spark, d):
    from rowflow.operators.joins import comma_tables

    cust, nat = table(spark, d, "customer"), table(spark, d, "nation")
    return comma_tables(cust, nat, cust.c_nationkey == nat.n_nationkey).select("c_custkey", "n_name")


@query("src_file_inventory")
def src_file_inventory(spark, d):
    return streams.file_inventory(spark, d, ".parquet")


# ---- sinks -------------------------------------------------------------------------------


@query("snk_output", "SELECT o_orderkey, o_totalprice FROM orders")
def snk_output(spark, d):
    path = sinks.output(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), scratch_path(spark, "out"))
    return spark.read.parquet(path)


@query(
    "snk_clustered",
    f"""SELECT l_partkey, COUNT(*) AS n, CEIL(COUNT(*) / {sinks.SHARE_ROWS}.0)::BIGINT AS shares, TRUE AS in_shares
       FROM lineitem GROUP BY l_partkey""",
)
def snk_clustered(spark, d):
    l = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    path = sinks.output(l, scratch_path(spark, "clustered"), clustered_by="l_partkey")
    rows = spark.read.parquet(path).select("l_partkey", c("_metadata.file_path").alias("file"))
    found = rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
    shares = F.ceil(c("n") / sinks.SHARE_ROWS)
    return found.select("l_partkey", "n", shares.alias("shares"), (c("files") <= shares).alias("in_shares"))


@query("snk_clustered_sorted", "SELECT l_partkey, l_orderkey, l_quantity FROM lineitem")
def snk_clustered_sorted(spark, d):
    l = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
    path = sinks.output(l, scratch_path(spark, "sorted"), clustered_by="l_partkey", sorted_by="l_partkey")
    return spark.read.parquet(path)


@query("snk_sorted_files", "SELECT COUNT(*) AS n, 0 AS out_of_order FROM lineitem UNION ALL SELECT COUNT(*), 1 FROM orders")
def snk_sorted_files(spark, d):
    """Rows and files out of order: of a sorted output, and of one file in the order of its arrival."""
    path = sinks.output(table(spark, d, "lineitem"), scratch_path(spark, "in-order"), clustered_by="l_partkey", sorted_by="l_partkey")
    loose = sinks.output(table(spark, d, "orders").coalesce(1), scratch_path(spark, "loose"))
    checks = [sinks.file_order(spark, path, "l_partkey"), sinks.file_order(spark, loose, "o_custkey")]
    counts = [x.agg(F.sum("rows").alias("n"), F.count_if(~c("in_order")).cast("int").alias("out_of_order")) for x in checks]
    return counts[0].unionAll(counts[1])


@query(
    "snk_partition_files",
    "SELECT l_returnflag, COUNT(*) AS n, TRUE AS planned FROM lineitem GROUP BY 1",
)
def snk_partition_files(spark, d):
    """Partition values have the files their rows ask for, though 16 tasks or more, one for each of
    ``sinks.SHARE_ROWS`` rows, held rows of each."""
    path, rows, l = scratch_path(spark, "planned"), 5000, table(spark, d, "lineitem")
    tasks = max(16, -(-l.count() // sinks.SHARE_ROWS))
    sinks.output(l.repartition(tasks), path, partitioned_by="l_returnflag", target_rows=rows)
    stored = spark.read.parquet(path).select("l_returnflag", c("_metadata.file_path").alias("file"))
    each = stored.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
    return each.select("l_returnflag", "n", (c("files") <= F.ceil(c("n") / rows)).alias("planned"))


@query("snk_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def snk_partitioned(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = sinks.output(o, scratch_path(spark, "partitioned"), partitioned_by="o_orderstatus")
    return spark.read.parquet(path).filter(c("o_orderstatus") == "F")


@query(
    "snk_expiry",
    "SELECT event_id, CAST(ts AS DATE) + 10 AS _expires_on FROM events WHERE CAST(ts AS DATE) + 10 >= DATE '2024-01-20'",
)
def snk_expiry(spark, d):
    path = scratch_path(spark, "expiry")
    e = table(spark, d, "events").select("event_id", "ts")
    sinks.output_by_expiry_column(e, path, F.date_add(F.to_date("ts"), 10))
    sinks.purge_expired(spark, path, date(2024, 1, 20))
    return spark.read.parquet(path).select("event_id", "_expires_on")


@query("snk_output_where", "SELECT p_partkey, p_size FROM part WHERE p_size >= 30")
def snk_output_where(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return spark.read.parquet(sinks.output(p, scratch_path(spark, "where"), where=c("p_size") >= 30))


@query(
    "snk_output_union",
    """SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier
       UNION ALL SELECT n_nationkey, n_name FROM nation""",
)
def snk_output_union(spark, d):
    cust = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    supp = table(spark, d, "supplier").select("s_suppkey", "s_name")
    nat = table(spark, d, "nation").select(c("n_nationkey").cast("long"), "n_name")
    return spark.read.parquet(sinks.output(cust.unionAll(supp).unionAll(nat), scratch_path(spark, "union")))


@query("snk_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def snk_csv(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = sinks.output_csv(cust, scratch_path(spark, "csv"))
    return spark.read.option("header", True).csv(path)


@query(
    "snk_schema",
    """SELECT CAST(row_number() OVER () - 1 AS INT) AS pos, column_name AS column,
         CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
              WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type
       FROM (DESCRIBE SELECT * FROM lineitem)""",
)
def snk_schema(spark, d):
    # The schema of the table as stored.
    path = sinks.output(table(spark, d, "lineitem"), scratch_path(spark, "schema"))
    return sinks.schema_rows(spark.read.parquet(path))
