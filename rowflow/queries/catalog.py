"""Catalog queries over pages, and over sizes and lookups derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowflow.plans import catalog as H
from rowflow.queries.parameters import source
from rowflow.queries.registry import query, table

c = F.col


@query(
    "cat_page_links",
    """SELECT page_id, href FROM (SELECT page_id, UNNEST(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""",
)
def cat_page_links(spark, d):
    return H.page_links(table(spark, d, "pages"), H.ANY_HREF).drop("pos")


STREAMS = """SELECT page_id, replace(html, '">', '.ss?property=info">') AS html FROM pages"""


@query(
    "cat_stream_links",
    f"""SELECT page_id, href FROM (SELECT page_id, UNNEST(regexp_extract_all(html, 'href="([^"]*\\.ss\\?property=info)"', 1)) AS href
       FROM ({STREAMS}))""",
)
def cat_stream_links(spark, d):
    return H.page_links(source(spark, d, STREAMS, "pages")).drop("pos")


FOLDERS = """SELECT page_id, replace(html, '<a href="/t', '<a class="unmountedDirLink" href="/t') AS html FROM pages"""


@query(
    "cat_anchor_text",
    f"""SELECT page_id, text FROM (SELECT page_id, UNNEST(regexp_extract_all(html,
       '<a[^>]*class="unmountedDirLink"[^>]*>([^<]*)</a>', 1)) AS text FROM ({FOLDERS}))""",
)
def cat_anchor_text(spark, d):
    return H.anchor_texts(source(spark, d, FOLDERS, "pages")).drop("pos")


SCHEMAS = """SELECT p_partkey AS page_id, concat('<div id="s"><div class="div-table-row"><div class="div-table-col">', p_name,
  '</div><div class="div-table-col">int</div></div><p>x</p><div class="div-table-row"> <div class="div-table-col">', p_brand,
  '</div> <div class="div-table-col">string?</div> </div></div>') AS html FROM part"""


@query(
    "cat_schema_rows",
    """SELECT p_partkey AS page_id, 0 AS pos, p_name AS name, 'int' AS type FROM part
       UNION ALL SELECT p_partkey, 1, p_brand, 'string?' FROM part""",
)
def cat_schema_rows(spark, d):
    return H.schema_rows(source(spark, d, SCHEMAS, "part"))


SIZES = """SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN o_orderkey * 97
  WHEN 2 THEN o_orderkey * 1048583 WHEN 3 THEN o_orderkey * 8796093022 WHEN 4 THEN 169216 ELSE o_orderkey * 256 END AS BIGINT) AS n FROM orders"""


@query(
    "cat_size_pretty",
    f"""SELECT o_orderkey, printf('%.1f ', CAST(round_even(n / (1024.0::DOUBLE ** u), 1) AS DOUBLE)) || ['', 'K', 'M', 'G', 'T', 'P', 'E', 'Z'][u + 1] AS pretty
       FROM (SELECT *, (n >= 1024)::INT + (n >= 1048576)::INT + (n >= 1073741824)::INT + (n >= 1099511627776)::INT
         + (n >= 1125899906842624)::INT + (n >= 1152921504606846976)::INT AS u FROM ({SIZES}))""",
)
def cat_size_pretty(spark, d):
    text = F.concat(F.format_number("n", 0), F.lit(" Bytes"))
    return source(spark, d, SIZES, "orders").select("o_orderkey", H.size_pretty(text).alias("pretty"))


@query(
    "cat_size_cache",
    """WITH log AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS url, event_type = 'error' AS bad, ts, props FROM events),
         f AS (SELECT url, MIN(ts) FILTER (NOT bad) AS good_ts FROM log GROUP BY url),
         n AS (SELECT url, COUNT(*) FILTER (bad AND (good_ts IS NULL OR ts < good_ts)) AS failures,
                 MIN(COALESCE(props, '')) FILTER (NOT bad AND ts = good_ts) AS good FROM log JOIN f USING (url) GROUP BY url)
       SELECT url, 'size' AS key, CASE WHEN failures > 3 THEN 'NA' ELSE COALESCE(good, '') END AS value, failures FROM n""",
)
def cat_size_cache(spark, d):
    day = F.substring(c("ts").cast("string"), 1, 10)
    log = table(spark, d, "events").select(
        F.concat_ws("/", c("user_id").cast("string"), day).alias("url"),
        F.lit("size").alias("key"),
        c("props").alias("value"),
        (c("event_type") != "error").alias("ok"),
        "ts",
    )
    return H.size_cache(log)


@query(
    "cat_url_norm",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '?property=info' ELSE url || '?property=info' END AS url FROM pages""",
)
def cat_url_norm(spark, d):
    done = F.when(F.pmod("page_id", F.lit(2)) == 0, F.concat("url", F.lit("?property=info"))).otherwise(c("url"))
    return table(spark, d, "pages").select("page_id", H.info_url(done).alias("url"))
