"""Parameters and path templates over tables built from part, orders and supplier.

Input tables are given as SQL that Spark and DuckDB both read; the checks then compute the
expected text directly from the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rowflow.functions import dates as D
from rowflow.plans import declares as R
from rowflow.plans import params as P
from rowflow.queries.registry import query, table
from rowflow.session import spread

c = F.col


def brace(sql: str, *names: str) -> str:
    """The same SQL for spark.sql, where tables are {placeholders} and braces are doubled."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return text


def source(spark, d, sql, *names):
    """The input table of ``sql``, spread over the cores when it is one small file."""
    return spread(spark.sql(brace(sql, *names), **{n: table(spark, d, n) for n in names}))


TOKENS = """SELECT o_orderkey AS tid, o_orderdate AS d,
  CASE o_orderkey % 5 WHEN 0 THEN '/a/{yyyy-MM-dd}/b_{yyyy-MM-dd}.ss' WHEN 1 THEN '{yyyy/MM}/x_{dd}.ss'
    WHEN 2 THEN 'plain.ss' WHEN 3 THEN 'q{}r' ELSE '"{HH}"' END AS t FROM orders"""


@query(
    "prm_ymd_token",
    f"""SELECT tid, CASE tid % 5 WHEN 0 THEN '/a/' || strftime(d, '%Y-%m-%d') || '/b_' || strftime(d, '%Y-%m-%d') || '.ss'
       WHEN 1 THEN strftime(d, '%Y/%m') || '/x_{{dd}}.ss' WHEN 2 THEN t WHEN 3 THEN 'qr'
       ELSE '"' || strftime(d, '%H') || '"' END AS path FROM ({TOKENS})""",
)
def prm_ymd_token(spark, d):
    return source(spark, d, TOKENS, "orders").select("tid", D.fill_ymd_token(c("t"), c("d")).alias("path"))


FORMATS = """SELECT o_orderkey AS tid, o_orderdate AS d, concat('base', CAST(o_custkey AS STRING)) AS a0,
  CAST(o_orderkey % 24 AS STRING) AS a2,
  CASE o_orderkey % 4 WHEN 0 THEN 'lot-{1:dd.MM.yyyy}/{0}/{2}/h{1:HH}.tsv' WHEN 1 THEN '/{0}/{2}-{0}.ss'
    WHEN 2 THEN '{2}_{1}.ss' ELSE '{0}/{1:HH}h/{1:yyyy-MM-dd HH:mm:ss}_{2:x}.ss' END AS t FROM orders"""


@query(
    "prm_string_format",
    f"""SELECT tid, CASE tid % 4 WHEN 0 THEN strftime(d, 'lot-%d.%m.%Y/') || a0 || '/' || a2 || strftime(d, '/h%H.tsv')
       WHEN 1 THEN '/' || a0 || '/' || a2 || '-' || a0 || '.ss' WHEN 2 THEN a2 || '_' || strftime(d, '%Y-%m-%d %H:%M:%S') || '.ss'
       ELSE a0 || '/' || strftime(d, '%H') || 'h/' || strftime(d, '%Y-%m-%d %H:%M:%S') || '_' || a2 || '.ss' END AS path FROM ({FORMATS})""",
)
def prm_string_format(spark, d):
    args = [("text", c("a0")), ("date", c("d")), ("text", c("a2"))]
    return source(spark, d, FORMATS, "orders").select("tid", D.string_format(c("t"), args).alias("path"))


STRFTIME = """SELECT event_id AS tid, ts, CASE WHEN event_id % 3 = 2 THEN NULL ELSE ts END AS d1,
  CASE event_id % 3 WHEN 0 THEN '{0}/Result/%Y/%m/Ctx_%Y-%m-%d.ss?date={1:yyyy-MM-dd}' WHEN 1 THEN '{0}/%Y/D_%Y%m%d%h%M%S.ss?n=%n'
    ELSE '{0}/%Y/%m/%d/E_%h_%n.ss?date={2}' END AS t FROM events"""


@query(
    "prm_strftime_tokens",
    f"""SELECT tid, CASE tid % 3 WHEN 0 THEN 'p/Result/' || strftime(ts, '%Y/%m') || '/Ctx_' || strftime(ts, '%Y-%m-%d') || '.ss?date=' || strftime(ts, '%Y-%m-%d')
       WHEN 1 THEN 'p/' || strftime(ts, '%Y') || '/D_' || strftime(ts, '%Y%m%d%H%M%S') || '.ss?n=1'
       ELSE 'p/' || strftime(ts, '%Y/%m/%d') || '/E_00_1.ss?date=' || strftime(ts, '%Y-%m-%d') END AS path FROM ({STRFTIME})""",
)
def prm_strftime_tokens(spark, d):
    day = D.format_date(c("ts"), F.lit("yyyy-MM-dd"))
    args = [("text", F.lit("p")), ("date", c("d1")), ("text", day)]
    return source(spark, d, STRFTIME, "events").select("tid", D.string_format(c("t"), args).alias("path"))


CHAINS = """SELECT o_orderkey AS tid, o_orderdate AS d, CAST(o_orderkey % 40 AS INT) - 20 AS n,
  concat('DateTime.Parse("', substr(CAST(o_orderdate AS STRING), 1, 10), '").AddDays( ',
    CASE WHEN o_orderkey % 40 < 20 THEN '- ' ELSE '' END, CAST(abs(CAST(o_orderkey % 40 AS INT) - 20) AS STRING), ')',
    CASE WHEN o_orderkey % 2 = 0 THEN '.ToString("yyyyMMdd")' ELSE '' END) AS e FROM orders"""


@query(
    "prm_date_chain",
    f"""SELECT tid, CASE WHEN tid % 2 = 0 THEN strftime(d + to_days(n), '%Y%m%d') ELSE strftime(d + to_days(n), '%Y-%m-%d %H:%M:%S') END AS v
       FROM ({CHAINS})""",
)
def prm_date_chain(spark, d):
    return source(spark, d, CHAINS, "orders").select("tid", D.eval_date(c("e")).alias("v"))


RANGES = """SELECT o_orderkey AS tid, concat(substr(CAST(o_orderdate AS STRING), 1, 10), '...',
  substr(CAST(o_orderdate + INTERVAL '3' DAY AS STRING), 1, 10)) AS r FROM orders"""


@query(
    "prm_date_range_explode",
    """SELECT o_orderkey AS tid, CAST(o_orderdate AS DATE) + i::INT AS day FROM orders, range(4) t(i)""",
)
def prm_date_range_explode(spark, d):
    return source(spark, d, RANGES, "orders").select("tid", F.explode(D.days_of_range(c("r"))).alias("day"))


EXTERNALS = """SELECT concat('s', CAST(p_partkey AS STRING)) AS script, p_name,
  concat('FROM "@@', replace(p_type, ' ', '_'), '@@/', p_name, '" AND @@Unknown@@ @@', replace(p_type, ' ', '_'), '@@') AS text FROM part"""
EXTERNAL_VALUES = "SELECT DISTINCT replace(p_type, ' ', '_') AS key, concat('v-', lower(p_type)) AS value FROM part"


@query(
    "prm_external",
    f"""SELECT script, 'FROM "v-' || lower(p_type) || '/' || p_name || '" AND @@Unknown@@ v-' || lower(p_type) AS text
       FROM (SELECT 's' || p_partkey AS script, p_type, p_name FROM part)""",
)
def prm_external(spark, d):
    scripts = source(spark, d, EXTERNALS, "part").drop("p_name")
    return P.resolve_external(scripts, source(spark, d, EXTERNAL_VALUES, "part"))


MASTER_JOBS = """SELECT concat('p', CAST(s_suppkey AS STRING)) AS process, 'Base' AS key, concat('m', CAST(s_nationkey AS STRING)) AS master,
  concat(chr(92), '"$(Root)/$(Missing)/$(Empty)/', s_name, chr(92), '"') AS value FROM supplier"""
MASTER_VALUES = """SELECT concat('m', CAST(n_nationkey AS STRING)) AS master, 'Root' AS key, n_name AS value FROM nation
  UNION ALL SELECT concat('m', CAST(n_nationkey AS STRING)), 'Empty', CAST(NULL AS STRING) FROM nation"""


@query(
    "prm_master",
    """SELECT 'p' || s_suppkey AS process, 'Base' AS key, 'm' || s_nationkey AS master,
       '"' || n_name || '/$(Missing)/$(Empty)/' || s_name || '"' AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def prm_master(spark, d):
    return P.resolve_master(source(spark, d, MASTER_JOBS, "supplier"), source(spark, d, MASTER_VALUES, "nation"))


@query(
    "prm_job_params",
    """SELECT 'p' || c_custkey AS process, 'Date' AS key, '{yyyy-MM-dd}' AS value FROM customer
       UNION ALL SELECT 'p' || c_custkey, 'hour', CAST(c_nationkey AS VARCHAR) FROM customer
       UNION ALL SELECT 'p' || c_custkey, 'base', 'x=' || c_mktsegment FROM customer""",
)
def prm_job_params(spark, d):
    items = F.array(
        F.lit("-jobname x=1"),
        F.concat(F.lit("-params Date={yyyy-MM-dd},hour=00")),
        F.concat(F.lit("-params hour="), c("c_nationkey").cast("string"), F.lit(",base=x="), c("c_mktsegment")),
    )
    jobs = table(spark, d, "customer").select(F.concat(F.lit("p"), c("c_custkey").cast("string")).alias("process"), items.alias("items"))
    return P.job_params(jobs)


REFERENCES = """SELECT concat('s', CAST(p_partkey AS STRING)) AS script, 'Root' AS key, concat('/', p_name) AS value FROM part
  UNION ALL SELECT concat('s', CAST(p_partkey AS STRING)), 'A', '@Root/a' FROM part
  UNION ALL SELECT concat('s', CAST(p_partkey AS STRING)), 'B', '@A/b@@Ext@@' FROM part
  UNION ALL SELECT concat('s', CAST(p_partkey AS STRING)), 'C', concat('@B/', p_brand, '@None') FROM part
  UNION ALL SELECT concat('s', CAST(p_partkey AS STRING)), 'Loop', '@Loop+' FROM part"""


@query(
    "prm_ref_chain",
    """SELECT 's' || p_partkey AS script, k AS key, CASE k WHEN 'Root' THEN '/' || p_name WHEN 'A' THEN '/' || p_name || '/a'
         WHEN 'B' THEN '/' || p_name || '/a/b@@Ext@@' WHEN 'C' THEN '/' || p_name || '/a/b@@Ext@@/' || p_brand || '@None'
         ELSE '@Loop++++++' END AS value
       FROM part, (VALUES ('Root'), ('A'), ('B'), ('C'), ('Loop')) t(k)""",
)
def prm_ref_chain(spark, d):
    return P.resolve_references(source(spark, d, REFERENCES, "part"))


REFERENCE_LINES = """SELECT concat('s', CAST(p_partkey AS STRING)) AS script, t.pos, t.key,
    replace(replace(t.value, '#P', p_name), '#B', p_brand) AS value
  FROM part, (VALUES (0, 'Root', '/#P'), (1, 'One', '@Root/#B'), (2, 'Root', '@Root/b'), (3, 'Two', '@Root;@One'),
    (4, 'Early', '@Later'), (5, 'Later', '#B'), (6, 'Own', '@Own')) t(pos, key, value)"""


@query(
    "prm_ref_lines",
    """SELECT 's' || p_partkey AS script, k AS key, CASE k WHEN 'Root' THEN '/' || p_name || '/b' WHEN 'One' THEN '/' || p_name || '/' || p_brand
         WHEN 'Two' THEN '/' || p_name || '/b;/' || p_name || '/' || p_brand WHEN 'Own' THEN '@Own' ELSE p_brand END AS value
       FROM part, (VALUES ('Root'), ('One'), ('Two'), ('Early'), ('Later'), ('Own')) t(k)""",
)
def prm_ref_lines(spark, d):
    """Keys set twice: a name means its latest earlier line."""
    return P.resolve_references(source(spark, d, REFERENCE_LINES, "part"))


#: Lines of a script: name, right side (#D a day, #N a number of days, #C a number), kind and value.
DECLARE_LINES = [
    ("Base", "'\"/c#C\"'", "text", "'/c' || c"),
    ("Day", "'DateTime.Parse(\"#D\")'", "date", "strftime(d, '%Y-%m-%d 00:00:00')"),
    ("Prev", "'@Day.AddDays( - #N )'", "date", "strftime(d - to_days(n), '%Y-%m-%d 00:00:00')"),
    ("Stamp", "'@Prev.ToString(\"yyyyMMdd\")'", "text", "strftime(d - to_days(n), '%Y%m%d')"),
    ("Num", "'int.Parse(\"#N\")'", "number", "CAST(n AS VARCHAR)"),
    ("Sum", "'Math.Abs( - #C) + @Num + 1'", "number", "CAST(c + n + 1 AS VARCHAR)"),
    ("Form", "'\"{1:yyyy/MM}/{0}_%d.ss?n=%n\"'", "text", "'{1:yyyy/MM}/{0}_%d.ss?n=%n'"),
    (
        "Path",
        "CASE o_orderkey % 3 WHEN 0 THEN 'string.Format(@Form, @Stamp, @Prev.AddDays(1))' WHEN 1 THEN '@Base + \"/\" + @Stamp + \".ss\"' "
        "ELSE '@Base.Replace(\"/c\", \"/z\").TrimEnd(''0'') + @Num' END",
        "text",
        "CASE o % 3 WHEN 0 THEN strftime(d - to_days(n - 1), '%Y/%m') || '/' || strftime(d - to_days(n), '%Y%m%d') || strftime(d - to_days(n - 1), '_%d.ss?n=1') "
        "WHEN 1 THEN '/c' || c || '/' || strftime(d - to_days(n), '%Y%m%d') || '.ss' ELSE rtrim('/z' || c, '0') || n END",
    ),
    ("Base", "'@Base + \"/b\"'", "text", "'/c' || c || '/b'"),
    ("Nest", "'string.Format(\"{0}-{1}\", @Base, string.Format(\"{0:dd}\", @Day))'", "text", "'/c' || c || '/b-' || strftime(d, '%d')"),
    ("Odd", "'Custom(@Base, 1)'", None, "'Custom(@Base, 1)'"),
    ("Uses", "'@Odd + \"x\"'", None, "'@Odd + \"x\"'"),
]
DECLARES = " UNION ALL ".join(
    f"SELECT concat('s', CAST(o_orderkey AS STRING)) AS script, {i} AS pos, '{key}' AS key, replace(replace(replace({text}, "
    f"'#D', substr(CAST(o_orderdate AS STRING), 1, 10)), '#N', CAST(o_custkey % 30 AS STRING)), '#C', CAST(o_custkey AS STRING)) AS value FROM orders"
    for i, (key, text, _, _) in enumerate(DECLARE_LINES)
)


@query(
    "prm_resolve_declares",
    " UNION ALL ".join(
        f"SELECT 's' || o AS script, {i} AS pos, '{key}' AS key, {f"'{kind}'" if kind else 'NULL'} AS kind, {value} AS value, {bool(kind)} AS understood "
        "FROM (SELECT o_orderkey AS o, o_orderdate AS d, o_custkey AS c, CAST(o_custkey % 30 AS INTEGER) AS n FROM orders)"
        for i, (key, _, kind, value) in enumerate(DECLARE_LINES)
    ),
)
def prm_resolve_declares(spark, d):
    return R.resolve_declares(source(spark, d, DECLARES, "orders"))


@query(
    "prm_string_funcs",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name || '.ss', '.ss', '_fake.ss')
         WHEN 1 THEN p_name || '.ss' WHEN 2 THEN p_name || '.ss' ELSE '//' || p_name || '.ss//;' END AS v,
       CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 - p_partkey END AS n,
       'pre_' || p_name AS cat FROM part""",
)
def prm_string_funcs(spark, d):
    kind = F.pmod("p_partkey", F.lit(4))
    name = F.concat(c("p_name"), F.lit(".ss"))
    value = F.when(kind == 0, name).when(kind == 1, F.concat(name, F.lit("/;/"))).otherwise(F.concat(F.lit("//"), name, F.lit("//;")))
    call = (
        F.when(kind == 0, F.lit('Replace(".ss", "_fake.ss")'))
        .when(kind == 1, F.lit("TrimEnd('/', ';')"))
        .when(kind == 2, F.lit("Trim('/', ';')"))
        .otherwise(F.lit("Clone()"))
    )
    number = F.when(
        F.pmod("p_partkey", F.lit(2)) == 0, F.concat(F.lit("Math.Abs( - "), c("p_size").cast("string"), F.lit(")"))
    ).otherwise(F.concat(F.lit('int.Parse("-'), c("p_partkey").cast("string"), F.lit('")')))
    return table(spark, d, "part").select(
        "p_partkey",
        P.eval_string(value, call).alias("v"),
        P.eval_number(number).alias("n"),
        F.concat(F.lit("pre_"), c("p_name")).alias("cat"),
    )


@query(
    "prm_merge",
    """SELECT 'p' || s_suppkey AS process, 'Base' AS key, CASE WHEN s_suppkey % 2 = 0 THEN '/o' WHEN s_acctbal > 0 THEN s_name ELSE '/d' END AS value FROM supplier
       UNION ALL SELECT 'p' || s_suppkey, 'RunDate', '{yyyy-MM-dd}' FROM supplier
       UNION ALL SELECT 'p' || s_suppkey, 'EndDate', '"2018-12-12"' FROM supplier
       UNION ALL SELECT 'p' || s_suppkey, 'Mode', 'true' FROM supplier""",
)
def prm_merge(spark, d):
    s = table(spark, d, "supplier").withColumn("process", F.concat(F.lit("p"), c("s_suppkey").cast("string")))

    def rows(key, value, keep=F.lit(True)):
        return s.filter(keep).select("process", F.lit(key).alias("key"), value.alias("value"))

    defaults = rows("Base", F.lit("/d")).unionAll(rows("RunDate", F.lit("2018-12-12"))).unionAll(rows("Mode", F.lit("true")))
    job = rows("Base", c("s_name"), c("s_acctbal") > 0).unionAll(rows("RunDate", F.lit("{yyyy-MM-dd}")))
    job = job.unionAll(rows("EndDate", F.lit('@"{yyyy-MM-dd}"')))
    overrides = rows("Base", F.lit("/o"), F.pmod("s_suppkey", F.lit(2)) == 0)
    return P.merge_params(defaults, job, overrides, F.lit("2018-12-12").cast("timestamp_ntz"))
