"""Workflow and graph queries. Config texts are spliced from supplier rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowflow.functions import dates as D
from rowflow.operators import graph as G
from rowflow.operators.closest import closest_process
from rowflow.plans import project as P, workflow as W
from rowflow.queries.parameters import source
from rowflow.queries.registry import query, table
from rowflow.session import cut_lineage

c = F.col

# Suppliers are processes (broken XML when in debt, no dependency list in nation 3), with one
# master per supplier; the supplier's nation is its folder.
CONFIGS = """SELECT concat('/cfg/N', CAST(s_nationkey AS STRING), '/P', CAST(s_suppkey AS STRING), '.config') AS path,
  CASE WHEN s_acctbal < 0 THEN concat('<Workflow><Process>', s_name) ELSE
  concat('<Workflow><Process>P', CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE '' END,
    '</Process><ClassName>Run.', CASE WHEN s_suppkey % 7 = 0 THEN 'Copy' ELSE 'ScopeJobRunner' END, '</ClassName><Parameters>',
    '<P><Name>ScriptFile</Name><Value>/s/S', CAST(s_suppkey AS STRING), '.script</Value></P>',
    '<P><Name>EventName</Name><Value>E', CAST(s_suppkey AS STRING), '</Value></P><P><Name>Note</Name><Value/></P>',
    '<P><Name>DeltaInterval</Name><Value>', CASE WHEN s_suppkey % 2 = 0 THEN '1.00:00:00' ELSE '03:00:00' END, '</Value></P>',
    CASE WHEN s_nationkey = 3 THEN '' ELSE concat('<P><Name>EventNamesToCheck</Name><Value><string>D:E',
      CAST(s_suppkey + 1 AS STRING), '/x</string><string>N', CAST(s_nationkey AS STRING), '</string></Value></P>') END,
    '<P><Name>ScopeJobParams</Name><Value><string>-vc x</string><string>-params Base=/b/$(Root)/', CAST(s_suppkey AS STRING),
    ',hour={HH}</string></Value></P></Parameters></Workflow>') END AS text FROM supplier
  UNION ALL SELECT concat('/cfg/N', CAST(s_nationkey AS STRING), '/M', CAST(s_suppkey AS STRING), '.config'),
  concat('<Master><SqlConnectionString>x</SqlConnectionString><Parameters><P><Name>Root</Name><Value>', s_name,
    '</Value></P><P><Name>Empty</Name><Value></Value></P></Parameters><Workflows><W><Process>P', CAST(s_suppkey AS STRING),
    '</Process><Group>G', CAST(s_suppkey % 3 AS STRING), '</Group></W></Workflows></Master>') FROM supplier WHERE s_suppkey % 4 <> 0"""


def parsed(spark, d):
    return W.parse_configs(source(spark, d, CONFIGS, "supplier"))


@query(
    "wf_ingest_xml",
    """SELECT s_suppkey AS k, '/cfg/N' || s_nationkey || '/P' || s_suppkey || '.config' AS path, p AS param,
         CASE p WHEN 'ScriptFile' THEN '/s/S' || s_suppkey || '.script' WHEN 'EventName' THEN 'E' || s_suppkey WHEN 'Note' THEN ''
           WHEN 'DeltaInterval' THEN CASE WHEN s_suppkey % 2 = 0 THEN '1.00:00:00' ELSE '03:00:00' END
           WHEN 'ScopeJobParams' THEN '-vc x|-params Base=/b/$(Root)/' || s_suppkey || ',hour={HH}'
           ELSE 'D:E' || (s_suppkey + 1) || '/x|N' || s_nationkey END AS vals
       FROM supplier, (VALUES ('ScriptFile'), ('EventName'), ('Note'), ('DeltaInterval'), ('EventNamesToCheck'), ('ScopeJobParams')) t(p)
       WHERE s_acctbal >= 0 AND (s_nationkey <> 3 OR p <> 'EventNamesToCheck')""",
)
def wf_ingest_xml(spark, d):
    rows = W.workflow_params(parsed(spark, d))
    key = F.regexp_extract("path", r"/P(\d+)\.config", 1).cast("long")
    return rows.select(key.alias("k"), "path", "param", F.array_join("values", "|").alias("vals"))


@query(
    "wf_ingest_masters",
    """SELECT 'N' || s_nationkey || '##M' || s_suppkey || '.config' AS master, 'P' || s_suppkey AS process, 'G' || (s_suppkey % 3) AS group_,
         k AS key, CASE k WHEN 'Root' THEN s_name END AS value
       FROM supplier, (VALUES ('Root'), ('Empty')) t(k) WHERE s_suppkey % 4 <> 0""",
)
def wf_ingest_masters(spark, d):
    masters = W.first_masters(parsed(spark, d))
    joined = W.memberships(masters).join(W.master_params(masters), "master")
    return joined.select("master", "process", c("group").alias("group_"), "key", "value")


PROCESS_SQL = """SELECT 'P' || s_suppkey AS process, 'S' || s_suppkey || '.script' AS script, 'E' || s_suppkey AS event,
  CASE WHEN s_suppkey % 2 = 0 THEN '1D' ELSE '3H' END AS interval_, s_nationkey, s_suppkey
  FROM supplier WHERE s_acctbal >= 0 AND s_suppkey % 7 <> 0"""


@query("wf_normalise", f"SELECT process, script, event, interval_, 1 + (s_nationkey <> 3)::INT AS deps FROM ({PROCESS_SQL})")
def wf_normalise(spark, d):
    procs = W.processes(parsed(spark, d))
    return procs.select("process", "script", "event", c("interval").alias("interval_"), F.size("deps").alias("deps"))


LISTED = "s_acctbal >= 0 AND s_suppkey % 4 <> 0"


@query(
    "wf_process_params",
    f"""SELECT 'P' || s_suppkey AS process, key, 'N' || s_nationkey || '##M' || s_suppkey || '.config' AS master,
         CASE key WHEN 'Base' THEN '/b/' || s_name || '/' || s_suppkey ELSE '{{HH}}' END AS value
       FROM supplier, (VALUES ('Base'), ('hour')) t(key) WHERE {LISTED} AND s_suppkey % 7 <> 0""",
)
def wf_process_params(spark, d):
    files = cut_lineage(parsed(spark, d))
    return W.process_params(files, W.first_masters(files))


PROJECT_SCRIPTS = """SELECT concat('S', CAST(s_suppkey AS STRING), '.script') AS script, concat(
  'In = SELECT Id FROM (SSTREAM "@@Base@@/in.ss"); // read', chr(10), 'OUTPUT In TO SSTREAM "@@Out@@/', s_name, '.ss";') AS text FROM supplier"""


@query(
    "wf_project_edges",
    f"""SELECT 'S' || s_suppkey || '.script' AS script, 'SSTREAM_"' || CASE WHEN s_suppkey % 7 <> 0 AND {LISTED}
         THEN '/b/' || s_name || '/' || s_suppkey ELSE '/default' END || '/in.ss"' AS src, 'In' AS dst FROM supplier
       UNION ALL SELECT 'S' || s_suppkey || '.script', 'In', '"/out/' || s_name || '.ss"' FROM supplier""",
)
def wf_project_edges(spark, d):
    """From config and script texts to lineage; scripts without a listed process use defaults."""
    defaults = table(spark, d, "region").agg(F.lit("/default").alias("Base"), F.lit("/out").alias("Out"))
    defaults = defaults.unpivot([], ["Base", "Out"], "key", "value")
    scripts = source(spark, d, PROJECT_SCRIPTS, "supplier")
    return P.build(source(spark, d, CONFIGS, "supplier"), scripts, defaults).edges.select("script", "src", "dst")


PROJECT_DECLARED = """SELECT concat('S', CAST(s_suppkey AS STRING), '.script') AS script, concat(
  '#DECLARE Day DateTime = DateTime.Parse("2018-03-04");', chr(10), '#DECLARE Root string = "@@Base@@";', chr(10),
  '#DECLARE Source string = @Root + "/in_" + @Day.AddDays(', CAST(s_suppkey % 9 AS STRING), ').ToString("yyyyMMdd") + ".ss";', chr(10),
  CASE WHEN s_suppkey % 5 = 0 THEN '#DECLARE Target string = Custom(@Source);' ELSE concat('#DECLARE Target string = "@@Out@@/', s_name, '.ss";') END, chr(10),
  'In = SELECT Id FROM (SSTREAM @Source);', chr(10), 'OUTPUT In TO SSTREAM @Target;') AS text FROM supplier"""


def project(spark, d, scripts=PROJECT_DECLARED):
    defaults = table(spark, d, "region").agg(F.lit("/default").alias("Base"), F.lit("/out").alias("Out"))
    defaults = defaults.unpivot([], ["Base", "Out"], "key", "value")
    return P.build(source(spark, d, CONFIGS, "supplier"), source(spark, d, scripts, "supplier"), defaults)


@query(
    "wf_project_nodes",
    """SELECT 'S' || s_suppkey || '.script' AS script, name, type, colour FROM supplier,
         (VALUES ('SSTREAM_@Source', 'input', 'greenyellow'), ('In', NULL, NULL), ('@Target', 'output', 'tomato')) t(name, type, colour)""",
)
def wf_project_nodes(spark, d):
    return project(spark, d).nodes().select("script", "name", "type", c("fillcolor").alias("colour"))


@query(
    "wf_project_links",
    f"""SELECT 'S' || s_suppkey || '.script' AS script, 'SSTREAM_@Source' AS name, 'https://portal.example/' || CASE WHEN s_suppkey % 7 <> 0 AND {LISTED}
         THEN '/b/' || s_name || '/' || s_suppkey ELSE '/default' END || '/in_' || strftime(DATE '2018-03-04' + CAST(s_suppkey % 9 AS INT), '%Y%m%d') || '.ss?property=info' AS href
       FROM supplier UNION ALL
       SELECT 'S' || s_suppkey || '.script', '@Target', 'https://portal.example//out/' || s_name || '.ss?property=info' FROM supplier WHERE s_suppkey % 5 <> 0""",
)
def wf_project_links(spark, d):
    """Job values, then declarations built on them, then links; a target that is not understood has none."""
    return project(spark, d).links(F.lit("2018-12-12").cast("timestamp_ntz"), "https://portal.example/")


ON_SQL = f"""p AS (SELECT * FROM ({PROCESS_SQL}) WHERE s_suppkey % 4 <> 0),
  needs AS (SELECT CASE WHEN s_nationkey = 3 THEN 'None' ELSE 'E' || (s_suppkey + 1) END AS event, script FROM p
    UNION SELECT 'N' || s_nationkey, script FROM p WHERE s_nationkey <> 3),
  dep AS (SELECT script AS src, event AS dst FROM p UNION SELECT event, script FROM needs)"""


@query(
    "wf_project_trace",
    f"""WITH RECURSIVE {ON_SQL}, seeds AS (SELECT script AS name FROM p WHERE s_nationkey = 5),
       below AS (SELECT name FROM seeds UNION SELECT dst FROM below JOIN dep ON src = name),
       above AS (SELECT name FROM seeds UNION SELECT src FROM above JOIN dep ON dst = name)
       SELECT src, dst FROM dep WHERE src IN (SELECT name FROM below) UNION SELECT src, dst FROM dep WHERE dst IN (SELECT name FROM above)""",
)
def wf_project_trace(spark, d):
    return project(spark, d).trace(folder="/N5/")[1].select("src", "dst")


@query(
    "wf_project_contract",
    f"""WITH {ON_SQL} SELECT p.script AS src, needs.script AS dst FROM needs JOIN p ON p.event = needs.event
       UNION SELECT event, script FROM needs WHERE event NOT IN (SELECT event FROM p)""",
)
def wf_project_contract(spark, d):
    return project(spark, d).contracted()[1]


@query(
    "wf_project_failures",
    """SELECT '/cfg/N' || s_nationkey AS place, 'not well-formed' AS message, COUNT(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1
       UNION ALL SELECT 'S' || s_suppkey || '.script', 'Custom(@Source)', 1 FROM supplier WHERE s_suppkey % 5 = 0""",
)
def wf_project_failures(spark, d):
    """Configs that cannot be used, and declarations that are not understood."""
    whole = project(spark, d)
    scripts = whole.rejects().groupBy(c("script").alias("place"), c("text").alias("message")).agg(F.count(F.lit(1)).alias("n"))
    return whole.failures.select(c("folder").alias("place"), "message", c("files").alias("n")).unionAll(scripts)


@query("wf_enabled", f"SELECT process, script FROM ({PROCESS_SQL}) WHERE s_suppkey % 4 <> 0")
def wf_enabled(spark, d):
    files = parsed(spark, d)
    members = W.memberships(W.first_masters(files))
    return W.enabled(W.processes(files), members).select("process", "script")


@query(
    "wf_interval",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'P1D' WHEN 1 THEN (o_orderkey % 30)::VARCHAR || '.00:00:00'
         WHEN 2 THEN lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00:00' WHEN 3 THEN 'P2D' ELSE '00:30:00' END AS text,
       CASE o_orderkey % 5 WHEN 0 THEN '1D' WHEN 1 THEN (o_orderkey % 30)::VARCHAR || 'D'
         WHEN 2 THEN CASE WHEN o_orderkey % 24 = 0 THEN 'H' ELSE (o_orderkey % 24)::VARCHAR || 'H' END WHEN 3 THEN '2D' ELSE 'H' END AS code,
       CAST(CASE o_orderkey % 5 WHEN 0 THEN 1440 WHEN 1 THEN (o_orderkey % 30) * 1440 WHEN 2 THEN (o_orderkey % 24) * 60
         WHEN 3 THEN 2880 ELSE 30 END AS INT) AS minutes FROM orders""",
)
def wf_interval(spark, d):
    k, kind = c("o_orderkey"), F.pmod("o_orderkey", F.lit(5))
    text = (
        F.when(kind == 0, F.lit("P1D"))
        .when(kind == 1, F.concat((k % 30).cast("string"), F.lit(".00:00:00")))
        .when(kind == 2, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00")))
        .when(kind == 3, F.lit("P2D"))
        .otherwise(F.lit("00:30:00"))
    )
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return rows.select(
        "o_orderkey", "text", D.interval_code(c("text")).alias("code"), D.interval_minutes(c("text")).alias("minutes")
    )


@query(
    "wf_event_name",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Ev' || o_custkey WHEN 1 THEN o_orderstatus ELSE 'D' END AS event FROM orders""",
)
def wf_event_name(spark, d):
    kind = F.pmod("o_orderkey", F.lit(3))
    raw = (
        F.when(kind == 0, F.concat(F.lit("D:Ev"), c("o_custkey").cast("string"), F.lit("/a/b")))
        .when(kind == 1, c("o_orderstatus"))
        .otherwise(F.lit("d:D/"))
    )
    return table(spark, d, "orders").select("o_orderkey", D.event_name(raw).alias("event"))


@query(
    "wf_dep_edges",
    f"""SELECT script AS src, 'SCRIPT' AS src_type, event AS dst, 'EVENT' AS dst_type FROM ({PROCESS_SQL})
       UNION SELECT CASE WHEN s_nationkey = 3 THEN 'None' ELSE 'E' || (s_suppkey + 1) END, 'EVENT', script, 'SCRIPT' FROM ({PROCESS_SQL})
       UNION SELECT 'N' || s_nationkey, 'EVENT', script, 'SCRIPT' FROM ({PROCESS_SQL}) WHERE s_nationkey <> 3""",
)
def wf_dep_edges(spark, d):
    return W.dependency_edges(W.processes(parsed(spark, d)))


@query(
    "wf_dep_nodes",
    f"""WITH p AS ({PROCESS_SQL}), e AS (SELECT event AS name FROM p UNION SELECT 'None' FROM p WHERE s_nationkey = 3
         UNION SELECT 'E' || (s_suppkey + 1) FROM p WHERE s_nationkey <> 3 UNION SELECT 'N' || s_nationkey FROM p WHERE s_nationkey <> 3)
       SELECT e.name, 'EVENT' AS type, CASE WHEN interval_ IS NULL THEN e.name ELSE e.name || ' (' || interval_ || ')' END AS label,
         interval_ IS NULL AS is_external,
         CASE WHEN interval_ LIKE '%D' THEN 'lightblue' WHEN interval_ LIKE '%H' THEN 'palegoldenrod' ELSE 'gray' END AS colour
       FROM e LEFT JOIN p ON e.name = p.event UNION ALL SELECT script, 'SCRIPT', script, false, NULL FROM p""",
)
def wf_dep_nodes(spark, d):
    procs = cut_lineage(W.processes(parsed(spark, d)))
    rows = W.dependency_nodes(W.dependency_edges(procs), procs)
    colour = W.node_colour(c("type"), c("interval"))
    return rows.select("name", "type", "label", "is_external", colour.alias("colour"))


# The star as a graph: region -> nation -> customer -> order -> supplier.
def star_edges(spark, d):
    key = lambda letter, name: F.concat(F.lit(letter), c(name).cast("string"))
    n, cu = table(spark, d, "nation"), table(spark, d, "customer")
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    pairs = [
        n.select(key("R", "n_regionkey"), key("N", "n_nationkey")),
        cu.select(key("N", "c_nationkey"), key("C", "c_custkey")),
        o.select(key("C", "o_custkey"), key("O", "o_orderkey")),
        l.select(key("O", "l_orderkey"), key("S", "l_suppkey")),
    ]
    named = [p.toDF("src", "dst") for p in pairs]
    return named[0].unionAll(named[1]).unionAll(named[2]).unionAll(named[3])


DOWN_SQL = """r AS (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'), n AS (SELECT n_nationkey, n_regionkey FROM nation JOIN r ON n_regionkey = r_regionkey),
  c AS (SELECT c_custkey, c_nationkey FROM customer JOIN n ON c_nationkey = n_nationkey), o AS (SELECT o_orderkey, o_custkey FROM orders JOIN c ON o_custkey = c_custkey),
  down AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM n UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM c
    UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM o UNION SELECT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem JOIN o ON l_orderkey = o_orderkey)"""
UP_SQL = """s2 AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0), l2 AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem JOIN s2 ON l_suppkey = s_suppkey),
  o2 AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders JOIN l2 ON o_orderkey = l_orderkey), c2 AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN o2 ON c_custkey = o_custkey),
  n2 AS (SELECT DISTINCT n_nationkey, n_regionkey FROM nation JOIN c2 ON n_nationkey = c_nationkey),
  up AS (SELECT 'O' || l_orderkey AS src, 'S' || l_suppkey AS dst FROM l2 UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM o2
    UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM c2 UNION SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM n2)"""


def asia(spark, d):
    r = table(spark, d, "region").filter(c("r_name") == "ASIA")
    known = r.select(F.concat(F.lit("R"), c("r_regionkey").cast("string")).alias("name"))
    return known.unionAll(r.select(F.lit("unknown").alias("name")))


def in_debt(spark, d):
    s = table(spark, d, "supplier").filter(c("s_acctbal") < 0)
    return s.select(F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("name"))


@query("gr_trace_down", f"WITH {DOWN_SQL} SELECT src, dst FROM down")
def gr_trace_down(spark, d):
    return G.trace(star_edges(spark, d), asia(spark, d), "down")[1]


@query("gr_trace_down_nodes", f"WITH {DOWN_SQL} SELECT dst AS name FROM down UNION SELECT 'R' || r_regionkey FROM r")
def gr_trace_down_nodes(spark, d):
    return G.trace(star_edges(spark, d), asia(spark, d), "down")[0]


@query("gr_trace_up", f"WITH {UP_SQL} SELECT src, dst FROM up")
def gr_trace_up(spark, d):
    return G.trace(star_edges(spark, d), in_debt(spark, d), "up")[1]


CUSTOMER_UP_DOWN = """WITH c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < -500),
  n AS (SELECT DISTINCT n_nationkey, n_regionkey FROM nation JOIN c ON c_nationkey = n_nationkey), o AS (SELECT o_orderkey, o_custkey FROM orders JOIN c ON o_custkey = c_custkey)
  SELECT 'N' || c_nationkey AS src, 'C' || c_custkey AS dst FROM c UNION SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM n
  UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM o UNION SELECT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem JOIN o ON l_orderkey = o_orderkey"""


@query("gr_trace_both", CUSTOMER_UP_DOWN)
def gr_trace_both(spark, d):
    cu = table(spark, d, "customer").filter(c("c_acctbal") < -500)
    seeds = cu.select(F.concat(F.lit("C"), c("c_custkey").cast("string")).alias("name"))
    return G.trace(star_edges(spark, d), seeds, "both")[1]


def typed_edges(spark, d):
    """Customers and suppliers are scripts, orders the events between them, nations root events."""
    kind = lambda name: F.when(F.substring(name, 1, 1).isin("C", "S"), "SCRIPT").otherwise("EVENT")
    edges = star_edges(spark, d).filter(~c("src").startswith("R"))
    return edges.select("src", kind("src").alias("src_type"), "dst", kind("dst").alias("dst_type"))


@query(
    "gr_contract",
    """SELECT DISTINCT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer""",
)
def gr_contract(spark, d):
    return G.contract(typed_edges(spark, d))[1]


@query(
    "gr_contract_nodes",
    """SELECT DISTINCT 'C' || o_custkey AS name FROM orders
       UNION SELECT 'S' || l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       UNION SELECT 'N' || c_nationkey FROM customer UNION SELECT 'C' || c_custkey FROM customer""",
)
def gr_contract_nodes(spark, d):
    return G.contract(typed_edges(spark, d))[0]


KEYS = """SELECT p_partkey, p_name, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(replace(p_name, ' ', ''), '.script')
  WHEN 2 THEN concat(substr(replace(p_name, ' ', ''), 1, length(p_name) - 2), '.txt') WHEN 3 THEN concat('z', substr(p_name, 2), 'q')
  ELSE concat(substr(p_name, 3), substr(p_brand, 1, 3)) END AS key FROM part"""


@query(
    "wf_closest_match",
    f"""WITH n AS (SELECT DISTINCT p_name AS name, replace(p_name, ' ', '') || '.script' AS script FROM part),
       k AS (SELECT DISTINCT key, CASE WHEN contains(key, '.') THEN substr(key, 1, length(key) - position('.' IN reverse(key))) ELSE key END AS core
             FROM ({KEYS.replace("STRING", "VARCHAR")})),
       a AS (SELECT key, MIN(CASE WHEN name = key THEN name END) AS e, MIN(CASE WHEN script = key THEN name END) AS s,
               arg_min(name, script) FILTER (contains(script, core)) AS st, arg_min(name, (levenshtein(name, key), name)) AS nr,
               MIN(levenshtein(name, key)) AS dist FROM k, n GROUP BY key)
       SELECT key, CASE WHEN e IS NOT NULL THEN e WHEN s IS NOT NULL THEN s WHEN st IS NOT NULL THEN st WHEN dist < 2 * length(key) THEN nr ELSE key END AS process,
         CASE WHEN e IS NOT NULL THEN 'exact' WHEN s IS NOT NULL THEN 'script' WHEN st IS NOT NULL THEN 'stem' WHEN dist < 2 * length(key) THEN 'nearest' ELSE 'none' END AS stage
       FROM a""",
)
def wf_closest_match(spark, d):
    names = table(spark, d, "part").select(c("p_name").alias("process")).distinct()
    scripts = names.select(F.concat(F.replace("process", F.lit(" "), F.lit("")), F.lit(".script")).alias("script"), "process")
    return closest_process(source(spark, d, KEYS, "part").select("key"), names, scripts, chunk=200)  # a large catalog's way


@query(
    "wf_rollup",
    """SELECT r_name AS master, n_name AS group_, (rn - 1) // 1000 AS part, string_agg(s_name, ',' ORDER BY s_name) AS processes
       FROM (SELECT r_name, n_name, s_name, row_number() OVER (PARTITION BY r_name, n_name ORDER BY s_name) AS rn
             FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1, 2, 3""",
)
def wf_rollup(spark, d):
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    members = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rows = W.rollup(members.select(c("r_name").alias("master"), c("n_name").alias("group"), c("s_name").alias("process")))
    return rows.select("master", c("group").alias("group_"), "part", F.array_join("processes", ",").alias("processes"))


@query(
    "wf_rollup_parts",
    """SELECT master, group_, (rn - 1) // 1000 AS part, string_agg(process, ',' ORDER BY process) AS processes
       FROM (SELECT *, row_number() OVER (PARTITION BY master, group_ ORDER BY process) AS rn
             FROM (SELECT o_orderstatus AS master, 'all' AS group_, 'P' || o_orderkey AS process FROM orders)) GROUP BY 1, 2, 3""",
)
def wf_rollup_parts(spark, d):
    """Groups of thousands of names, worked on in ranges and cut into parts in the order of names."""
    name = F.concat(F.lit("P"), c("o_orderkey").cast("string"))
    members = table(spark, d, "orders").select(c("o_orderstatus").alias("master"), F.lit("all").alias("group"), name.alias("process"))
    rows = W.rollup(members, hot_rows=2000)
    return rows.select("master", c("group").alias("group_"), "part", F.array_join("processes", ",").alias("processes"))


@query("wf_targets", f"SELECT script AS name FROM ({PROCESS_SQL}) WHERE s_nationkey = 5 OR script IN ('S1.script', 'S2.script')")
def wf_targets(spark, d):
    return W.targets(W.processes(parsed(spark, d)), folder="/N5/", names=["S1.script", "S2.script"])


@query(
    "wf_failures",
    "SELECT '/cfg/N' || s_nationkey AS folder, 'not well-formed' AS message, COUNT(*) AS files FROM supplier WHERE s_acctbal < 0 GROUP BY 1",
)
def wf_failures(spark, d):
    return W.failures(parsed(spark, d))
