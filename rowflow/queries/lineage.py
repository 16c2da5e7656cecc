"""Lineage queries over the spliced corpus, the event stream and the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowflow.plans import corpus as C, lineage as L
from rowflow.queries.corpus import expected, spliced, statements
from rowflow.queries.parameters import source
from rowflow.queries.registry import query, table
from rowflow.session import cut_lineage

c = F.col


@query(
    "lin_version_edges",
    """WITH s AS (SELECT event_id, user_id, event_type AS made,
           CASE WHEN n % 5 = 0 THEN 'click' WHEN n % 5 = 1 THEN 'view' WHEN n % 5 = 2 THEN 'purchase' WHEN n % 5 = 3 THEN 'error' ELSE 'raw' END AS name,
           epoch_us(ts) AS pos
         FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS n FROM events)),
       m AS (SELECT user_id, made AS name, pos FROM s)
       SELECT s.event_id, s.user_id, s.name, COALESCE(m.pos, -1) AS version
       FROM s ASOF LEFT JOIN m ON s.user_id = m.user_id AND s.name = m.name AND s.pos > m.pos""",
)
def lin_version_edges(spark, d):
    """Events as a statement stream: a user's event makes a version of its type and reads
    another type, picked by its payload."""
    n = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 5
    reads = F.when(n == 0, "click").when(n == 1, "view").when(n == 2, "purchase").when(n == 3, "error").otherwise("raw")
    pos = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c("ts"))
    s = table(spark, d, "events").select(
        "event_id", c("user_id").alias("script"), c("event_type").alias("made"), reads.alias("name"), pos.alias("pos")
    )
    defs = s.select("script", c("made").alias("name"), "pos")
    minute = F.floor(c("pos") / 60_000_000)
    bound = L.bind_versions(s.drop("made"), defs, minute, hot_rows=1_000_000)
    return bound.select("event_id", c("script").alias("user_id"), "name", "version")


@query(
    "lin_implicit_prev",
    """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN turn END AS target,
         MAX(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
       FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)""",
)
def lin_implicit_prev(spark, d):
    """An assistant turn names a result, other turns read the latest one."""
    t = table(spark, d, "conversations").select(
        c("conv_id").alias("script"), c("turn").alias("pos"), F.when(c("role") == "assistant", c("turn")).alias("target")
    ).distinct()
    done = L.previous_target(t)
    return done.select(c("script").alias("conv_id"), c("pos").alias("turn"), "target", "prev")


def corpus_facts(spark, d):
    """Facts of the corpus, written once: the lineage below reads them several times."""
    return cut_lineage(C.facts(statements(spark, d)))


def corpus_edges(spark, d):
    return L.edges(corpus_facts(spark, d))


READ_EDGES = [
    ("SSTREAM_@InFile", -1, "Raw", 4),
    ('EXTRACT_"/txt/#P.txt"', -1, "Words", 5),
    ("Raw", 4, "Both", 6),
    ("Words", 5, "Both", 6),
    ("Raw", 4, "Raw", 7),
    ("Both", 6, "Top", 8),
    ("Top", 8, "Top", 8),
    ("SSTREAM<STREAMSET>_@Base", -1, "Set", 10),
    ("VIEW_@MyView", -1, "Seen", 11),
    ("MODULE_Mod.Make", -1, "Made", 12),
    ("Both", 6, "Points", 13),
    ("FUNC_Lib.Read<T>(A.Blob).Points", -1, "Points", 13),
    ("Top", 8, "All", 14),
    ("Words", 5, "All", 14),
    ("Raw", 7, "All", 14),
    ("Top", 8, "Scored", 15),
    ("(SSTREAM@Side)", -1, "Scored", 15),
    ("Top.Best", -1, "Kept", 16),
    ("Top", 8, "Pair", 17),
    ("Words", 5, "Pair", 17),
]
OUTPUT_EDGES = [
    ("Top", 8, "@OutFile"),
    ("Pair", 17, '"/log/#P.txt"'),
    ("Made", 12, "@Copy"),
    ("Raw", 7, "@Copy"),
    ("Seen", 11, "@Copy"),
    ("Pair", 17, '"/debug/#P.ss"'),
]


@query("lin_read_edges", expected(READ_EDGES, "src, src_version, dst, dst_version", (0,)))
def lin_read_edges(spark, d):
    return corpus_edges(spark, d).filter(c("kind") == "read").drop("kind")


@query("lin_output_edges", expected(OUTPUT_EDGES, "src, src_version, dst", (2,)))
def lin_output_edges(spark, d):
    return corpus_edges(spark, d).filter(c("kind") == "output").drop("kind", "dst_version")


@query("lin_dotted_parent", expected([("Top", 8, "Top.Best")], "src, src_version, dst"))
def lin_dotted_parent(spark, d):
    return corpus_edges(spark, d).filter(c("kind") == "parent").drop("kind", "dst_version")


@query("lin_module_params", expected([("Both", 6, "MODULE_Mod.Make")], "src, src_version, dst"))
def lin_module_params(spark, d):
    return corpus_edges(spark, d).filter(c("kind") == "param").drop("kind", "dst_version")


NODE_CLASSES = [
    ("SSTREAM_@InFile", "input", "greenyellow"),
    ('EXTRACT_"/txt/#P.txt"', "input", "honeydew"),
    ("Raw", None, None),
    ("Words", None, None),
    ("Both", None, None),
    ("Top", None, "yellow"),
    ("SSTREAM<STREAMSET>_@Base", "input", "wheat"),
    ("Set", None, None),
    ("VIEW_@MyView", "input", "lightpink"),
    ("Seen", None, None),
    ("MODULE_Mod.Make", "input", "sandybrown"),
    ("Made", None, None),
    ("FUNC_Lib.Read<T>(A.Blob).Points", "input", "lightblue"),
    ("Points", None, None),
    ("All", None, None),
    ("(SSTREAM@Side)", None, None),
    ("Scored", None, "yellow"),
    ("Top.Best", None, None),
    ("Kept", None, "yellow"),
    ("Pair", None, None),
    ("@OutFile", "output", "tomato"),
    ('"/log/#P.txt"', "output", "tomato"),
    ("@Copy", "output", "tomato"),
    ('"/debug/#P.ss"', "output", "tomato"),
]


@query("lin_node_class", expected(NODE_CLASSES, "name, type, fillcolor", (0,)))
def lin_node_class(spark, d):
    facts = corpus_facts(spark, d)
    return L.nodes(L.edges(facts), facts).select("script", "name", "type", "fillcolor").distinct()


@query("lin_view_qualify", expected([("First", "<First>_A"), ("Second", "<Second>_B")], "view, node"))
def lin_view_qualify(spark, d):
    module = "VIEW First RETURN x BEGIN~A = SELECT Id FROM (SSTREAM @#K);~END VIEW~VIEW Second RETURN x BEGIN~B = SELECT * FROM T#K;~END VIEW"
    views = C.module_views(source(spark, d, spliced(module), "part").select(c("script").alias("module"), "text"))
    keyed = views.select(F.concat_ws("|", "module", "view").alias("script"), "text")
    refs = C.references(C.facts(C.statements(C.prepare(keyed))))
    parts = refs.select(F.split("script", r"\|").alias("p"), "assign_var")
    return parts.select(
        c("p")[0].alias("script"), c("p")[1].alias("view"), L.qualify(c("p")[1], c("assign_var")).alias("node")
    )


PORTAL = "https://portal.example/store"


@query(
    "lin_links",
    expected(
        [
            ("SSTREAM_@InFile", PORTAL + "/data/#P/in_2018.ss?property=info"),
            ("@OutFile", PORTAL + "/out2/#P.ss?property=info"),
        ],
        "name, href",
        (1,),
    ),
)
def lin_links(spark, d):
    facts = corpus_facts(spark, d)
    rows = L.nodes(L.edges(facts), facts)
    return L.links(rows, L.resolved(C.declares(facts)), F.lit("2018-12-12").cast("timestamp_ntz"), PORTAL)


RESOLVED = """#DECLARE Root string = "/d/#P";~#DECLARE Day DateTime = DateTime.Parse("2018-03-04");~
#DECLARE In string = string.Format("{0}/%Y/in_{1:yyyyMMdd}_#K.ss", @Root, @Day);~
#DECLARE Out string = @Root + "/out_" + @Day.AddDays( - 1).ToString("yyyyMMdd") + ".ss";~#SET Root = "/late";~
#DECLARE Odd string = Custom(@Root);~A = SELECT X FROM (SSTREAM @In);~OUTPUT A TO SSTREAM @Out;~OUTPUT A TO @Odd;~"""


@query(
    "lin_links_resolved",
    expected(
        [
            ("SSTREAM_@In", PORTAL + "/d/#P/2018/in_20180304_#K.ss?property=info"),
            ("@Out", PORTAL + "/d/#P/out_20180303.ss?property=info"),
        ],
        "name, href",
        (1,),
    ),
)
def lin_links_resolved(spark, d):
    """Links over evaluated declares; a path that is not understood has none."""
    scripts = source(spark, d, spliced(RESOLVED.replace("\n", "")), "part").select("script", "text")
    facts = cut_lineage(C.facts(C.statements(C.prepare(scripts))))
    return L.links(L.nodes(L.edges(facts), facts), L.resolved(C.declares(facts)), F.lit("2018-12-12").cast("timestamp_ntz"), PORTAL)


@query(
    "lin_export",
    "SELECT DISTINCT script, src, dst, '\"' || replace(src, '\"', '\\\"') || '\" -> \"' || replace(dst, '\"', '\\\"') || '\";' AS line FROM ("
    + expected([(s, t) for s, _, t, _ in READ_EDGES] + [(s, t) for s, _, t in OUTPUT_EDGES]
               + [("Top", "Top.Best"), ("Both", "MODULE_Mod.Make")], "src, dst", (0, 1))
    + ")",
)
def lin_export(spark, d):
    return L.export_edges(corpus_edges(spark, d))


SAMPLE = """#DECLARE Feed string = "/shop/#K.txt";~Lines = EXTRACT Sku:string, Q:int FROM @Feed USING DefaultTextExtractor();~
Few = SELECT Sku, Q FROM Lines WHERE Q < 10;~Many = REDUCE Lines ON Sku USING Shop.Bulk();~
OUTPUT Many TO SSTREAM "/shop/#K.ss";~All = SELECT Sku FROM Few UNION ALL SELECT Sku FROM Many;~OUTPUT TO SSTREAM @Skus;~"""


@query(
    "lin_sample_script",
    expected(
        [
            ("EXTRACT_@Feed", "Lines"),
            ("Lines", "Few"),
            ("Lines", "Many"),
            ("Many", '"/shop/#K.ss"'),
            ("Few", "All"),
            ("Many", "All"),
            ("All", "@Skus"),
        ],
        "src, dst",
        (1,),
    ),
)
def lin_sample_script(spark, d):
    """One source read twice, user code, a union of both branches, a named output and one of the latest rowset."""
    scripts = source(spark, d, spliced(SAMPLE.replace("\n", "")), "part").select("script", "text")
    facts = cut_lineage(C.facts(C.statements(C.prepare(scripts))))
    return L.export_edges(L.edges(facts)).drop("line")
