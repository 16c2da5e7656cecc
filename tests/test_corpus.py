"""Statement references in the shapes the language allows, and whole-script lineage."""

from pyspark.sql import functions as F

from rowflow.plans import corpus as C, lineage as L

CASES = [
    # plain names, aliases, comma lists and joins
    ("Cheap = SELECT Sku, Price FROM Shelf WHERE Price < 3", "Cheap", {"Shelf"}),
    ("SELECT T.Sku FROM Shelf AS T, Stock AS U, Depot WHERE T.Sku == U.Sku AND Depot.Id == U.Id", None, {"Shelf", "Stock", "Depot"}),
    ("Full = SELECT V.Van, D.City FROM Vans AS V FULL OUTER JOIN Drivers AS D ON V.Id == D.Van", "Full", {"Vans", "Drivers"}),
    ("Self = SELECT P.Id, Q.Id AS Next FROM Stops AS P INNER JOIN Stops AS Q ON P.Next == Q.Id", "Self", {"Stops"}),
    ("Gone = SELECT Sku FROM Shelf LEFT ANTISEMIJOIN Recalls ON Shelf.Sku == Recalls.Sku", "Gone", {"Shelf", "Recalls"}),
    ("Grid = SELECT * FROM Hours CROSS JOIN Lanes", "Grid", {"Hours", "Lanes"}),
    ("Top = SELECT TOP 9 Route, SUM(Km) AS Km", "Top", set()),
    # nested rowsets and set operators
    ("Net = SELECT City, SUM(Q) AS Q FROM (SELECT City, Q FROM Sent UNION ALL SELECT City, 0 - Q AS Q FROM Back)", "Net", {"Sent", "Back"}),
    ("Rest = SELECT Sku FROM Shelf EXCEPT (SELECT Sku FROM Sold INTERSECT SELECT Sku FROM Paid)", "Rest", {"Shelf", "Sold", "Paid"}),
    # lists of a subquery are not sources, at any depth of parentheses; neither are strings
    ("Q = SELECT Sku FROM Shelf WHERE Sku IN (SELECT Sku FROM Recalls) AND Price > 1", "Q", {"Shelf"}),
    ("Q = SELECT Sku FROM Shelf WHERE Sku IN (SELECT Sku FROM Recalls WHERE Norm(Year(Day) + (1)) == 1)", "Q", {"Shelf"}),
    ('Note = SELECT "sent FROM Depot" AS Msg, Sku FROM Sent', "Note", {"Sent"}),
    # stored streams, streamsets, texts, views and imports
    ("Old = SSTREAM @Archive", "Old", {"SSTREAM_@Archive"}),
    ('Km = SELECT Van, Km FROM (SSTREAM "/fleet/km.ss") AS K INNER JOIN Vans ON K.Van == Vans.Id', "Km", {'SSTREAM_"/fleet/km.ss"', "Vans"}),
    ('Days = SELECT * FROM (SSTREAM STREAMSET @Root PATTERN @"day%n.ss" RANGE __serialnum=["1", "7"])', "Days", {"SSTREAM<STREAMSET>_@Root"}),
    ("Lines = EXTRACT Sku:string, Q:int FROM @Feed USING DefaultTextExtractor", "Lines", {"EXTRACT_@Feed"}),
    ("Late = SELECT Van FROM (VIEW @Delays PARAMS(MIN = 5)) WHERE Van != null", "Late", {"VIEW_@Delays"}),
    ('IMPORT "/lib/fleet.script" AS Fleet PARAMS Day = @Today', "Fleet", {'IMPORT_"/lib/fleet.script"'}),
    # modules and functions
    ("Legs = Geo.Split(Input = Routes, Max = @Max)", "Legs", {"MODULE_Geo.Split"}),
    ("Fuel = SELECT Van FROM Geo.Refuel(DAY = @Day)", "Fuel", {"MODULE_Geo.Refuel"}),
    ("Pts = SELECT P.X FROM Routes CROSS APPLY Geo.Parse(Routes.Blob).Points AS P", "Pts", {"Routes", "FUNC_Geo.Parse(Routes.Blob).Points"}),
    ("Pts = SELECT P.X FROM Routes CROSS APPLY Geo.Parse(Zip.Open(Routes.Blob)).Points AS P", "Pts", {"Routes", "FUNC_Geo.Parse(Zip.Open(Routes.Blob)).Points"}),
    # user code
    ("Best = REDUCE Bids ON Lane PRESORT Price USING Auction.First(1)", "Best", {"Bids"}),
    ("Best = REDUCE (SELECT Lane, Price FROM Offers) ON Lane USING Auction.First", "Best", {"Offers"}),
    ("Due = COMBINE Bills AS B WITH Payments AS P ON B.Id == P.Bill USING Ledger.Match", "Due", {"Bills", "Payments"}),
    ("Due = COMBINE Bills AS B WITH (SSTREAM @Paid) AS P ON B.Id == P.Bill USING Ledger.Match", "Due", {"Bills", "(SSTREAM@Paid)"}),
    ("Tidy = PROCESS Addresses PRODUCE Street, City USING Post.Clean() HAVING City != null", "Tidy", {"Addresses"}),
    ("PROCESS USING Post.Clean()", None, set()),
]


def test_references(spark):
    rows = [(f"s{i:03d}", text) for i, (text, _, _) in enumerate(CASES)]
    stmts = C.statements(spark.createDataFrame(rows, "script string, text string"))
    got = {}
    for r in C.references(C.facts(stmts)).collect():
        assign, names = got.setdefault(r.script, (r.assign_var, set()))
        names.update([r.source] if r.source else [])
    for i, (text, assign, names) in enumerate(CASES):
        assert got[f"s{i:03d}"] == (assign, names), text


OUTPUT_CASES = [
    ("OUTPUT Net TO SSTREAM @Ledger CLUSTERED BY City SORTED BY Q", [("Net", "@Ledger", True, False)]),
    ('OUTPUT TO "/tmp/routes.txt"', [(None, '"/tmp/routes.txt"', False, False)]),
    ('OUTPUT Legs TO SSTREAM "/fleet/legs.ss" PARTITIONED BY Day WITH STREAMEXPIRY "90"', [("Legs", '"/fleet/legs.ss"', True, True)]),
    ("OUTPUT (SELECT Van FROM Vans WHERE Km > 0) TO @Active USING Post.Writer()", [("Vans", "@Active", False, False)]),
    (
        'OUTPUT (SELECT Sku FROM Sold UNION ALL SELECT Sku FROM Sent) TO SSTREAM "/shop/@@Day@@.ss"',
        [("Sold", '"/shop/@@Day@@.ss"', True, False), ("Sent", '"/shop/@@Day@@.ss"', True, False)],
    ),
    ("OUTPUT Split.Rejected TO @Rejects", [("Split", "@Rejects", False, False)]),
]


def test_outputs(spark):
    rows = [(f"s{i}", text) for i, (text, _) in enumerate(OUTPUT_CASES)]
    got = {}
    for r in C.outputs(C.facts(C.statements(spark.createDataFrame(rows, "script string, text string")))).collect():
        got.setdefault(r.script, []).append((r.source, r.path, r.is_sstream, r.is_partitioned))
    for i, (text, want) in enumerate(OUTPUT_CASES):
        assert sorted(got[f"s{i}"], key=str) == sorted(want, key=str), text


def lineage(spark, text):
    scripts = spark.createDataFrame([("s", text)], "script string, text string")
    facts = C.facts(C.statements(C.prepare(scripts)))
    return facts, L.edges(facts)


def test_branching_script(spark):
    """One source read twice, user code, a union of both branches and an output of the latest rowset."""
    text = """#DECLARE Feed string = "/shop/feed.txt";
Lines = EXTRACT Sku:string, Q:int FROM @Feed USING DefaultTextExtractor();
Few = SELECT Sku, Q FROM Lines WHERE Q < 10;
Many = REDUCE Lines ON Sku USING Shop.Bulk();
OUTPUT Many TO "/shop/bulk.txt";
All = SELECT Sku FROM Few UNION ALL SELECT Sku FROM Many;
OUTPUT TO SSTREAM @Skus;
"""
    facts, edges = lineage(spark, text)
    assert {(r.src, r.dst) for r in edges.collect()} == {
        ("EXTRACT_@Feed", "Lines"), ("Lines", "Few"), ("Lines", "Many"), ("Many", '"/shop/bulk.txt"'),
        ("Few", "All"), ("Many", "All"), ("All", "@Skus"),
    }


def test_reassignment_reads_the_old_version(spark):
    _, edges = lineage(spark, "X = SELECT A FROM (SSTREAM @I); X = SELECT A FROM X; Y = SELECT A FROM X; OUTPUT X TO @O")
    got = {(r.src, r.src_version, r.dst, r.dst_version) for r in edges.collect()}
    assert got == {
        ("SSTREAM_@I", -1, "X", 0), ("X", 0, "X", 1), ("X", 1, "Y", 2), ("X", 1, "@O", -1),
    }


def test_nothing_named_yet(spark):
    _, edges = lineage(spark, "SELECT A FROM (SSTREAM @I); OUTPUT TO @O")
    assert {(r.src, r.dst) for r in edges.collect()} == {("SSTREAM_@I", L.IMPLICIT), (L.IMPLICIT, "@O")}


def test_versions_across_blocks(spark):
    """One script of many statements, cut into several blocks."""
    text = ";".join(["X = SELECT A FROM (SSTREAM @I)"] + ["X = SELECT A FROM X"] * 2500)
    _, edges = lineage(spark, text)
    chain = {(r.src_version, r.dst_version) for r in edges.filter(F.col("src") == "X").collect()}
    assert chain == {(i, i + 1) for i in range(2500)}


def test_loops_and_conditionals(spark):
    text = "#DECLARE N int = 2;\n#IF (x)\nA;\n#ELSE\nB;\n#ENDIF\nLOOP(I, @N)\n{\nC@@I@@ = string.Format(\"{0}\", 1);\n}\nD"
    row = C.prepare(spark.createDataFrame([("s", text)], "script string, text string")).first()
    kept = [line for line in row.text.split("\n") if line]
    assert kept == ["#DECLARE N int = 2;", "A;", "B;", 'C0 = string.Format("{0}", 1);', 'C1 = string.Format("{0}", 1);', "D"]


def test_open_and_stray_marks(spark):
    texts = ["a\n#ENDIF b\n#IF x\nc", "LOOP(I, 2)\n{ x@@I@@", "} y {", "LOOP(I, @M) { z@@I@@ } w", "LOOP(I, 0)\n{\nq\n}r", 'p = "LOOP(I, 2) {"; }']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "i int, t string")
    got = {r.i: (r.d, r.l) for r in rows.select("i", C.flatten_conditionals(F.col("t"), keep=False).alias("d"), C.expand_loops(F.col("t")).alias("l")).collect()}
    assert got[0][0] == "a\n b\n" and got[1][1] == texts[1] and got[2][1] == texts[2]
    assert got[3][1] == " z@@I@@  w" and got[4][1] == "\nr" and got[5][1] == texts[5]
    assert got[6] == (None, None) and got[7] == ("", "")


def test_hints_leave_indexing_alone(spark):
    text = "X = SELECT a[0] AS k, m[key] AS l, f(x)[i] AS n FROM T[ROWCOUNT=100] [SKEW=(A=1)] [Few(a), Pinned] ON a == b[j];"
    got = spark.createDataFrame([(text,)], "t string").select(C.strip_hints(F.col("t")).alias("x"), C.list_hints(F.col("t")).alias("h")).first()
    assert got.x == "X = SELECT a[0] AS k, m[key] AS l, f(x)[i] AS n FROM T   ON a == b[j];"
    assert got.h == ["[ROWCOUNT=100]", "[SKEW=(A=1)]", "[Few(a), Pinned]"]


def test_tables_of_facts_read_a_statement_once(spark):
    """Spark moves filters below the projection that makes the facts; they must not bring its patterns along."""
    facts = C.facts(spark.createDataFrame([("s", 0, "A = SELECT x FROM B")], "script string, pos int, text string"))
    passes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("CROSS APPLY")
    assert passes(C.references(facts)) == passes(facts)
    assert passes(C.outputs(facts)) == passes(C.declares(facts)) == 0


def test_edges_of_short_scripts_take_one_shuffle(spark):
    text = [("s", i, f"A{i} = SELECT x FROM A{i - 1}") for i in range(3)]
    facts = C.facts(spark.createDataFrame(text, "script string, pos int, text string")).localCheckpoint()
    edges = L.edges(facts)
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert edges.count() == 3


def test_short_and_long_scripts_side_by_side(spark):
    rows = [(s, p, t) for s in ("short", "long") for p, t in [(0, "A = SSTREAM @In"), (1, "B = SELECT x FROM A"), (2, "OUTPUT B TO @Out")]]
    rows.append(("long", 2500, "C = SELECT x FROM B"))
    facts = C.facts(spark.createDataFrame(rows, "script string, pos int, text string")).localCheckpoint()
    found = {(r.script, r.kind, r.src, r.src_version, r.dst) for r in L.edges(facts).collect()}
    each = [("read", "SSTREAM_@In", -1, "A"), ("read", "A", 0, "B"), ("output", "B", 1, "@Out")]
    assert found == {(s, *e) for s in ("short", "long") for e in each} | {("long", "read", "B", 1, "C")}


def test_loop_bodies_are_read_once(spark):
    """A body doubles with each loop around it: its last line is found without a pattern, once a copy."""
    bodies = ["{x@@i@@;}", "{\nx@@i@@;\n}", "{\nx@@i@@;\n  }", "{}", "{\n}"]
    rows = spark.createDataFrame([(i, f"LOOP(i, 2)\n{b}z") for i, b in enumerate(bodies)], "script int, text string")
    done = rows.select("script", C.expand_loops(F.col("text")).alias("text"))
    assert "(.*)" not in done._jdf.queryExecution().optimizedPlan().toString()
    want = ["x0;x1;z", "\nx0;\nx1;\nz", "\nx0;\nx1;\n  z", "z", "\nz"]
    assert [r.text for r in done.orderBy("script").collect()] == want


def test_links_broadcast_no_declarations(spark):
    """Declarations grow with the scripts, however small Spark takes them to be: they meet the names by shuffles."""
    names = [("s", "SSTREAM_@In", "input"), ("s", "@In", "output"), ("s", "@Out", "output"), ("s", "@DebugOut", "output"),
             ("s", "EXTRACT_@Out", "input"), ("t", "SSTREAM_@In", "input"), ("t", "@Odd", "output"), (None, "@Out", "output")]
    nodes = spark.createDataFrame(names * 2, "script string, name string, type string")
    values = "VALUES ('s', 'In', '\"/in\"'), ('s', 'Out', '/%Y?date'), ('s', 'DebugOut', '/d'), ('t', 'In', '/t'), ('t', 'Out', '/o'), (NULL, 'Out', '/n')"
    declared = spark.sql(f"SELECT * FROM {values} AS v(script, key, value)")
    done = L.links(nodes, declared, F.lit("2018-12-12").cast("timestamp_ntz"), "p")
    got = sorted(map(tuple, done.collect()))
    assert got == [("s", "@In", "p/in?property=info"), ("s", "@Out", "p/2018?property=info"), ("s", "SSTREAM_@In", "p/in?property=info"),
                   ("t", "SSTREAM_@In", "p/t?property=info")]
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
