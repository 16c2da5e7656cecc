"""Corpus queries. Script texts are spliced from part rows by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowflow.plans import corpus as C
from rowflow.queries.parameters import source
from rowflow.queries.registry import query, table

c = F.col


def spliced(template: str) -> str:
    """SQL of ``(script, text)`` per part: ~ is a line end, #P the part name, #K its key."""
    return (
        "SELECT concat('s', CAST(p_partkey AS STRING)) AS script, p_name, p_partkey, "
        f"replace(replace(replace('{template}', '~', chr(10)), '#P', p_name), '#K', CAST(p_partkey AS STRING)) AS text FROM part"
    )


def expected(rows: list[tuple], columns: str, text_columns: tuple[int, ...] = ()) -> str:
    """SQL of fixed rows per part, with the same splices in the text columns."""

    def cell(i, v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return str(v) if isinstance(v, int) else f"'{v}'"

    names = [n.strip() for n in columns.split(",")]
    values = ", ".join("(" + ", ".join(cell(i, v) for i, v in enumerate(r)) + ")" for r in rows)
    shown = ", ".join(
        f"replace(replace(replace(CAST({n} AS VARCHAR), '~', chr(10)), '#P', p_name), '#K', CAST(p_partkey AS VARCHAR)) AS {n}"
        if i in text_columns
        else n
        for i, n in enumerate(names)
    )
    return f"SELECT 's' || p_partkey AS script, {shown} FROM part, (VALUES {values}) t({columns})"


COMMENTED = 'A = "x//#P/*y*/"; // tail #P~B = 1 /* two~lines; "q" */ + 2; /**/C~// "end'


@query("cor_strip_comments", expected([('A = "x//#P/*y*/";  ~B = 1   + 2;  C~ ',)], "text", (0,)))
def cor_strip_comments(spark, d):
    return source(spark, d, spliced(COMMENTED), "part").select("script", C.strip_comments(c("text")).alias("text"))


BRANCHED = "a;~#IF (@X == #K)~b #P;~#ELSE~c;~#ENDIF~d;~#IF(1)~e~#IF(2)~f~#ENDIF~g~#ENDIF~h"


@query(
    "cor_conditionals",
    expected([("a;~b #P;~~c;~~d;~e~f~~g~~h", "a;~~d;~~h")], "kept, dropped", (0, 1)),
)
def cor_conditionals(spark, d):
    s = source(spark, d, spliced(BRANCHED), "part")
    return s.select(
        "script",
        C.flatten_conditionals(c("text")).alias("kept"),
        C.flatten_conditionals(c("text"), keep=False).alias("dropped"),
    )


LOOPED = '#DECLARE N int = 12;~LOOP(I, 3)~{~  X@@I@@ = "#P{0}";~}~y;~LOOP (J, @N) {~z@@J@@;~} tail~LOOP(K, @Unknown)~{~k@@K@@;~}~end'


@query(
    "cor_expand_loop",
    """SELECT 's' || p_partkey AS script, replace('#DECLARE N int = 12;~~  X0 = "#P{0}";~  X1 = "#P{0}";~  X2 = "#P{0}";~~y;~'
         || (SELECT string_agg('~z' || i || ';', '' ORDER BY i) FROM range(12) t(i)) || '~ tail~~k@@K@@;~~end', '~', chr(10))
         .replace('#P', p_name) AS text FROM part""",
)
def cor_expand_loop(spark, d):
    return source(spark, d, spliced(LOOPED), "part").select("script", C.expand_loops(c("text")).alias("text"))


HINTED = "A [ROWCOUNT=100] b [LOWDISTINCTNESS(#K)]~c [PARTITION=(PARTITIONCOUNT=2000)] [Privacy.Asset.x] d [ PARTITION(Q, D) ] e[0] #P"


@query(
    "cor_strip_hints",
    expected(
        [("A  b ~c   d  e[0] #P", "[ROWCOUNT=100]|[LOWDISTINCTNESS(#K)]|[PARTITION=(PARTITIONCOUNT=2000)]|[Privacy.Asset.x]|[ PARTITION(Q, D) ]")],
        "text, hints",
        (0, 1),
    ),
)
def cor_strip_hints(spark, d):
    s = source(spark, d, spliced(HINTED), "part")
    return s.select(
        "script", C.strip_hints(c("text")).alias("text"), F.array_join(C.list_hints(c("text")), "|").alias("hints")
    )


@query(
    "cor_ascii_clean",
    r"""SELECT doc_id, array_to_string([x for x in [regexp_replace(y, '[ \t\r\f\v]+$', '') for y in
         string_split(replace(replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), ''';''', ''), '";"', ''), chr(10))]
         if x <> ''], chr(10)) AS text FROM documents""",
)
def cor_ascii_clean(spark, d):
    text = C.drop_blank_lines(C.drop_quoted_semicolons(C.ascii_only(c("text"))))
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


STATEMENTS = [
    '#DECLARE InFile string = "/data/#P/in_%Y.ss?date=2018-01-01";',
    '#DECLARE OutFile string = @"/out/#P.ss"; // written below;',
    "#DECLARE Copies int = 2;",
    '#SET OutFile = "/out2/#P.ss";',
    '/* first; part */ Raw = SELECT Id, "a//b" AS Url FROM (SSTREAM @InFile);',
    'Words = EXTRACT Word:string FROM "/txt/#P.txt" USING DefaultTextExtractor();',
    "Both = SELECT Raw.Id FROM Raw INNER JOIN Words ON Raw.Id == Words.Word [ROWCOUNT=100];",
    "Raw = SELECT * FROM Raw~ WHERE Id != 0;",
    "Top = REDUCE Both ON Id PRESORT Id DESC USING TopNReducer(5);",
    "SELECT Id, COUNT() AS N;",
    'Set = SELECT *, __serialnum AS N FROM (SSTREAM STREAMSET @Base PATTERN @"f%n.ss" RANGE __serialnum=["0", "6"]);',
    "Seen = VIEW @MyView PARAMS(A = @Copies);",
    'Made = Mod.Make(Input = Both, Mode = "m", Other = Nowhere);',
    "Points = SELECT L.Pos FROM Both AS A CROSS APPLY Lib.Read<T>(A.Blob).Points AS L;",
    "All = (SELECT Id FROM Top UNION ALL SELECT Id FROM Words) EXCEPT SELECT Id FROM Raw;",
    'Scored = COMBINE Top AS L WITH (SSTREAM @Side) AS R ON L.Id == R.Id USING TfCombiner("x");',
    'Kept = PROCESS Top.Best PRODUCE Id USING Filter() HAVING Id != "";',
    "Pair = SELECT * FROM Top AS T, Words AS W WHERE T.Id IN (SELECT Id FROM Hidden);",
    "OUTPUT Top TO SSTREAM @OutFile CLUSTERED BY Id;",
    'OUTPUT TO "/log/#P.txt";',
    "OUTPUT (SELECT * FROM Made UNION ALL SELECT * FROM Raw UNION ALL SELECT * FROM Seen) TO @Copy PARTITIONED BY Id;",
    'OUTPUT Lost TO SSTREAM "/debug/#P.ss";',
    "#CS class X { int a; } Y = SELECT Id FROM Never;",
]
SCRIPTS = spliced("~".join(STATEMENTS))
KINDS = (
    "DECLARE DECLARE DECLARE SET SELECT EXTRACT SELECT SELECT REDUCE SELECT SELECT VIEW MODULE SELECT SELECT "
    "COMBINE PROCESS SELECT OUTPUT OUTPUT OUTPUT OUTPUT"
).split()


def statements(spark, d):
    return C.statements(C.prepare(source(spark, d, SCRIPTS, "part").select("script", "text")))


def cleaned(text: str) -> str:
    """A statement as the passes leave it, for the expected rows."""
    text = text.replace("/* first; part */", " ").replace(" // written below;", "").replace(" [ROWCOUNT=100]", " ")
    return text.replace(";", "")


def lead(i: int) -> str:
    """What stands before a statement: a line end, and the space that a comment leaves."""
    return ("  " if i and "// written" in STATEMENTS[i - 1] else "") + ("~" if i else "")


@query("cor_statements", expected([(i, lead(i) + cleaned(s)) for i, s in enumerate(STATEMENTS[:-1])], "pos, text", (1,)))
def cor_statements(spark, d):
    return statements(spark, d)


@query("cor_kinds", expected(list(enumerate(KINDS)), "pos, kind"))
def cor_kinds(spark, d):
    return C.with_kinds(statements(spark, d)).drop("text")


@query(
    "cor_declares",
    expected(
        [
            (0, "InFile", "string", '"/data/#P/in_%Y.ss?date=2018-01-01"'),
            (1, "OutFile", "string", '@"/out/#P.ss"'),
            (2, "Copies", "int", "2"),
            (3, "OutFile", None, '"/out2/#P.ss"'),
        ],
        "pos, key, type, value",
        (3,),
    ),
)
def cor_declares(spark, d):
    return C.declares(C.facts(statements(spark, d)))


REFERENCES = [
    (4, "Raw", "SSTREAM_@InFile", "SSTREAM"),
    (5, "Words", 'EXTRACT_"/txt/#P.txt"', "EXTRACT"),
    (6, "Both", "Raw", "table"),
    (6, "Both", "Words", "table"),
    (7, "Raw", "Raw", "table"),
    (8, "Top", "Both", "table"),
    (9, None, None, None),
    (10, "Set", "SSTREAM<STREAMSET>_@Base", "SSTREAM<STREAMSET>"),
    (11, "Seen", "VIEW_@MyView", "VIEW"),
    (12, "Made", "MODULE_Mod.Make", "MODULE"),
    (13, "Points", "Both", "table"),
    (13, "Points", "FUNC_Lib.Read<T>(A.Blob).Points", "FUNC"),
    (14, "All", "Top", "table"),
    (14, "All", "Words", "table"),
    (14, "All", "Raw", "table"),
    (15, "Scored", "Top", "table"),
    (15, "Scored", "(SSTREAM@Side)", "SSTREAM"),
    (16, "Kept", "Top.Best", "table"),
    (17, "Pair", "Top", "table"),
    (17, "Pair", "Words", "table"),
]


@query("cor_references", expected(REFERENCES, "pos, assign_var, source, source_type", (2,)))
def cor_references(spark, d):
    return C.references(C.facts(statements(spark, d)))


OUTPUTS = [
    (18, "Top", "@OutFile", True, False),
    (19, None, '"/log/#P.txt"', False, False),
    (20, "Made", "@Copy", False, True),
    (20, "Raw", "@Copy", False, True),
    (20, "Seen", "@Copy", False, True),
    (21, "Lost", '"/debug/#P.ss"', True, False),
]


@query("cor_outputs", expected(OUTPUTS, "pos, source, path, is_sstream, is_partitioned", (2,)))
def cor_outputs(spark, d):
    return C.outputs(C.facts(statements(spark, d)))


MODULE = "MODULE m~VIEW First RETURN ROWSET(#P)~BEGIN~A = 1;~END VIEW~VIEW Second RETURN x BEGIN~B = #K;~END VIEW~"


@query(
    "cor_module_views",
    expected([("First", "~A = 1;~", "plain #P"), ("Second", "~B = #K;~", "plain #P")], "view, text, body", (1, 2)),
)
def cor_module_views(spark, d):
    s = source(spark, d, spliced(MODULE), "part")
    views = C.module_views(s.select(c("script").alias("module"), "text"))
    # The same parts as view files: the body of CREATE VIEW, other text unchanged.
    files = source(spark, d, spliced("CREATE VIEW v AS BEGINplain #PEND;"), "part")
    bodies = files.select("script", C.view_body(c("text")).alias("body"))
    return views.withColumnRenamed("module", "script").join(bodies, "script")


#: Texts that nest 1 to 10 deep, by row; n is a line end.
DEEP = """SELECT concat('s', CAST(p_partkey AS STRING)) AS script, p_name, k,
  concat('a;', n, repeat(concat('#IF (x)', n), k), 'in ', p_name, ';', n, repeat(concat('#ELSE', n, '#ENDIF', n), k), 'z;') AS branched,
  concat(repeat(concat('LOOP(I, 2)', n, '{', n), k), 'x@@I@@ = "{";', repeat(concat(n, '}'), k), n, 'y;') AS looped,
  concat('Q = SELECT a FROM T', CAST(k AS STRING), ' WHERE a IN (SELECT b FROM H WHERE ', repeat('f(', k), 'c', repeat(')', k),
    ' == 1 AND b IN ', repeat('(SELECT e FROM G WHERE e IN ', k), '(SELECT h FROM K)', repeat(')', k), ') AND d == 1') AS asked,
  concat('R = SELECT p FROM T CROSS APPLY Lib.Read(', repeat('g(', k), 'T.Blob', repeat(')', k), ', "((").Rows AS q') AS applied,
  concat(repeat(concat('VIEW V RETURN x BEGIN', n, 'a;'), k), repeat(concat('b;', n, 'END VIEW', n), k)) AS module
  FROM (SELECT p_partkey, p_name, CAST(p_partkey % 10 + 1 AS INT) AS k, chr(10) AS n FROM part)"""


@query(
    "cor_nesting",
    f"""SELECT script, 'a;' || chr(10) || 'in ' || p_name || ';' || chr(10) || repeat(chr(10) || chr(10), k) || 'z;' AS kept,
         'a;' || chr(10) || chr(10) || 'z;' AS dropped,
         repeat('x0 = "{{";' || chr(10) || 'x1 = "{{";' || chr(10), CAST(2 ** (k - 1) AS INT)) || 'y;' AS looped,
         'T' || k AS tables, 'FUNC_Lib.Read(' || repeat('g(', k) || 'T.Blob' || repeat(')', k) || ', "((").Rows,T' AS applied,
         repeat('V:' || chr(10) || 'a;' || chr(10) || 'b;' || chr(10) || ';', k - 1) || 'V:' || chr(10) || 'a;b;' || chr(10) || ';' AS views
       FROM ({DEEP.replace("STRING", "VARCHAR")})""",
)
def cor_nesting(spark, d):
    rows = source(spark, d, DEEP, "part")

    def names(text: str):
        found = C.references(C.facts(rows.select("script", F.lit(0).alias("pos"), c(text).alias("text"))))
        return found.groupBy("script").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias(text))

    views = C.module_views(rows.select(c("script").alias("module"), c("module").alias("text")))
    shown = F.concat("view", F.lit(":"), "text", F.lit(";"))
    views = views.groupBy(c("module").alias("script")).agg(F.array_join(F.sort_array(F.collect_list(shown)), "").alias("views"))
    texts = rows.select(
        "script",
        C.flatten_conditionals(c("branched")).alias("kept"),
        C.flatten_conditionals(c("branched"), keep=False).alias("dropped"),
        C.drop_blank_lines(C.expand_loops(c("looped"))).alias("looped"),
    )
    return texts.join(names("asked").withColumnRenamed("asked", "tables"), "script").join(names("applied"), "script").join(views, "script")
