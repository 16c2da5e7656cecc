"""Personal data: base spans by pattern, and identifiers found by bootstrapped contexts.

Base spans (email, ip, card, phone) come from the texts alone. They and strict secrets (a word of
32 or more hexadecimal digits) are the seeds. The words around a seed (one or two before, two
after, or one on either side) are its contexts; a context with LEAST_SUPPORT distinct seeds is a
pattern, labelled with the kind most of them have. What stands in a pattern elsewhere are its
instances: a word, a run of words of digits of any length, or up to SPAN words between two context
words. Patterns and instances form a graph, which is written once and scored in ROUNDS rounds: an
instance is trusted when it is a seed, or as far as its best pattern says; a pattern is as precise
as the mean trust of its distinct instances. A candidate is accepted where the precision, with
FORM added if it looks loosely like the kind, reaches LEAST_PRECISION; it is added as ``context``.

All of it is DataFrame functions: matches are located by splitting a text at its matches, and
the graph is a table of distinct (pattern, instance) edges. Positions count code points, ends
are exclusive. Null texts are empty. Repeated rows are separate rows with the same spans; null
ids are kept; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowflow.operators.joins import broadcast_right
from rowflow.session import cut_lineage, scratch_path, spread

#: The base patterns. Where a run failed from its start it fails from within, so
#: a match starts at the start of a run or where the last one ended; possessive repeats need no
#: stack on long texts and match the same here.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
ROUNDS, LEAST_SUPPORT, LEAST_PRECISION = 3, 5, 0.8
FORM = 0.3  # what the loose form of its kind adds to a candidate's score
SPAN = 4  # words between two context words
LISTED, SENT = 2000, 1_000_000  # so many patterns are looked up as a list, so many more by a broadcast
PART, SURE = 16, 1.5  # one in PART texts shows which patterns are far too common, SURE times beyond the bound
#: What stands for a base span of each kind, for any of them, and for an end of the text.
CODES, MASK, EDGE = "\ue000\ue001\ue002\ue003", "\ue004", "\ue005"
CHUNK = 64
SPANS = "array<struct<start:int,end:int,hit:string>>"
#: A run of words of digits, or any other word.
NUMBER = r"[+(]*+[0-9][0-9().+/-]*+[,;]?(?!\S)"
WORD = rf"(?<!\S){NUMBER}(?:\s++{NUMBER})*+|\S+"
SECRET = r"^[^\p{L}\p{N}]*(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}[^\p{L}\p{N}]*$"


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(hit: Column) -> Column:
    backwards = F.reverse(digits_of(hit))

    def value(i: Column) -> Column:
        digit = backwards.substr(i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return F.when(digit > 9, digit - 9).otherwise(digit)

    places = F.sequence(F.lit(1), F.greatest(F.length(backwards), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda total, i: total + F.coalesce(value(i), F.lit(0))) % 10 == 0


def is_ip(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(part, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def has_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda hit: F.length(digits_of(hit)).between(low, high)


#: kind: pattern, something every text with a match has, and the test of a match
RULES: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "email": (EMAIL, "@", lambda hit: F.lit(True)),
    "ip": (IP, r"[0-9]\.[0-9]", is_ip),
    "card": (CARD, r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", lambda hit: has_digits(13, 19)(hit) & F.when(has_digits(13, 19)(hit), passes_luhn(hit)).otherwise(False)),
    "phone": (PHONE, r"\+[0-9]", has_digits(9, 15)),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once (expressions inside folds are not shared)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str, hint: str) -> Column:
    """SPANS of all matches, or null if there is none. Positions are summed up in chunks, so that long lists stay linear."""

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def run(pairs: Column, at: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), add)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))

    def join(state: Column, chunk: Column) -> Column:
        done = run(chunk, state["at"])
        return F.struct(done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out"))

    def found(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, CHUNK))
        return F.aggregate(chunks, start, join, lambda state: F.flatten(state["out"]))

    def paired(hits: Column) -> Column:
        """(gap, hit) pairs: what stands before each match, and the match."""
        return F.slice(F.arrays_zip(F.split(text, F.lit(pattern), -1).alias("gap"), hits.alias("hit")), F.lit(1), F.size(hits))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(hint), let(hits, lambda x: F.when(F.size(x) > 0, let(paired(x), found))))


def kind_spans() -> Column:
    """start, end, hit and number of the kind of all base spans in order."""

    def of(i: int) -> Column:
        return F.transform(KINDS[i], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(i).alias("kind"), x["hit"].alias("hit")))

    return F.array_sort(F.concat(*map(of, range(len(KINDS)))))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, a SPANS column for each kind, and two texts without the base spans:
    ``masked`` has the code of the kind for each of their characters, ``coded`` the code and the
    hash of the value. Both have the same words."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))
    for kind, (pattern, hint, good) in RULES.items():
        spans = located(F.col("text"), pattern, hint)
        rows = rows.withColumn(kind, F.filter(F.coalesce(spans, F.array().cast(SPANS)), lambda x: good(x["hit"])))
    marks = CODES + MASK + EDGE
    clean = F.translate("text", marks, "\ufffd" * len(marks))
    rows = rows.withColumn("plain", F.when(F.col("text").rlike(f"[{marks}]"), clean).otherwise(F.col("text")))
    plain = F.col("plain")
    codes = F.array(*map(F.lit, CODES))

    def without(stand_in: Callable[[Column, Column], Column]) -> Column:
        def step(state: Column, x: Column) -> Column:
            start = F.greatest(state["at"], x["start"])
            gap = plain.substr(state["at"] + 1, start - state["at"])
            out = F.when(x["end"] > state["at"], F.concat(state["out"], gap, stand_in(x, x["end"] - start))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

        rest = lambda state: F.concat(state["out"], plain.substr(state["at"] + 1, F.length("text")))
        return F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)

    rows = rows.withColumn("spans", kind_spans())
    masked = without(lambda x, size: F.repeat(F.get(codes, x["kind"]), size))
    value = lambda x: F.lpad(F.lower(F.hex(F.xxhash64(F.lower(x["hit"])))), 16, "0")
    coded = without(lambda x, size: F.concat(F.get(codes, x["kind"]), value(x)))
    some = F.size("spans") > 0
    return rows.withColumn("masked", F.when(some, masked).otherwise(plain)).withColumn("coded", F.when(some, coded)).drop("text", "spans", "plain")


def context_key(kind: int, *words: str) -> str:
    """SQL: the number of a context, by the hashes of its words; 0 where none of them is a word."""
    none = " AND ".join(f"{w} IN (xxhash64('{MASK}'), xxhash64('{EDGE}'))" for w in words)
    return f"if({none}, 0L, xxhash64({kind}, {', '.join(words)}))"


def side(by: int) -> str:
    """The column of the neighbour so many places on."""
    return f"l{-by}" if by < 0 else f"r{by}"


#: The columns of a word's contexts: number of words that stand in them, number of the kind, and the
#: places of the neighbours.
PLACES = {"k_l1": (1, 1, (-1,)), "k_l2": (1, 2, (-2, -1)), "k_r2": (1, 3, (1, 2)), **{f"k_lr{m}": (m, 4, (-1, m)) for m in range(1, SPAN + 1)}}
#: The same with the number of the context as SQL.
CONTEXTS = {name: (m, context_key(kind, *map(side, at))) for name, (m, kind, at) in PLACES.items()}


def words_of(rows: DataFrame, wanted: Callable[[Column, Callable[[int], Column]], Column] | None = None) -> DataFrame:
    """doc_id, text_key, at, the word, the hashes of its neighbours and the numbers of its contexts,
    one row per word. Runs of words of digits are one word; a neighbour that is a base span is
    MASK. Each word is hashed once, and only it is carried as text. ``wanted`` says by the word
    and the hash of the neighbour so many places on which words become rows at all."""
    words = F.regexp_extract_all(F.lower(F.coalesce("coded", "masked")), F.lit(WORD), F.lit(0))
    plain = F.transform("w", lambda x: F.xxhash64(x))
    masked = F.transform("w", lambda x: F.xxhash64(F.regexp_replace(x, rf"[{CODES}][0-9a-f]{{16}}", MASK)))
    rows = rows.select("doc_id", "text_key", "coded", words.alias("w"))
    rows = rows.select("doc_id", "text_key", "w", F.when(F.col("coded").isNull(), plain).otherwise(masked).alias("h"))
    edge = F.xxhash64(F.lit(EDGE))

    def near(by: int) -> Column:
        return F.coalesce(F.get("h", F.col("at") + by), edge)

    # Places become rows before anything is made of them: what follows is compiled, unlike the body of a fold.
    each = rows.select("*", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("at"))
    if wanted is not None:
        each = each.where(wanted(F.get("w", "at"), near))
    each = each.select("doc_id", "text_key", "at", F.get("w", "at").alias("w"), *(near(by).alias(side(by)) for by in (-2, -1, *range(1, SPAN + 1))))
    return each.selectExpr("*", *(f"{key} AS {name}" for name, (_, key) in CONTEXTS.items()))


#: The contexts of a seed, and the neighbour that stands in each.
ANCHORS = {"k_l1": "l1", "k_l2": "l1", "k_r2": "r1", "k_lr1": "l1"}


def trimmed(value: str) -> str:
    """SQL: ``value`` without the signs around it; codes stay."""
    kept = f"\\\\p{{L}}\\\\p{{N}}{CODES}"
    return f"regexp_replace({value}, '^[^{kept}+]+|[^{kept}]+$', '')"


def seeds_of(rows: DataFrame) -> DataFrame:
    """key, value and kind of every seed, for each of its contexts, and the anchor of the context: a
    neighbour that stands in it, on the left or (``right``) on the right."""
    some = rows.where(F.col("coded").isNotNull() | F.col("masked").rlike("[0-9a-fA-F]{32}"))
    code = F.regexp_extract("w", rf"^[^\p{{L}}\p{{N}}{CODES}]*([{CODES}][0-9a-f]{{16}})", 1)
    each = words_of(some, lambda w, _: w.rlike(f"[{CODES}]") | w.rlike(SECRET)).withColumn("code", code).where((F.col("code") != "") | F.col("w").rlike(SECRET))
    names = F.create_map(*(F.lit(x) for c, k in zip(CODES, KINDS) for x in (c, k)))
    kind = F.coalesce(F.try_element_at(names, F.substring("code", 1, 1)), F.lit("secret"))
    value = F.when(F.col("code") != "", F.col("code")).otherwise(F.expr(trimmed("w")))
    keys = F.array(*(F.struct(F.col(k).alias("key"), F.col(w).alias("anchor"), F.lit(w == "r1").alias("right")) for k, w in ANCHORS.items()))
    return each.select(value.alias("value"), kind.alias("kind"), F.explode(keys).alias("x")).select("value", "kind", "x.*").where("key != 0")


def occurrences(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, text_key, at (word), words, key and value of what stands in ``patterns(key, anchor,
    right)``, other than base spans. The value of several words is the hash of them: they have no
    loose form."""
    keys = patterns.select("key", "anchor", "right").distinct()
    few = keys.limit(LISTED + 1).collect()
    listed = {r["key"] for r in few}
    left, right = ([r["anchor"] for r in few if r["right"] == x] for x in (False, True))

    def inside(_: Column, near: Callable[[int], Column]) -> Column:
        """Whether a word stands in a listed pattern; only beside an anchor its contexts are hashed."""
        found = [F.xxhash64(F.lit(kind), *map(near, at)).isin(listed) for _, kind, at in PLACES.values()]
        return (near(-1).isin(left) | near(1).isin(right)) & reduce(or_, found)

    hashes, none = [f"r{i}" for i in range(1, SPAN)], f"(xxhash64('{MASK}'), xxhash64('{EDGE}'))"
    whole = (" AND ".join([f"{name} != 0", *(f"r{i} NOT IN {none}" for i in range(1, m))]) for name, (m, _) in CONTEXTS.items())
    held = ", ".join(f"if({x}, {name}, 0L)" for name, x in zip(CONTEXTS, whole))
    sizes = F.array(*(F.lit(m) for m, _ in CONTEXTS.values()))

    def held_in(words: DataFrame) -> DataFrame:
        """The words once for each of their contexts."""
        each = words.select("doc_id", "text_key", "at", "w", *hashes, F.posexplode(F.expr(f"array({held})")).alias("place", "key")).where("key != 0")
        return each.withColumn("words", F.get(sizes, "place"))

    if len(few) <= LISTED:  # a bounded list: only words in a pattern become rows
        each = held_in(words_of(rows, inside)).where(F.col("key").isin(listed)).withColumn("met", F.col("key"))
    else:  # the patterns go to the words, a bounded number at a time: no word outside them is shuffled
        keys = cut_lineage(keys.select("key", F.col("key").alias("met")).distinct())
        turns = -(-keys.count() // SENT)
        some = [keys.where(F.pmod(F.xxhash64("key"), F.lit(turns)) == i) for i in range(turns)] if turns > 1 else [keys]
        each = reduce(DataFrame.unionAll, [held_in(words_of(rows)).join(F.broadcast(x), "key") for x in some])
    # one case that names ``met``, so that no part of it is tested on every word before the join
    several = [f"WHEN {m} THEN concat('#', hex(xxhash64(w, {', '.join(hashes[: m - 1])})))" for m in range(2, SPAN + 1)]
    bad = " OR ".join(f"contains(w, '{x}')" for x in CODES)
    value = f"CASE WHEN met = 0 OR {bad} THEN '' ELSE CASE words {' '.join(several)} ELSE {trimmed('w')} END END AS value"
    return each.selectExpr("doc_id", "text_key", "at", "words", "key", value).where("value != ''")


def form(kind: Column, value: Column) -> Column:
    """1 where a value has the loose form of the kind, else 0."""
    number = value.rlike(r"^[0-9+() ./-]+$")
    size = F.length(digits_of(value))
    secret = (F.length(value) >= 16) & value.rlike(r"^[0-9a-z_/+=-]+$") & value.rlike("[0-9]") & value.rlike("[a-z]")
    loose = F.when(kind == "email", value.contains("@")).when(kind == "ip", value.rlike(r"^[0-9a-f]*([.:][0-9a-f]*){2,}$")).when(kind == "card", number & (size >= 8))
    return loose.when(kind == "secret", secret).otherwise(number & (size >= 5)).cast("double")


def with_scores(edges: DataFrame, precise: DataFrame) -> DataFrame:
    """``edges`` in patterns precise enough, with what precision and form together say of them."""
    score = F.col("precision") + FORM * form(F.col("kind"), F.col("value"))
    good = precise.where(F.col("precision") >= LEAST_PRECISION - FORM)
    return edges.join(good, "key").withColumn("score", F.least(score, F.lit(1.0))).where(F.col("score") >= LEAST_PRECISION)


def scored_graph(seeds: DataFrame, edges: DataFrame, patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """key, precision and kind of every pattern after ``rounds`` rounds over the graph:
    ``seeds(key, value)``, ``edges(key, value)`` distinct, ``patterns(key, kind)``."""
    start = seeds.select("key", "value").withColumn("seed", F.lit(1.0)).unionByName(edges.withColumn("seed", F.col("value").rlike(SECRET).cast("double")))
    start = cut_lineage(start.groupBy("key", "value").agg(F.max("seed").alias("seed")))
    trust = None
    for turn in range(rounds):
        if trust is None:
            known = start.withColumn("trust", F.col("seed"))
        else:
            known = start.join(trust, "value", "left").withColumn("trust", F.greatest("seed", F.coalesce("trust", F.lit(0.0))))
        precise = known.groupBy("key").agg(F.avg("trust").alias("precision")).join(patterns.select("key", "kind"), "key")
        precise = cut_lineage(precise)
        if turn + 1 < rounds:
            trust = cut_lineage(with_scores(edges, precise).groupBy("value").agg(F.max("score").alias("trust")))
    return precise


def found_instances(rows: DataFrame) -> DataFrame | None:
    """doc_id, text_key, at and words of the accepted candidates; None if there is no pattern."""
    seeds = cut_lineage(seeds_of(rows).distinct())
    places = seeds.select("key", "anchor", "right").distinct()
    patterns = seeds.groupBy("key").agg(F.count_distinct("value").alias("support"), F.mode("kind", True).alias("kind"))
    patterns = cut_lineage(patterns.where(F.col("support") >= LEAST_SUPPORT))
    if patterns.isEmpty():
        return None

    def rare(found: DataFrame, margin: float) -> DataFrame:
        """The patterns that are not far too common in ``found``, by a sketch."""
        many = found.groupBy("key").agg(F.approx_count_distinct("value", 0.05).alias("n"))
        return patterns.join(many, "key", "left").where(F.col("n").isNull() | (margin * F.col("support") >= (LEAST_PRECISION - FORM) * 0.7 * F.col("n")))

    # what is far too common in a part of the texts is so in all of them, and goes before its instances are written
    # (in fewer tasks, as each has a sketch for every pattern it meets)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // PART)
    part = occurrences(rows.where(F.pmod("text_key", F.lit(PART)) == 0).coalesce(tasks), patterns.join(places, "key"))
    open_ = cut_lineage(rare(part, SURE).select("key"))
    path = scratch_path(rows.sparkSession, "pattern-graph")
    occurrences(rows, places.join(open_, "key", "left_semi")).write.parquet(path)
    graph = rows.sparkSession.read.parquet(path)
    kept = cut_lineage(rare(graph, 1.0).where("n IS NOT NULL").select("key", "kind"))
    if kept.isEmpty():
        return None
    graph = graph.join(kept.select("key"), "key", "left_semi")
    edges = cut_lineage(graph.select("key", "value").distinct())
    precise = scored_graph(seeds.join(kept, "key", "left_semi"), edges, kept)
    return with_scores(graph, precise).select("doc_id", "text_key", "at", "words")


def listed(name: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{name}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def found_in_context(rows: DataFrame) -> DataFrame:
    """doc_id, text_key and ``context``: the spans the contexts add, in order; of spans that
    overlap the longest from the first on."""
    new = found_instances(rows)
    if new is None:
        return rows.select("doc_id", "text_key", F.array().cast("array<struct<start:int,end:int>>").alias("context")).where("false")
    new = cut_lineage(new.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "words")).alias("found")).withColumnsRenamed({"doc_id": "other_id", "text_key": "other_key"}))
    texts = broadcast_right(rows, new, rows.doc_id.eqNullSafe(new.other_id) & (rows.text_key == new.other_key)).dropDuplicates(["doc_id", "text_key"])
    texts = texts.withColumn("tokens", located(F.col("masked"), WORD, r"\S"))

    def span(x: Column) -> Column:
        first, last = F.get("tokens", x["at"]), F.get("tokens", x["at"] + x["words"] - 1)
        start = first["start"] + F.length(F.regexp_extract(first["hit"], r"^[^\p{L}\p{N}+]*", 0))
        return F.struct(start.alias("start"), (last["end"] - F.length(F.regexp_extract(last["hit"], r"[^\p{L}\p{N}]*$", 0))).alias("end"))

    def longest(out: Column, x: Column) -> Column:
        return F.when(x["start"] >= F.coalesce(F.get(out, F.size(out) - 1)["end"], F.lit(0)), F.concat(out, F.array(x))).otherwise(out)

    by_start = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    spans = F.array_sort(F.filter(F.transform("found", span), lambda x: x["end"] > x["start"]), by_start)
    return texts.select("doc_id", "text_key", F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), longest).alias("context"))


def stored_spans(docs: DataFrame) -> DataFrame:
    """``base_spans`` as a written table, as it is used more than once."""
    rows, path = base_spans(spread(docs)), scratch_path(docs.sparkSession, "spans")
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, how many base spans of each kind and found by contexts, the digest of the base spans,
    and all spans."""
    rows = stored_spans(docs)
    added = found_in_context(rows).withColumnsRenamed({"doc_id": "other_id", "text_key": "other_key"})
    same = rows.doc_id.eqNullSafe(added.other_id) & (rows.text_key == added.other_key)
    rows = rows.join(added, same, "left")
    base = F.flatten(F.array(*(listed(k, F.col(k)) for k in KINDS)))
    context = F.coalesce(listed("context", F.col("context")), F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.size(context).cast("long").alias("n_context"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, context), ",").alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, if there, follows.

    All spans are located in the original text; those that overlap become one, named after the
    first. Null texts stay null."""
    rows = stored_spans(docs)
    added = cut_lineage(found_in_context(rows).withColumnsRenamed({"doc_id": "redact id", "text_key": "redact key", "context": "redact context"}))
    keyed = docs.withColumn("redact own", F.xxhash64("text"))
    keyed = broadcast_right(keyed, added, F.col("doc_id").eqNullSafe(F.col("redact id")) & (F.col("redact own") == F.col("redact key")), "left")
    text, labels = F.col("text"), F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, "id")))

    def placed(spans: Column, label: int) -> Column:
        return F.transform(F.coalesce(spans, F.array().cast(SPANS)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(label).alias("label")))

    def step(state: Column, x: Column) -> Column:
        apart = F.concat(text.substr(state["at"] + 1, x["start"] - state["at"]), F.element_at(labels, x["label"]))
        out = F.when(x["start"] >= state["at"], F.concat(state["out"], apart)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

    bases = (placed(F.filter(located(text, pattern, hint), lambda x: good(x["hit"])), i + 1) for i, (pattern, hint, good) in enumerate(RULES.values()))
    context = F.transform("redact context", lambda x: F.struct(x["start"], x["end"], F.lit("").alias("hit")))
    keyed = keyed.withColumn("redact spans", F.array_sort(F.concat(*bases, placed(context, len(KINDS) + 1))))
    rest = lambda state: F.concat(state["out"], text.substr(state["at"] + 1, F.length(text)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    keyed = keyed.withColumn("text", F.when(F.size("redact spans") > 0, F.aggregate("redact spans", start, step, rest)).otherwise(text))
    if "n_chars" in docs.columns:
        keyed = keyed.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return keyed.select(docs.columns)
