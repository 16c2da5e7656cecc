"""Graph work on edge tables ``(src, dst)``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from rowflow.session import cut_lineage, scratch_path, task_count


class Stored:
    """Tables of one traversal, bucketed by node and dropped at its end (their files stay in the
    shared folder). Joins on the node find them in place: nothing of them is shuffled."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets, self.names = spark, task_count(spark), []

    def write(self, rows: DataFrame, by: str) -> DataFrame:
        name, path = self._new("graph")
        rows.repartition(self.buckets, by).write.bucketBy(self.buckets, by).option("path", path).format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def _new(self, kind: str) -> tuple[str, str]:
        self.names.append(f"rowflow_{uuid.uuid4().hex}")
        return self.names[-1], scratch_path(self.spark, kind)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def visit(self, links: DataFrame, seeds: DataFrame, here: str, there: str) -> tuple[str, str]:
        """The table and the path of ``(name, level)``: the seeds and what they lead to.

        One round per level: the links of the frontier, minus the nodes seen before. Links and
        visited nodes lie in buckets, so only the reached names are shuffled; a round is one
        written partition, which a lost executor repeats. Ends on cyclic graphs: the frontier
        runs dry."""
        table, path = self._new("visited")
        rows, level = seeds.select("name").distinct(), 0
        while True:
            seen = Observation()
            counted = rows.withColumn("level", F.lit(level)).observe(seen, F.count(F.lit(1)).alias("n"))
            writer = counted.write.mode("append").partitionBy("level").bucketBy(self.buckets, "name").format("parquet")
            writer.option("path", path).saveAsTable(table)
            if not seen.get["n"]:
                return table, path
            visited = self.spark.table(table)
            frontier = visited.filter(F.col("level") == level).select("name")
            reached = links.join(frontier, F.col(here) == frontier["name"], "left_semi").select(F.col(there).alias("name")).distinct()
            rows, level = reached.join(visited.select("name"), "name", "left_anti"), level + 1


def reachable(edges: DataFrame, seeds: DataFrame, down: bool = True) -> DataFrame:
    """``(name)``: the seeds and everything reached from them along (``down``) or against the
    edges."""
    here, there = ("src", "dst") if down else ("dst", "src")
    store = Stored(edges.sparkSession)
    try:
        links = store.write(edges.select("src", "dst").distinct(), here)
        return _names(store, store.visit(links, seeds, here, there)[1], seeds)
    finally:
        store.drop()


def _names(store: Stored, path: str, seeds: DataFrame) -> DataFrame:
    kind = seeds.schema["name"].dataType.simpleString()
    return store.spark.read.schema(f"name {kind}, level int").parquet(path).select("name")


def trace(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Everything up- and downstream of the seeds: ``(nodes(name), edges(src, dst))``. Seeds that
    are not in the graph are ignored."""
    store = Stored(edges.sparkSession)
    ways = {"down": [("src", "dst")], "up": [("dst", "src")]}.get(direction, [("src", "dst"), ("dst", "src")])
    nodes, walked = [], []
    try:
        links = {here: store.write(edges.select("src", "dst").distinct(), here) for here, _ in ways}
        one = links[ways[0][0]]
        ends = one.select(F.col("src").alias("name")).unionAll(one.select(F.col("dst").alias("name")))
        known = ends.join(seeds.select("name"), "name", "left_semi")
        for here, there in ways:
            table, path = store.visit(links[here], known, here, there)
            seen = store.spark.table(table).select("name")
            walked.append(cut_lineage(links[here].join(seen, F.col(here) == seen["name"], "left_semi")))
            nodes.append(_names(store, path, seeds))
    finally:
        store.drop()
    if len(ways) == 1:
        return nodes[0], walked[0]
    return nodes[0].unionAll(nodes[1]).distinct(), walked[0].unionAll(walked[1]).distinct()


def contract(edges: DataFrame, keep: str = "SCRIPT", root: str = "EVENT") -> tuple[DataFrame, DataFrame]:
    """``edges(src, src_type, dst, dst_type)`` -> ``(nodes(name), edges(src, dst))``: direct edges
    between nodes of type ``keep`` over one node of another type, and the edges out of root nodes
    of type ``root``. Nodes are the roots and every node of type ``keep`` with an edge out of it,
    also where nobody consumes what that leads to, and the ends of the edges.

    Both sides are distinct before they meet, so a middle node brings together its producers
    (one in a workflow: a script owns its event) and its consumers, once each.
    """
    links = cut_lineage(edges.select("src", "src_type", "dst").distinct())
    into = links.filter(F.col("src_type") == keep).select("src", F.col("dst").alias("mid"))
    out = links.select(F.col("src").alias("mid"), "dst")
    direct = into.join(out, "mid").select("src", "dst")
    entered = links.select(F.col("dst").alias("src"))
    roots = links.filter(F.col("src_type") == root).join(entered, "src", "left_anti").select("src", "dst")
    found = direct.unionAll(roots).distinct()
    ends = found.select(F.explode(F.array("src", "dst")).alias("name"))
    return ends.unionAll(into.select(F.col("src").alias("name"))).distinct(), found
