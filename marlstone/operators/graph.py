"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.joins import join_by_size
from marlstone.session import materialise, release


def _settled(edges: DataFrame) -> bool:
    """True if every node has one edge upwards and none of those it points to has any."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top")))).alias("x")).select("x.*")
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up > 1 OR up = 1 AND top = 1").isEmpty()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Union-find over all edges in one task of an executor; for edge tables of a counted, small size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in (a, b):
                    parent.setdefault(x, x)
                low, high = sorted((find(a), find(b)))
                parent[high] = low
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(n) for n in nodes], kind)], ["node", "root"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = 200_000) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``, root being the least node of the component.

    Alternating large-star and small-star steps: rounds grow with the logarithm of the longest
    path, every neighbour minimum is pre-aggregated before its shuffle, and hubs are joined by a
    broadcast. Each round is written to the shared folder. Up to ``one_task`` edges, counted first,
    are joined in one task, which gives the same roots without rounds. Nodes without edges do not
    appear; an empty table gives none.
    """
    cur = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if cur.count() <= one_task:
        return materialise(_in_one_task(cur))
    for _ in range(max_rounds):
        if _settled(cur):
            break
        both = materialise(cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = materialise(join_by_size(both, least, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        inner = join_by_size(large, low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        nxt = materialise(inner.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        release(cur, both, least, large, low)
        cur = nxt
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
