"""Connected components by alternating stars; edges stay distributed and are written after each step."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from tagsmith.llm.common import map_arrow, stored

#: Edges that a task joins up at once.
AT_ONCE = 400_000


def forest(edges: DataFrame) -> DataFrame:
    """(u, v: binary) with the same components, each task's own cycles cut: u hangs below a smaller v."""

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        def out() -> dict:
            below = [x for x in up if top(x) != x]
            return {"u": below, "v": [top(x) for x in below]}

        for b in batches:
            for x, y in zip(b["u"], b["v"], strict=True):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > AT_ONCE:
                yield out()
                up.clear()
        yield out()

    return map_arrow(edges.select("u", "v"), task, "u binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of `edges` (u, v: binary) that aren't the least of their component.

    Label is the component's least node. Minima are partial before each shuffle; the joins are between
    written tables, which adaptive execution may split where a node has very many edges.
    """
    now = stored(forest(edges).distinct(), "edges")
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "least")
        large = stored(both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # a node now has few smaller neighbours, however many hang below them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = stored(small.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node hangs below one other at most, and none that has nodes below it hangs itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1").isEmpty()
