"""Connected components of a large graph: smallest node reachable from each node."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stored

# Edges that a task contracts at a time.
LOCAL_EDGES = 1_000_000


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace batches of edges by stars with the same components."""

    def stars(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for a, b in edges:
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in root]
        pairs = [(x, top) for x, top in pairs if x != top]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(held) >= LOCAL_EDGES:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node of its neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    larger = both.filter("b > a").join(least, "a").filter("b <> m")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"),
                                                          F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 65536)
    ).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``(a, b)`` edges; loops are ignored.

    Alternating large-star and small-star rounds; each is an aggregation and a join on edges
    that are never more than at the start, stored so that a lost executor costs one round.
    Tasks contract their own edges first, so small graphs end in two rounds. A node with very
    many neighbours is one row per task in the aggregation; its join is left to Spark's split
    of skewed partitions. Edges that one task contracts at a time need no rounds: its stars are
    the components. The edges should be a stored table, as they are read twice.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    one_task = edges.count() <= LOCAL_EDGES
    dealt = edges.coalesce(1) if one_task else edges.repartition("a")
    edges = stored(dealt.mapInArrow(_contract, "a long, b long"), "edges")
    before = (0,) if one_task else _state(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
