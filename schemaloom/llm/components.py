"""Connected components over an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

#: Links that a task joins up by itself at a time.
AT_ONCE = 200_000


def _forest(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """The links' components as stars: each node but the smallest with the smallest."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)
    rows = [(x, find(x)) for x in up]
    rows = [(x, r) for x, r in rows if x != r]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of what links there are in parts of a partition: the same components, fewer and shorter chains."""
    held: list[tuple[int, int]] = []
    for b in batches:
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        if len(held) >= AT_ONCE:
            yield _forest(held)
            held = []
    if held:
        yield _forest(held)


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new links, and the table of each node's least neighbour: written, so that adaptive execution can split a hub."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), least


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    links = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return links.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links between long ids -> (node, component), the component being its smallest node.

    Nodes without a link aren't listed. Each round is written to the shared folder, so lineage stays short
    and a lost executor costs one round. The rounds end when the table no longer changes, which a count and
    an order-free checksum of its rows tell; their number grows with the logarithm of the longest
    chain that is left once tasks have joined up the links they hold.
    A table that still changes after max_rounds is an error.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct()
    now = materialise(links.mapInArrow(_contract, "a long, b long"), "edges")
    mark = None
    for _ in range(max_rounds):
        larger, least = _large_star(now)
        step = materialise(_small_star(larger), "edges")
        release(now, least)
        now = step
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark or not new[0]:
            break
        mark = new
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
