"""Transitive closure of references: rounds of joins until nothing is new; cycles end by themselves."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def reference_closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """seeds(doc_id, owner, name), edges(doc_id, name, target) -> (doc_id, owner, name) reached from each owner.

    Each round joins only what the last one found, and is checkpointed, so plans stay as small as the first one's; the
    parts of a deep closure are brought together every 16 rounds. A round keeps new rows only, so the rounds end.
    """
    keys = ["doc_id", "owner", "name"]
    edges = cut(edges.select("doc_id", "name", "target").distinct())
    seen = front = cut(seeds.select(keys).distinct())
    for k in itertools.count(1):
        found = front.join(edges, ["doc_id", "name"]).select("doc_id", "owner", F.col("target").alias("name")).distinct()
        front = cut(found.join(seen, keys, "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if k % 16 == 0:
            seen = cut(seen)
    return seen


def embedded_definitions(nodes: DataFrame) -> DataFrame:
    """Of a node table: per document and tool the definitions that it embeds, in declaration order."""
    refs = nodes.where("kind = 'ref'")
    seeds = refs.where("tool_ord >= 0").select("doc_id", F.col("tool_ord").alias("owner"), F.col("ref_name").alias("name"))
    edges = refs.where("tool_ord < 0").select("doc_id", F.col("block").alias("name"), F.col("ref_name").alias("target"))
    defs = nodes.where("kind = 'definition'").select("doc_id", "name", "ord")
    return reference_closure(seeds, edges).join(defs, ["doc_id", "name"]).groupBy("doc_id", "owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("definitions"))


def inlining_count(nodes: DataFrame) -> DataFrame:
    """Per document, how many definitions its tools embed, all counted."""
    return embedded_definitions(nodes).groupBy("doc_id").agg(F.sum(F.size("definitions")).alias("inlinings"))
