"""The rules of the notation as plans over the node table; all findings are collected, nothing is changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .closure import reference_closure

#: The rules in the order in which they are checked.
RULES = (
    "required_default", "dangling_reference", "no_tool", "empty_definitions", "definition_name", "mixed_union", "mixed_enum", "crossed_bounds",
    "duplicate_field", "duplicate_definition", "unused_definition", "duplicate_tool",
)
_SHAPE = ["doc_id", "tool_ord", "level", "rule", "section", "subject"]


def _found(df: DataFrame, level: str, rule: str, section: str, subject: Column) -> DataFrame:
    return df.select("doc_id", "tool_ord", F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.lit(section).alias("section"), subject.cast("string").alias("subject"))


def _repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """All but the first of rows that share keys."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("ord"))).where("__n > 1")


def findings(nodes: DataFrame) -> DataFrame:
    """nodes (see functions.kernels.NODE, with doc_id) -> (doc_id, tool_ord, level, rule, section, subject).

    Documents without any tool must still have a row in the table (their definitions block) to be judged.
    """
    fields = nodes.where("kind = 'field'")
    defs = nodes.where("kind = 'definition'")
    refs = nodes.where("kind = 'ref'")
    docs = nodes.groupBy("doc_id").agg(F.count_if(F.col("kind").isin("tool", "raw")).alias("tools"), F.count_if(F.col("kind") == "defs").alias("blocks"), F.count_if(F.col("kind") == "definition").alias("defs")).withColumn("tool_ord", F.lit(None).cast("int"))
    names = defs.select("doc_id", F.col("name").alias("ref_name")).distinct()
    seeds = refs.where("tool_ord >= 0").select("doc_id", F.lit(0).alias("owner"), F.col("ref_name").alias("name"))
    edges = refs.where("tool_ord < 0").select("doc_id", F.col("block").alias("name"), F.col("ref_name").alias("target"))
    used = reference_closure(seeds, edges).select("doc_id", "name").distinct()
    literal = F.when(F.col("kind") == "enum", F.transform("literal_json", lambda v: F.when(v.rlike('^"'), "string").when(v.isin("true", "false"), "boolean").when(v.rlike("^-?[0-9]"), "numeric").otherwise("other")))
    mixed = nodes.where(F.col("parent_kind").eqNullSafe("union") & F.col("kind").isin("const", "enum")).select("doc_id", "tool_ord", "parent_path").distinct()
    crossed = (F.col("min_val") > F.col("max_val")) | (F.col("min_len") > F.col("max_len")) | (F.col("min_items") > F.col("max_items"))
    where = F.when(F.col("min_val") > F.col("max_val"), "§6.2").when(F.col("min_len") > F.col("max_len"), "§6.3").otherwise("§6.4")
    rules = [
        _found(fields.where("required and has_default"), "error", "required_default", "§4.1", F.col("name")),
        _found(refs.join(names, ["doc_id", "ref_name"], "left_anti"), "error", "dangling_reference", "§5.7", F.col("ref_name")),
        _found(docs.where("tools = 0"), "error", "no_tool", "§3.1", F.lit(None)),
        _found(docs.where("blocks > 0 and defs = 0"), "error", "empty_definitions", "§3.2", F.lit(None)),
        _found(defs.where(~F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$")), "error", "definition_name", "§3.2", F.col("name")),
        _found(mixed, "error", "mixed_union", "§5.6", F.col("parent_path")),
        _found(nodes.where(F.size(F.array_distinct(literal)) > 1), "error", "mixed_enum", "§5.6", F.col("node_path")),
        nodes.where(crossed).select("doc_id", "tool_ord", F.lit("error").alias("level"), F.lit("crossed_bounds").alias("rule"), where.alias("section"), F.col("node_path").alias("subject")),
        _found(_repeats(fields, ["doc_id", "tool_ord", "parent_path", "name"]), "error", "duplicate_field", "§4.2", F.col("name")),
        _found(_repeats(defs, ["doc_id", "name"]), "error", "duplicate_definition", "§3.2", F.col("name")),
        _found(defs.join(used, ["doc_id", "name"], "left_anti"), "warning", "unused_definition", "§3.2", F.col("name")),
        _found(_repeats(nodes.where("kind = 'tool'"), ["doc_id", "name"]), "warning", "duplicate_tool", "§3.5", F.col("name")),
    ]
    return reduce(DataFrame.unionByName, [r.select(_SHAPE) for r in rules])


def finalised(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, tool_ord, raw, reason): which tools end raw. A document with a raw tool is left as it is; elsewhere a tool
    with an error of its own, or in its document's definitions, becomes raw for the first such rule in the order of RULES."""
    tools = nodes.where(F.col("kind").isin("tool", "raw")).select("doc_id", "tool_ord", (F.col("kind") == "raw").alias("was_raw"))
    tools = tools.withColumn("some_raw", F.max("was_raw").over(W.partitionBy("doc_id")))
    errors = found.where("level = 'error'")
    at = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    own = errors.where("tool_ord >= 0").groupBy("doc_id", "tool_ord").agg(F.min_by("rule", at).alias("own"))
    shared = errors.where("tool_ord < 0 or tool_ord is null").groupBy("doc_id").agg(F.min_by("rule", at).alias("shared"))
    out = tools.join(own, ["doc_id", "tool_ord"], "left").join(shared, "doc_id", "left")
    reason = F.when(~F.col("some_raw"), F.coalesce("own", "shared"))
    return out.select("doc_id", "tool_ord", (F.col("was_raw") | reason.isNotNull()).alias("raw"), reason.alias("reason"))


def misplaced_objects(nodes: DataFrame) -> DataFrame:
    """Objects with fields where no block can stand: not a field's own type, nor the items of a field's array."""
    holders = nodes.where("kind = 'field'").select("doc_id", "tool_ord", F.col("parent_path").alias("node_path")).distinct()
    at = nodes.where("kind = 'object'").join(holders, ["doc_id", "tool_ord", "node_path"], "left_semi")
    up = nodes.select("doc_id", "tool_ord", F.col("node_path").alias("parent_path"), F.col("kind").alias("up_kind"), F.col("parent_kind").alias("up_parent"))
    j = at.join(up, ["doc_id", "tool_ord", "parent_path"], "left")
    fine = (F.col("parent_kind") == "field") | ((F.col("up_kind") == "array") & (F.col("up_parent") == "field"))
    return j.where(~fine).select("doc_id", "tool_ord", "node_path")
