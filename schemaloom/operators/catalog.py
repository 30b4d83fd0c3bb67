"""Catalogs of tool definitions: dedupe by content, check, convert, bucket, attach tokens, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K


def dedupe(occurrences: DataFrame, schema: str = "schema", category: str = "category", order: str = "ord") -> DataFrame:
    """occurrences -> per content hash: tool_hash, schema (of the first by order), categories, occurrences, renamed.

    Python's type names are mapped first, so that definitions that differ in them alone are one. The hash is of
    canonical JSON. Equal texts are counted first, map-side, so that the kernels see each distinct text once.
    """
    texts = occurrences.groupBy(F.col(schema).alias("__text")).agg(F.collect_set(category).alias("__in"), F.count("*").alias("__n"), F.min(order).alias("__first"))
    mapped = texts.withColumns({"__c": K.map_aliases(F.col("__text")), "__raw": K.canonical_json(F.col("__text"))})
    categories = F.array_sort(F.array_distinct(F.flatten(F.collect_list("__in"))))
    return (
        mapped.withColumn("tool_hash", F.sha2("__c", 256))
        .groupBy("tool_hash")
        .agg(F.min_by("__c", "__first").alias("schema"), categories.alias("categories"), F.sum("__n").alias("occurrences"), F.sum(F.when(F.col("__c") != F.col("__raw"), F.col("__n")).otherwise(0)).alias("renamed"))
    )


def bucketed(tools: DataFrame, assume_closed: bool = True, map_types: bool = True) -> DataFrame:
    """tools(tool_hash, schema, ...) -> also conversion, bucket (invalid_input, fell_back, converted), reasons, text.

    An invalid schema isn't converted; a tool falls back for the first reason that is recorded.
    """
    out = tools.withColumn("invalid_reason", K.malformed_reason(F.col("schema")))
    out = out.withColumn("conversion", K.convert_schema(F.when(F.col("invalid_reason").isNull(), F.col("schema")), assume_closed, map_types))
    invalid = F.col("invalid_reason").isNotNull()
    first = F.when(F.size("conversion.fallbacks") > 0, F.element_at("conversion.fallbacks", 1)["reason"])
    fell = first.isNotNull() | F.col("conversion.error").isNotNull()
    bucket = F.when(invalid, "invalid_input").when(fell, "fell_back").otherwise("converted")
    return out.withColumns({"bucket": bucket, "fallback_reason": F.when(~invalid, F.coalesce(first, F.col("conversion.error"))), "text": F.when(bucket == "converted", F.col("conversion.text"))})


def attach_tokens(rows: DataFrame, counters: dict[str, Column | DataFrame]) -> DataFrame:
    """tokens_json_<name>, tokens_compact_<name>, delta_<name> for converted rows.

    A counter is a function of a text column, or a cache(tool_hash, json, compact) that is joined; a hash without an
    entry has nulls.
    """
    out = rows
    done = F.col("bucket") == "converted"
    for name, counter in counters.items():
        if isinstance(counter, DataFrame):
            cache = counter.select("tool_hash", F.col("json").alias("__j"), F.col("compact").alias("__c"))
            out = out.join(cache, "tool_hash", "left").withColumns({f"tokens_json_{name}": F.when(done, F.col("__j")), f"tokens_compact_{name}": F.when(done, F.col("__c"))}).drop("__j", "__c")
        else:
            out = out.withColumns({f"tokens_json_{name}": F.when(done, counter(F.col("schema"))), f"tokens_compact_{name}": F.when(done, counter(F.col("text")))})
        out = out.withColumn(f"delta_{name}", F.col(f"tokens_compact_{name}") - F.col(f"tokens_json_{name}"))
    return out


def pending(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Converted hashes that a cache doesn't have."""
    return rows.where(F.col("bucket") == "converted").select("tool_hash").join(cache.select("tool_hash"), "tool_hash", "left_anti")


def merge_cache(cache: DataFrame, counted: DataFrame) -> DataFrame:
    """A token cache with new counts put in: both are (tool_hash, json, compact); a new count replaces an old one.

    Of equal hashes among the new, the one with the largest counts stays. Nulls aren't counts and don't enter.
    """
    cols = ["tool_hash", "json", "compact"]
    both = cache.select(cols).withColumn("__new", F.lit(0)).unionByName(counted.select(cols).dropna().withColumn("__new", F.lit(1)))
    return both.groupBy("tool_hash").agg(F.max(F.struct("__new", "json", "compact")).alias("x")).select("tool_hash", "x.json", "x.compact")


def text_cache_key(text: Column) -> Column:
    """The key under which a text's token count is kept."""
    return F.sha2(text.cast("binary"), 256)


def indexed(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Converted rows of the listed hashes; a hash without one is an error."""
    have = rows.where("bucket = 'converted'")
    wanted = hashes.select("tool_hash").distinct()
    if row := wanted.join(have, "tool_hash", "left_anti").limit(1).collect():
        raise ValueError(f"no converted tool for {row[0].tool_hash}")
    return have.join(wanted, "tool_hash", "left_semi")


def invalid_counts(rows: DataFrame) -> DataFrame:
    """Per reason: unique invalid definitions and their occurrences. A definition counts once, with its first reason."""
    return rows.where("bucket = 'invalid_input'").groupBy(F.col("invalid_reason").alias("reason")).agg(F.count("*").alias("definitions"), F.sum("occurrences").alias("occurrences"))


def summary(rows: DataFrame, tokenizers: list[str]) -> DataFrame:
    """One row: counts per bucket, coverage, occurrences, and mean and median change per tokenizer."""
    n = lambda b: F.count_if(F.col("bucket") == b)
    more = []
    for t in tokenizers:
        d, j = F.col(f"delta_{t}"), F.col(f"tokens_json_{t}")
        more += [F.avg(d).alias(f"mean_delta_{t}"), F.median(d).alias(f"median_delta_{t}"), F.avg(F.when(j > 0, -d * 100.0 / j)).alias(f"mean_saving_{t}")]
    g = rows.agg(n("converted").alias("converted"), n("fell_back").alias("fell_back"), n("invalid_input").alias("invalid"), F.sum("occurrences").alias("occurrences"), F.sum("renamed").alias("renamed"), *more)
    return g.withColumn("coverage", F.try_divide("converted", F.col("converted") + F.col("fell_back")))


def records(rows: DataFrame, tokenizers: list[str]) -> DataFrame:
    """The flat projection that is written out: one record per unique definition."""
    cols = [c for t in tokenizers for c in (f"tokens_json_{t}", f"tokens_compact_{t}", f"delta_{t}")]
    return rows.select("tool_hash", F.col("categories").alias("source_categories"), F.col("occurrences").alias("raw_occurrence_count"), "bucket", "fallback_reason", "invalid_reason", *cols)


def node_table(tools: DataFrame, key: str = "tool_hash", schema: str = "schema", assume_closed: bool = True, map_types: bool = True) -> DataFrame:
    """A row per node of each definition, as read; validation, manifests and closures are plans over it."""
    return tools.select(F.col(key).alias("doc_id"), F.explode(K.schema_nodes(F.col(schema), assume_closed, map_types)).alias("n")).select("doc_id", "n.*")


def text_table(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The same of notation text."""
    return texts.select(F.col(key).alias("doc_id"), F.explode(K.text_nodes(F.col(text))).alias("n")).select("doc_id", "n.*")


def merged_definitions(tools: DataFrame) -> DataFrame:
    """tools(doc_id, tool_ord, def_name, def_json): per document and name whether all tools that carry it agree."""
    return tools.groupBy("doc_id", "def_name").agg(F.count_distinct("def_json").alias("versions"), F.count("*").alias("carriers")).withColumn("conflict", F.col("versions") > 1)


def conflicting_tools(tools: DataFrame) -> DataFrame:
    """Tools that must stay raw because a definition they carry differs elsewhere in the document, with the names."""
    bad = merged_definitions(tools).where("conflict").select("doc_id", "def_name")
    return tools.join(bad, ["doc_id", "def_name"]).groupBy("doc_id", "tool_ord").agg(F.array_sort(F.collect_set("def_name")).alias("names"))
