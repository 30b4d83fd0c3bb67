"""Scores of cells: the outcome cascade, answers against acceptable values, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import extract


def semantically_correct(name: Column, arguments: Column, want: Column, acceptable: Column) -> Column:
    """The call's name is the wanted one, each argument has an acceptable value, and a parameter is left out only where ""
    is acceptable. arguments: map<string,string>; acceptable: map<string,array<string>>."""
    given = F.map_keys(arguments)
    known = F.forall(given, lambda k: F.coalesce(F.array_contains(F.try_element_at(acceptable, k), F.try_element_at(arguments, k)), F.lit(False)))
    omitted = F.forall(F.array_except(F.map_keys(acceptable), given), lambda k: F.array_contains(F.try_element_at(acceptable, k), ""))
    return (name == want) & known & omitted


def score_records(records: DataFrame, answers: DataFrame) -> DataFrame:
    """records (a raw store) with answers(entry_id, want, acceptable) -> scored cells. A record without an answer is an error.

    Skipped and failed cells are neither valid nor correct; semantic_correct is null unless the call is syntactically valid.
    """
    if row := records.join(answers, "entry_id", "left_anti").limit(1).collect():
        raise ValueError(f"no corpus entry for {row[0].entry_id}")
    j = records.join(answers, "entry_id")
    done = F.col("status") == "completed"
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("raw_response")).startswith("OBJECT"), F.lit(False))
    got = extract(F.col("provider"), F.col("condition"), F.col("raw_response"))
    j = j.withColumn("__x", F.when(done & is_object, got))
    outcome = F.when(done & ~is_object, "missing_raw_response").otherwise(F.col("__x.outcome"))
    valid = F.coalesce(F.col("__x.outcome") == "valid", F.lit(False))
    call = F.try_element_at("__x.calls", F.lit(1))
    want = F.when((F.col("condition") == "c") & F.col("renames"), F.replace("want", F.lit("."), F.lit("_"))).otherwise(F.col("want"))
    right = (F.size("__x.calls") == 1) & semantically_correct(call["name"], F.from_json(call["arguments"], "map<string,string>"), want, F.col("acceptable"))
    return j.select("custom_id", "entry_id", "category", "model", "condition", "provider", "status", valid.alias("syntactic_valid"), F.when(valid, F.coalesce(right, F.lit(False))).alias("semantic_correct"), outcome.alias("parse_outcome"), F.when(F.col("status") == "skipped", F.col("skip_reason")).alias("skip_reason"), F.when(F.col("status") == "api_error", F.coalesce("error", F.lit("api_error"))).alias("api_error"))


def summarise(cells: DataFrame) -> DataFrame:
    """Completed cells per model and condition: counts and rates to four places; semantic among syntactically valid."""
    g = cells.where("status = 'completed'").groupBy("model", "condition").agg(F.count("*").alias("n"), F.count_if("syntactic_valid").alias("syntactic_valid_count"), F.count_if(F.coalesce("semantic_correct", F.lit(False))).alias("semantic_correct_count"))
    return g.select("*", F.round(F.col("syntactic_valid_count") / F.col("n"), 4).alias("syntactic_valid_rate"), F.round(F.try_divide("semantic_correct_count", "syntactic_valid_count"), 4).alias("semantic_correct_rate"))
