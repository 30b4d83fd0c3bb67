"""Calls in model responses: the last fenced block, provider shapes, outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a fenced block, with or without its language.
FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"


def last_fenced(text: Column) -> Column:
    """The content of the last fenced block; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), F.lit(-1))


def parse_call(text: Column) -> Column:
    """struct<outcome, name, arguments>: valid, no_fenced_block, invalid_json or invalid_shape, by built-in functions.

    arguments is JSON text. A name must be a string and arguments an object.
    """
    body = F.trim(last_fenced(text))
    v = F.try_parse_json(body)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_call = F.coalesce(kind("$").startswith("OBJECT") & (kind("$.name") == "STRING") & kind("$.arguments").startswith("OBJECT"), F.lit(False))
    outcome = F.when(body.isNull(), "no_fenced_block").when(v.isNull(), "invalid_json").when(is_call, "valid").otherwise("invalid_shape")
    good = outcome == "valid"
    return F.struct(outcome.alias("outcome"), F.when(good, F.try_variant_get(v, "$.name", "string")).alias("name"), F.when(good, F.get_json_object(body, "$.arguments")).alias("arguments"))


_BLOCKS = "array<struct<type:string,text:string,name:string,arguments:string,input:string,content:array<struct<type:string,text:string>>>>"


def prompt_text(provider: Column, response: Column) -> Column:
    """What a model said, from a provider's response (JSON text)."""
    out = F.from_json(F.get_json_object(response, "$.output"), _BLOCKS)
    texts = F.flatten(F.transform(F.filter(out, lambda x: x["type"] == "message"), lambda x: F.transform(F.filter(F.coalesce(x["content"], F.array()), lambda b: b["type"] == "output_text"), lambda b: F.coalesce(b["text"], F.lit("")))))
    whole = F.get_json_object(response, "$.output_text")
    openai = F.when(F.coalesce(whole, F.lit("")) != "", whole).otherwise(F.coalesce(F.array_join(texts, "\n"), F.lit("")))
    blocks = F.from_json(F.get_json_object(response, "$.content"), _BLOCKS)
    anthropic = F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n"), F.lit(""))
    choices = F.from_json(F.get_json_object(response, "$.choices"), "array<struct<message:struct<content:string>>>")
    said = F.filter(F.transform(choices, lambda c: c["message"]["content"]), lambda t: F.coalesce(t, F.lit("")) != "")
    other = F.coalesce(F.try_element_at(said, F.lit(1)), F.lit(""))
    return F.when(provider == "openai", openai).when(provider == "anthropic", anthropic).otherwise(other)


def native_calls(provider: Column, response: Column) -> Column:
    """Native calls as array<struct<name, arguments>>, arguments as JSON text; null if there are none."""
    shape = lambda n, a: F.struct(n.alias("name"), F.coalesce(a, F.lit("{}")).alias("arguments"))
    out = F.from_json(F.get_json_object(response, "$.output"), _BLOCKS)
    openai = F.transform(F.filter(out, lambda x: (x["type"] == "function_call") & x["name"].isNotNull()), lambda x: shape(x["name"], x["arguments"]))
    blocks = F.from_json(F.get_json_object(response, "$.content"), _BLOCKS)
    anthropic = F.transform(F.filter(blocks, lambda x: (x["type"] == "tool_use") & x["name"].isNotNull()), lambda x: shape(x["name"], x["input"]))
    choices = F.from_json(F.get_json_object(response, "$.choices"), "array<struct<message:struct<tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>")
    flat = F.flatten(F.transform(choices, lambda c: F.coalesce(c["message"]["tool_calls"], F.array())))
    other = F.transform(F.filter(flat, lambda x: x["function"]["name"].isNotNull()), lambda x: shape(x["function"]["name"], x["function"]["arguments"]))
    calls = F.when(provider == "openai", openai).when(provider == "anthropic", anthropic).otherwise(other)
    return F.when(F.size(calls) > 0, calls)


def extract(provider: Column, condition: Column, response: Column) -> Column:
    """struct<outcome, calls>: by the response's text for prompt conditions (a, b), by native calls for c."""
    p = parse_call(prompt_text(provider, response))
    native = native_calls(provider, response)
    by_text = F.struct(p["outcome"].alias("outcome"), F.when(p["outcome"] == "valid", F.array(F.struct(p["name"].alias("name"), p["arguments"].alias("arguments")))).alias("calls"))
    by_call = F.struct(F.when(native.isNotNull(), "valid").otherwise("no_fenced_block").alias("outcome"), native.alias("calls"))
    return F.when(condition == "c", by_call).otherwise(by_text)


def expected_call(name: Column, acceptable: Column, renames: Column) -> Column:
    """struct<name, arguments>: of a map from parameter to acceptable values, the first that isn't empty; all empty: left out."""
    first = F.transform_values(acceptable, lambda k, v: F.try_element_at(F.filter(v, lambda x: x != ""), F.lit(1)))
    return F.struct(F.when(renames, F.replace(name, F.lit("."), F.lit("_"))).otherwise(name).alias("name"), F.map_filter(first, lambda k, v: v.isNotNull()).alias("arguments"))
