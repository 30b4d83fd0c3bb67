"""Request bodies of each provider and arm, and batch files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .prompts import native_name

#: Sampling settings of all requests.
TEMPERATURE, TOP_P, MAX_TOKENS = 0.0, 1.0, 512


def _messages(system: Column, user: Column, system_role: str = "system") -> Column:
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array_compact(F.array(F.when(system.isNotNull(), one(system_role, system)), one("user", user)))


def openai_body(model: Column, system: Column, user: Column, tools: Column | None = None) -> Column:
    """Responses API; tools (array of structs) make it a native request, in which the system text is a developer message."""
    head = [model.alias("model"), F.struct(F.lit("none").alias("effort")).alias("reasoning"), F.struct(F.lit("medium").alias("verbosity")).alias("text"), F.lit(TEMPERATURE).alias("temperature"), F.lit(TOP_P).alias("top_p"), F.lit(MAX_TOKENS).alias("max_output_tokens"), F.lit(True).alias("store")]
    tail = [system.alias("instructions"), user.alias("input")] if tools is None else [_messages(system, user, "developer").alias("input"), tools.alias("tools"), F.lit("auto").alias("tool_choice")]
    return F.to_json(F.struct(*head, *tail))


def anthropic_body(model: Column, system: Column, user: Column, tools: Column | None = None) -> Column:
    head = [model.alias("model"), F.lit(MAX_TOKENS).alias("max_tokens"), F.lit(TEMPERATURE).alias("temperature"), F.struct(F.lit("disabled").alias("type")).alias("thinking"), F.array(F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"), system.alias("system")]
    tail = [] if tools is None else [tools.alias("tools"), F.struct(F.lit("auto").alias("type")).alias("tool_choice")]
    return F.to_json(F.struct(*head, *tail))


def chat_body(model: Column, system: Column, user: Column, tools: Column | None = None) -> Column:
    head = [model.alias("model"), _messages(system, user).alias("messages"), F.lit(TEMPERATURE).alias("temperature"), F.lit(TOP_P).alias("top_p"), F.lit(MAX_TOKENS).alias("max_tokens"), F.struct(F.lit("none").alias("effort")).alias("reasoning")]
    tail = [] if tools is None else [tools.alias("tools"), F.lit("auto").alias("tool_choice")]
    return F.to_json(F.struct(*head, *tail))


def native_tools(provider: str, tools: Column, renames: Column | None = None) -> Column:
    """tools: array<struct<name, description, parameters>>, in a provider's shape; where renames, names have no dots."""
    name = lambda t: native_name(t["name"], F.lit(False) if renames is None else renames).alias("name")
    text = lambda t: F.coalesce(t["description"], F.lit("")).alias("description")
    if provider == "openai":
        return F.transform(tools, lambda t: F.struct(F.lit("function").alias("type"), name(t), text(t), t["parameters"].alias("parameters"), F.lit(False).alias("strict")))
    if provider == "anthropic":
        return F.transform(tools, lambda t: F.struct(name(t), text(t), t["parameters"].alias("input_schema")))
    return F.transform(tools, lambda t: F.struct(F.lit("function").alias("type"), F.struct(name(t), text(t), t["parameters"].alias("parameters")).alias("function")))


def entry_tools(entries: DataFrame, schema: str = "schema") -> DataFrame:
    """Entries' tools as they are sent: Python's type names mapped, as for the catalog. Each distinct text is read once."""
    seen = entries.select(schema).distinct().withColumn("__mapped", K.map_aliases(F.col(schema)))
    return entries.join(seen, F.equal_null(entries[schema], seen[schema]), "left").drop(seen[schema]).withColumn(schema, F.col("__mapped")).drop("__mapped")


BODIES = {"openai": openai_body, "anthropic": anthropic_body, "qwen": chat_body}


def request_bodies(rows: DataFrame) -> DataFrame:
    """rows(provider, condition, model, tool_prompt, system_text, user_text, tools) -> also body; null where skipped.

    Prompt arms put the embedded system text before the tool prompt; the native arm sends it beside the tools, whose
    names lose their dots where a column renames is there and true, as the expected calls' names do.
    """
    body = F.lit(None).cast("string")
    renames = F.coalesce(F.col("renames"), F.lit(False)) if "renames" in rows.columns else None
    system = F.coalesce(F.concat(F.col("system_text"), F.lit("\n\n"), F.col("tool_prompt")), F.col("tool_prompt"))
    for name, make in BODIES.items():
        native = make(F.col("model"), F.col("system_text"), F.col("user_text"), native_tools(name, F.col("tools"), renames))
        plain = make(F.col("model"), system, F.col("user_text"))
        body = F.when(F.col("provider") == name, F.when(F.col("condition") == "c", native).when(F.col("tool_prompt").isNotNull(), plain)).otherwise(body)
    return rows.withColumn("body", body)


def batch_lines(rows: DataFrame) -> DataFrame:
    """(provider, line): a line of the provider's batch file per request with a body; bodies stay as they are."""
    esc = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    openai = F.concat(F.lit('{"custom_id": '), esc(F.col("custom_id")), F.lit(', "method": "POST", "url": "/v1/responses", "body": '), F.col("body"), F.lit("}"))
    anthropic = F.concat(F.lit('{"custom_id": '), esc(F.col("custom_id")), F.lit(', "params": '), F.col("body"), F.lit("}"))
    other = F.concat(F.lit('{"custom_id": '), esc(F.col("custom_id")), F.lit(', "entry_id": '), esc(F.col("entry_id").cast("string")), F.lit(', "condition": '), esc(F.col("condition")), F.lit(', "request_body": '), F.col("body"), F.lit("}"))
    return rows.where("body is not null").select("provider", F.when(F.col("provider") == "openai", openai).when(F.col("provider") == "anthropic", anthropic).otherwise(other).alias("line"))
