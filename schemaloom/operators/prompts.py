"""Feature manifests and prompts: flags by aggregation over the node table, text by gated clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

# The texts of a prompt, and the name of the notation in them.
NOTATION = "CATS"
INTRO = f"""The following tools are described in {NOTATION}, a compact notation for tool definitions. Read each tool like a typed function signature.

- Each tool starts with its name on its own line, optionally followed by `#` and a description. The indented lines below are its parameters.
- Each parameter line reads left to right: the parameter name, then its type, then, optionally, a description introduced by `#`."""
RULES = {
    "mixed": "A parameter is **required** only if its name is immediately followed by `*`. A parameter with no `*` is optional.",
    "all_required": "All fields of the below tools are required (indicated by `*`).",
}
DEFAULT_VALUE = "`=value` sets a default; omit the parameter to use it."
BOUNDS = "Numeric ranges use interval notation: `integer[1,100]` accepts 1 to 100."
BOUNDS_EXCLUSIVE = "A parenthesis excludes that endpoint, so `(0,1)` is between 0 and 1 with neither included."
BOUNDS_BOTH = "A square bracket includes the endpoint and a parenthesis excludes it, so `[0,100)` allows 0 but not 100."
OPEN_BOUND = "A missing number means that side is unbounded."
MULTIPLE_OF = "A `%` after a number means the value must be a multiple of what follows it: `integer%5` accepts multiples of 5, `number%0.01` rounds to hundredths."
LENGTH = "`:length[1,20]` after a string constrains its length: at least 1 character, at most 20."
REGEX = '`:regex["..."]` after a string means the value must match that regular expression.'
ENCODING = '`:encoding[base64]` means the string is encoded that way; `:media["application/pdf"]` gives its MIME type.'
TYPED_ARRAY = "`array<T>` elements all have type T (T can be nested)."
ARRAY_BOUNDS = "Brackets after an array, like `array<string>[1,10]`, constrain how many elements it has — here, 1 to 10. (This is a count of elements, not a range of values.)"
UNIQUE = "`:unique` on an array means all its elements must be distinct."
TYPE_UNION = "A `|` between types means any one of them: `string|array<string>` accepts either. `X|null` marks a nullable field."
ENUM_MULTI = "A `|` between values restricts the field to exactly those: `sort relevance|price|newest` allows only those three."
ENUM_SINGLE = 'A quoted value like `mode "automatic"` means the field must equal exactly that.'
REFERENCE = "A type written `$Name` (for example `home_address $Address`) refers to a reusable shape defined under the `$defs` block at the top of the document. Look there for that shape's fields."
PARAMETERLESS = 'A tool shown with a name but no parameter lines takes no arguments. Call it with an empty arguments object: `{"name": "<tool_name>", "arguments": {}}`.'
FALLBACK = f"Some tools below are written as raw JSON Schema (a block starting with `{{`) instead of {NOTATION}. Read those exactly as you normally read JSON Schema tool definitions. Every tool is either fully {NOTATION} or fully JSON Schema — the two are never mixed inside one tool."
CONTRACT = """To call a tool, respond with only a single fenced JSON block in this exact shape, and nothing else:

```json
{"name": "<tool_name>", "arguments": { ... }}
```

Arguments are ordinary JSON matching the tool's parameters."""
CONTRACT_BY = {
    "mixed": " Include every required parameter; optional parameters only when you have a value for them.",
    "all_required": " Include every required parameter.",
    "all_optional": " Include any parameters you have values for.",
}
CONTRACT_END = " If no tool applies, respond in plain text with no JSON block."

JSON_INTRO = "The following tools are described using JSON Schema."

#: The flags of a manifest, in order.
FLAGS = (
    "bounds_inclusive", "bounds_exclusive", "bounds_open", "has_multiple_of", "has_string_length", "string_length_open",
    "has_regex", "has_encoding_media", "has_typed_array", "has_array_bounds", "has_unique", "has_type_union", "enum_multi",
    "enum_single", "has_defs_reference", "has_parameterless_tool", "has_default_value", "has_fallback",
)


#: What a feature row holds beside the flags: whether all or any parameters are required (null without parameters), how many
#: tools there are, and how many of them are raw.
_STATE = ("all_required", "any_required", "n_tools", "n_raw")


def features(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys: a boolean per flag and what the rest of a manifest needs. One aggregation, map-side combined.

    Uniformity looks at tools' own fields and those of nested objects, but not at those of an array's items.
    """
    c = F.col
    one_sided = lambda a, b: c(a).isNull() != c(b).isNull()
    tests = {
        "bounds_inclusive": (c("min_val").isNotNull() & ~c("excl_min")) | (c("max_val").isNotNull() & ~c("excl_max")),
        "bounds_exclusive": (c("min_val").isNotNull() & c("excl_min")) | (c("max_val").isNotNull() & c("excl_max")),
        "bounds_open": one_sided("min_val", "max_val"),
        "has_multiple_of": c("multiple_of").isNotNull(),
        "has_string_length": c("min_len").isNotNull() | c("max_len").isNotNull(),
        "string_length_open": one_sided("min_len", "max_len"),
        "has_regex": c("pattern").isNotNull(),
        "has_encoding_media": c("encoding").isNotNull() | c("media").isNotNull(),
        "has_typed_array": (c("kind") == "array") & c("has_item"),
        "has_array_bounds": c("min_items").isNotNull() | c("max_items").isNotNull(),
        "has_unique": c("is_unique"),
        "has_type_union": c("kind") == "union",
        "enum_multi": c("kind") == "enum",
        "enum_single": c("kind") == "const",
        "has_defs_reference": c("kind") == "ref",
        "has_default_value": (c("kind") == "field") & c("has_default"),
        "has_fallback": c("kind") == "raw",
    }
    param = (c("kind") == "field") & (c("tool_ord") >= 0) & c("__counted")
    counted = nodes.withColumn("__counted", ~c("node_path").rlike("/"))  # a slash marks the items of an array or a branch
    g = counted.groupBy(*keys).agg(
        *[F.bool_or(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()],
        F.bool_and(F.when(param, c("required"))).alias("all_required"), F.bool_or(F.when(param, c("required"))).alias("any_required"),
        F.count_if(c("kind").isin("tool", "raw")).alias("n_tools"), F.count_if(c("kind") == "raw").alias("n_raw"),
        F.count_distinct(F.when((c("kind") == "tool"), F.struct("doc_id", "tool_ord"))).alias("__named"), F.count_distinct(F.when((c("kind") == "field") & (c("parent_kind") == "tool"), F.struct("doc_id", "tool_ord"))).alias("__filled"),
    )
    return g.withColumn("has_parameterless_tool", c("__named") > c("__filled")).select(*keys, *FLAGS, *_STATE)


def combined() -> list[Column]:
    """Aggregates that make one feature row of many, so that tools are read once, however many prompts they are in."""
    flags = [F.bool_or(f).alias(f) for f in FLAGS]
    return [*flags, F.bool_and("all_required").alias("all_required"), F.bool_or("any_required").alias("any_required"), F.sum("n_tools").alias("n_tools"), F.sum("n_raw").alias("n_raw")]


def with_uniformity(rows: DataFrame) -> DataFrame:
    """Feature rows as manifests: required_uniformity and all_fallback in place of what they are made of."""
    uniformity = F.when(F.col("all_required"), "all_required").when(F.col("any_required"), "mixed").otherwise("all_optional")
    raw = (F.col("n_tools") > 0) & (F.col("n_tools") == F.col("n_raw"))
    return rows.withColumns({"required_uniformity": uniformity, "all_fallback": raw}).drop(*_STATE)


def manifest(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per prompt (keys): a boolean per flag, required_uniformity, all_fallback."""
    return with_uniformity(features(nodes, keys))


def full_manifest() -> dict[str, Column]:
    """The manifest of the whole grammar, as columns."""
    return {f: F.lit(True) for f in FLAGS} | {"required_uniformity": F.lit("mixed"), "all_fallback": F.lit(False)}


def _gated(*parts: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in parts]))


def primer() -> Column:
    """The calibrated text of a manifest row; empty where all tools are raw."""
    c = F.col
    core = F.concat(F.lit(INTRO), F.coalesce(F.concat(F.lit("\n- "), F.when(c("required_uniformity") == "all_required", RULES["all_required"]).when(c("required_uniformity") == "mixed", RULES["mixed"])), F.lit("")))
    some = c("bounds_inclusive") | c("bounds_exclusive")
    bounds = F.when(some, F.array_join(_gated((F.lit(True), BOUNDS), (c("bounds_inclusive") & c("bounds_exclusive"), BOUNDS_BOTH), (c("bounds_exclusive") & ~c("bounds_inclusive"), BOUNDS_EXCLUSIVE), (c("bounds_open"), OPEN_BOUND)), " "))
    length = F.when(c("has_string_length"), F.array_join(_gated((F.lit(True), LENGTH), (c("string_length_open"), OPEN_BOUND)), " "))
    rest = _gated(
        (c("has_regex"), REGEX), (c("has_encoding_media"), ENCODING), (c("has_typed_array"), TYPED_ARRAY), (c("has_array_bounds"), ARRAY_BOUNDS), (c("has_unique"), UNIQUE),
        (c("has_type_union"), TYPE_UNION), (c("enum_multi"), ENUM_MULTI), (c("enum_single"), ENUM_SINGLE), (c("has_defs_reference"), REFERENCE),
        (c("has_parameterless_tool"), PARAMETERLESS), (c("has_fallback"), FALLBACK),
    )
    parts = F.array_compact(F.array(core, F.when(c("has_default_value"), DEFAULT_VALUE), bounds, F.when(c("has_multiple_of"), MULTIPLE_OF), length))
    return F.when(c("all_fallback"), F.lit("")).otherwise(F.array_join(F.concat(parts, rest), "\n\n"))


def contract(uniformity: Column) -> Column:
    """What the model is told about its answer."""
    by = F.when(uniformity == "all_required", CONTRACT_BY["all_required"]).when(uniformity == "all_optional", CONTRACT_BY["all_optional"]).otherwise(CONTRACT_BY["mixed"])
    return F.concat(F.lit(CONTRACT), by, F.lit(CONTRACT_END))


def sections(intro: Column, tools: Column, uniformity: Column) -> Column:
    return F.concat_ws("\n\n", intro, F.lit("---"), tools, F.lit("---"), contract(uniformity))


def system_prompt(text: Column) -> Column:
    """Primer, fenced notation and contract of a manifest row; null where all tools are raw."""
    return F.when(~F.col("all_fallback"), sections(primer(), F.concat(F.lit("```\n"), text, F.lit("\n```")), F.col("required_uniformity")))


def json_prompt(canonical_tools: Column, uniformity: Column, intro: str = JSON_INTRO) -> Column:
    """The JSON arm: intro, fenced array of canonical tools (an array column of texts), contract."""
    return sections(F.lit(intro), F.concat(F.lit("```json\n["), F.array_join(canonical_tools, ","), F.lit("]\n```")), uniformity)


def json_arm(tools: DataFrame, keys: list[str], schema: str = "schema") -> DataFrame:
    """tools(keys, schema as canonical JSON) -> per key: tools (distinct texts, in order) and required_uniformity of their
    parameters, those of nested objects included."""
    need = K.required_flags(F.col(schema))
    g = tools.groupBy(*keys, schema).agg(F.lit(1).alias("__one")).withColumn("__f", need).groupBy(*keys).agg(F.array_sort(F.collect_list(schema)).alias("tools"), F.bool_and(F.when(F.size("__f") > 0, ~F.array_contains("__f", False))).alias("__all"), F.bool_or(F.array_contains("__f", True)).alias("__any"))
    return g.select(*keys, "tools", F.when(F.col("__all"), "all_required").when(F.col("__any"), "mixed").otherwise("all_optional").alias("required_uniformity"))


def contract_section(prompt: Column) -> Column:
    """The last of a prompt's three sections; null if there aren't three."""
    parts = F.split(prompt, "\n---\n")
    return F.when(F.size(parts) == 3, F.element_at(parts, 3))


def overhead(uniformity: Column) -> Column:
    """Text around the tools: what a prompt costs beside them."""
    return sections(primer(), F.lit("```\n\n```"), uniformity)


def prompt_rows(texts: DataFrame, nodes: DataFrame, key: str, full_grammar: bool = False) -> DataFrame:
    """texts(key, text) of documents and their nodes (doc_id = key) -> key, the manifest, primer and prompt.

    Of a document with raw tools only, primer is empty and prompt null: it goes by the native channel. With full_grammar
    other documents have every clause.
    """
    m = manifest(nodes.withColumn(key, F.col("doc_id")), [key])
    if full_grammar:
        m = m.withColumns({k: F.when(F.col("all_fallback"), F.col(k)).otherwise(v) for k, v in full_manifest().items()})
    return texts.select(key, "text").join(m, key).withColumns({"primer": primer(), "prompt": system_prompt(F.col("text"))}).drop("text")


def question_parts(messages: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """messages(key, turn, role, text) -> per key: the first system text, the last user text, whether there is a system."""
    role = F.col("role")
    return messages.groupBy(key).agg(F.min_by("text", F.when(role == "system", F.col(turn))).alias("system_text"), F.max_by("text", F.when(role == "user", F.col(turn))).alias("user_text"), F.count_if(role == "system").alias("n_system")).withColumn("has_system", F.col("n_system") > 0)


def question_problems(messages: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per key with a problem, which: a message without role or content before a question without a user message."""
    role, bad = F.col("role"), F.col("role").isNull() | F.col("text").isNull()
    g = messages.groupBy(key).agg(F.min(F.when(bad, F.col(turn))).alias("at"), F.count_if(role == "user").alias("__users"))
    what = F.when(F.col("at").isNotNull(), "missing role or content").when(F.col("__users") == 0, "no user message")
    return g.select(key, what.alias("problem"), "at").where("problem is not null")


def checked_questions(messages: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """question_parts of messages without a problem; one is an error that names the least key."""
    if row := question_problems(messages, key, turn).orderBy(key).limit(1).collect():
        raise ValueError(f"{row[0].problem}: {key} {row[0][key]}")
    return question_parts(messages, key, turn)


def with_system_ids(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """The keys whose question has a system message."""
    return messages.where("role = 'system'").select(key).distinct()


def with_embedded_system(prompt: Column, system: Column) -> Column:
    return F.coalesce(F.concat(system, F.lit("\n\n"), prompt), prompt)


def native_name(name: Column, renames: Column) -> Column:
    """Dots aren't allowed in names of native calls."""
    return F.when(renames, F.replace(name, F.lit("."), F.lit("_"))).otherwise(name)
