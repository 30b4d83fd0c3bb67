"""The kernels as Arrow-batched column functions. Each batch crosses to Python once; rows that fail become error columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import instances, nodes, normal
from ..kernels.convert import back_json, check, convert
from ..kernels.parser import parse, tokenize
from ..kernels.writer import inlinings, to_text

CONVERSION = (
    "text string, error string, fallbacks array<struct<tool:string,reason:string>>, warnings array<struct<section:string,message:string>>, "
    "closed array<string>, renamed_any int, renamed_dict int, renamed_float int, renamed_tuple int, touched array<string>, n_tools int, n_raw int"
)
NODE = (
    "tool_ord int, node_path string, parent_path string, depth int, ord int, kind string, name string, required boolean, has_default boolean, "
    "default_json string, description string, format string, min_val double, max_val double, min_lex string, max_lex string, excl_min boolean, "
    "excl_max boolean, multiple_of string, min_len bigint, max_len bigint, pattern string, encoding string, media string, min_items bigint, "
    "max_items bigint, is_unique boolean, ref_name string, literal_json array<string>, base_type string, raw_json string, block string, "
    "has_item boolean, field_name string, parent_kind string, expression string"
)


def _struct_udf(kind: str, f: Callable[..., dict]) -> Callable[..., Column]:
    names = T.StructType.fromDDL(kind).fieldNames()

    def run(*cols: pd.Series) -> pd.DataFrame:
        rows = [f(*x) for x in zip(*cols, strict=True)]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    def one(a: pd.Series) -> pd.DataFrame:
        return run(a)

    return F.pandas_udf(one, kind)


def _value_udf(kind: str, f: Callable[[Any], Any]) -> Callable[..., Column]:
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in a], dtype=object)

    return F.pandas_udf(run, kind)


def convert_schema(schema: Column, assume_closed: bool = False, map_types: bool = False) -> Column:
    """Struct of the conversion of JSON text; what can't be read at all has an error instead of text."""

    def one(x: str | None) -> dict:
        try:
            c = convert(x if x is not None else "null", assume_closed, map_types)
        except (ValueError, RecursionError) as e:
            return {"error": str(e), "fallbacks": [], "warnings": [], "closed": [], "touched": []}
        tools = c.tree.tools if hasattr(c.tree, "tools") else [c.tree]
        return {
            "text": c.text, "fallbacks": [{"tool": t, "reason": r} for t, r in c.fallbacks], "warnings": [{"section": w.section, "message": w.message} for w in c.warnings],
            "closed": c.closed, "touched": c.touched, **{f"renamed_{k}": v for k, v in c.renames.items()}, "n_tools": len(tools), "n_raw": sum(hasattr(t, "schema") for t in tools),
        }

    return _struct_udf(CONVERSION, one)(schema)


def schema_nodes(schema: Column, assume_closed: bool = False, map_types: bool = False) -> Column:
    """The node rows of JSON text as read, before validation; empty if it can't be read."""
    from ..kernels.reader import read

    def one(x: str) -> list[dict]:
        try:
            return nodes.rows(read(x, assume_closed, map_types).tree)
        except (ValueError, RecursionError):
            return []

    return _value_udf(f"array<struct<{NODE}>>", one)(schema)


def text_nodes(text: Column) -> Column:
    """The node rows of notation text; null if it doesn't parse."""

    def one(x: str) -> list[dict] | None:
        try:
            return nodes.rows(parse(x))
        except ValueError:
            return None

    return _value_udf(f"array<struct<{NODE}>>", one)(text)


def text_error(text: Column) -> Column:
    """Why notation text doesn't parse; null if it does."""

    def one(x: str) -> str | None:
        try:
            parse(x)
        except ValueError as e:
            return str(e)
        return None

    return _value_udf("string", one)(text)


def text_tokens(text: Column) -> Column:
    """Tokens of notation text: array<struct<kind, value, line, col>>; null if it can't be cut."""

    def one(x: str):
        try:
            return [t.__dict__ for t in tokenize(x)]
        except ValueError:
            return None

    return _value_udf("array<struct<kind:string,value:string,line:int,col:int>>", one)(text)


def text_to_schema(text: Column, pretty: bool = False) -> Column:
    """JSON Schema text (a list of tools) of notation text."""
    return _value_udf("string", lambda x: back_json(x, pretty))(text)


def text_to_text(text: Column) -> Column:
    """Notation text in its one form."""
    return _value_udf("string", lambda x: to_text(parse(x)))(text)


def text_inlinings(text: Column) -> Column:
    return _value_udf("int", lambda x: inlinings(parse(x)))(text)


def text_findings(text: Column) -> Column:
    """Errors and warnings of notation text by the kernel (the same rules as operators.validate, in one crossing)."""

    def one(x: str) -> list[dict]:
        errors, warnings = check(parse(x))
        return [{"level": lv, "section": f.section, "message": f.message} for lv, fs in (("error", errors), ("warning", warnings)) for f in fs]

    return _value_udf("array<struct<level:string,section:string,message:string>>", one)(text)


def canonical_json(schema: Column) -> Column:
    return _value_udf("string", lambda x: normal.canonical(json.loads(x)))(schema)


def map_aliases(schema: Column) -> Column:
    """Canonical text with Python's type names mapped: what is hashed and checked."""
    return _value_udf("string", lambda x: normal.canonical(normal.apply_options(normal.load(x), False, True)[0]))(schema)


def required_flags(schema: Column) -> Column:
    """Whether each parameter of a tool (JSON text) is required: array<boolean>, nested objects after their parameter."""

    def flags(s: Any) -> list[bool]:
        named = s.get("properties") or {} if isinstance(s, dict) else {}
        need = set(s.get("required") or ()) if named else ()
        return [x for n, p in named.items() for x in [n in need, *(flags(p) if isinstance(p, dict) and p.get("type") == "object" else [])]]

    return _value_udf("array<boolean>", lambda x: flags((t.get("parameters") or t) if isinstance(t := json.loads(x), dict) else {}))(schema)


def malformed_reason(schema: Column) -> Column:
    """Why JSON text isn't a schema; null if it is."""

    def one(x: str) -> str | None:
        try:
            return instances.malformed({k: v for k, v in s.items() if k != "name"} if isinstance(s := normal.load(x), dict) else s)
        except ValueError as e:
            return str(e)

    return _value_udf("string", one)(schema)


def conforms(instance: Column, schema: Column) -> Column:
    """Whether JSON text conforms to a schema in JSON text; null if either is null or doesn't read."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        made: dict = {}

        def one(v, s):
            try:
                if s not in made:
                    made[s] = json.loads(s)
                return instances.conforms(json.loads(v), made[s])
            except (ValueError, TypeError, RecursionError):
                return None

        return pd.Series([one(v, s) for v, s in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, "boolean")(instance, schema)


def round_trip(schema: Column, assume_closed: bool = True, map_types: bool = True) -> Column:
    """Convert and convert back, then compare what both schemas accept: struct<same, structural, tried, thin>."""
    kind = "same boolean, structural boolean, tried int, thin boolean, disagree array<string>"

    def one(x: str) -> dict:
        try:
            source = normal.load(x)
            c = convert(source, assume_closed, map_types)
            start = normal.apply_options(source, assume_closed, map_types)[0]
            got = [instances.compare(normal.prepare(a)[0], b) for a, b in instances.align(start, json.loads(back_json(c.text)))]
        except ValueError:
            return {}
        return {"same": all(g["same"] for g in got), "structural": all(g["structural"] for g in got), "tried": sum(g["tried"] for g in got), "thin": any(g["thin"] and not g["structural"] for g in got), "disagree": [d for g in got for d in g["disagree"]]}

    return _struct_udf(kind, one)(schema)
