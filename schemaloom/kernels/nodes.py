"""A tree as flat rows: one per tool, definition, field, type and raw tool."""

from __future__ import annotations

import json
from typing import Any

from .model import ABSENT, Block, Doc, Raw, Ty
from .writer import expression

#: Columns of a row, in order. Numbers keep their literal beside the double.
COLUMNS = (
    "tool_ord", "node_path", "parent_path", "depth", "ord", "kind", "name", "required", "has_default", "default_json",
    "description", "format", "min_val", "max_val", "min_lex", "max_lex", "excl_min", "excl_max", "multiple_of", "min_len",
    "max_len", "pattern", "encoding", "media", "min_items", "max_items", "is_unique", "ref_name", "literal_json",
    "base_type", "raw_json", "block", "has_item", "field_name", "parent_kind", "expression",
)


def _row(**known: Any) -> dict:
    return dict.fromkeys(COLUMNS) | {"is_unique": False, "excl_min": False, "excl_max": False, "has_item": False} | known


def _whole(v: Any) -> int | None:
    return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _type_rows(t: Ty, path: str, parent: str, parent_kind: str, depth: int, ord_: int, base: dict, out: list[dict]) -> None:
    m = t.marks
    low, high = m.get("minimum", m.get("exclusiveMinimum")), m.get("maximum", m.get("exclusiveMaximum"))
    out.append(
        _row(
            **base, node_path=path, parent_path=parent, parent_kind=parent_kind, depth=depth, ord=ord_, kind=t.kind, format=m.get("format"),
            min_val=None if low is None else float(low), max_val=None if high is None else float(high), min_lex=None if low is None else json.dumps(low),
            max_lex=None if high is None else json.dumps(high), excl_min="exclusiveMinimum" in m, excl_max="exclusiveMaximum" in m,
            multiple_of=json.dumps(m["multipleOf"]) if "multipleOf" in m else None, min_len=_whole(m.get("minLength")), max_len=_whole(m.get("maxLength")),
            pattern=m.get("pattern"), encoding=m.get("contentEncoding"), media=m.get("contentMediaType"), min_items=_whole(m.get("minItems")), max_items=_whole(m.get("maxItems")),
            is_unique=bool(m.get("uniqueItems")), ref_name=t.name, literal_json=[json.dumps(v) for v in t.values] or None, base_type=t.base, has_item=t.item is not None,
            expression=expression(t),
        )
    )
    for i, x in enumerate([t.item] if t.item else t.branches):
        _type_rows(x, f"{path}/{i}", path, t.kind, depth + 1, i, base, out)
    _field_rows(t.fields, path, t.kind, depth + 1, base, out)


def _field_rows(fields, parent: str, parent_kind: str, depth: int, base: dict, out: list[dict]) -> None:
    for i, f in enumerate(fields):
        path = f"{parent}.{i}"
        given = f.default is not ABSENT
        out.append(_row(**base, node_path=path, parent_path=parent, parent_kind=parent_kind, depth=depth, ord=i, kind="field", name=f.name, required=f.required, has_default=given, default_json=json.dumps(f.default) if given else None, description=f.description))
        _type_rows(f.type, f"{path}:", path, "field", depth + 1, 0, base | {"field_name": f.name}, out)


def rows(tree: Any) -> list[dict]:
    """Rows in document order; tool_ord counts tools, definitions count from -1 down."""
    doc = tree if isinstance(tree, Doc) else Doc([tree], None)
    out: list[dict] = []
    if doc.defs is not None:
        out.append(_row(node_path="$defs", depth=0, ord=0, kind="defs", tool_ord=-1))
    for kind, blocks in (("definition", doc.defs or []), ("tool", doc.tools)):
        for i, b in enumerate(blocks):
            path, base = f"{kind}{i}", {"tool_ord": i if kind == "tool" else -1 - i}
            if isinstance(b, Raw):
                out.append(_row(**base, node_path=path, depth=0, ord=i, kind="raw", raw_json=json.dumps(b.schema), name=b.schema.get("name") if isinstance(b.schema, dict) else None))
            elif isinstance(b, Block):
                base["block"] = b.name
                out.append(_row(**base, node_path=path, depth=0, ord=i, kind=kind, name=b.name, description=b.description))
                _field_rows(b.fields, path, kind, 1, base, out)
    return out
