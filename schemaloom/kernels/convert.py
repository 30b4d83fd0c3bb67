"""The whole way of a catalog entry: read, check, keep raw what fails, write; and back."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field
from typing import Any

from .model import ABSENT, Block, Doc, Raw, Ty, closure, json_kind
from .normal import load, prepare
from .parser import parse
from .reader import read
from .writer import to_schema, to_text

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


@dataclass
class Finding:
    """A broken rule: where (block), what, and the rule's section."""

    message: str
    section: str
    block: str | None = None


def _field_findings(fields, names: set[str]) -> list[Finding]:
    out: list[Finding] = []
    seen: set[str] = set()
    for f in fields:
        if f.name in seen:
            out.append(Finding(f"duplicate field name {f.name!r} within the same block", "§4.2"))
        seen.add(f.name)
    for f in fields:
        if f.required and f.default is not ABSENT:
            out.append(Finding(f"field {f.name!r} is required but also has a default value; the two are mutually exclusive", "§4.1"))
        out += _type_findings(f.type, names)
    return out


_PAIRS = {"array": ("minItems", "maxItems", "array item count", "§6.4"), "string": ("minLength", "maxLength", "string length", "§6.3")}


def _type_findings(t: Ty, names: set[str]) -> list[Finding]:
    out: list[Finding] = []
    m = t.marks
    if t.kind == "ref" and t.name not in names:
        out.append(Finding(f"reference ${t.name} does not resolve to any definition in $defs", "§5.7"))
    low, high, label, section = None, None, "", ""
    if t.kind in _PAIRS:
        a, b, label, section = _PAIRS[t.kind]
        low, high = m.get(a), m.get(b)
    elif t.kind in ("integer", "number"):
        low, high, label, section = m.get("minimum", m.get("exclusiveMinimum")), m.get("maximum", m.get("exclusiveMaximum")), "numeric bound", "§6.2"
    if low is not None and high is not None and low > high:
        out.append(Finding(f"{label} lower bound {low} exceeds upper bound {high}", section))
    if t.kind == "union" and any(b.kind in ("const", "enum") for b in t.branches):
        out.append(Finding("union mixes type branches with value literals; a union must be wholly types (a value set is an enum, not a union)", "§5.6"))
    if t.kind == "enum":
        kinds = {{"integer": "numeric", "number": "numeric", "boolean": "boolean", "string": "string"}.get(json_kind(v), "other") for v in t.values}
        if len(kinds) > 1:
            out.append(Finding(f"enum members do not share one base type (found: {', '.join(sorted(kinds))})", "§5.6"))
    if t.kind == "object":
        out += _field_findings(t.fields, names)
    for x in [t.item, *t.branches]:
        out += _type_findings(x, names) if x else []
    return out


def check(doc: Doc) -> tuple[list[Finding], list[Finding]]:
    """All errors and all warnings of a document; the document isn't changed. Raw tools refer to nothing."""
    errors: list[Finding] = []
    warnings: list[Finding] = []
    defs = doc.defs or []
    by_name = {d.name: d for d in defs}
    blocks = [t for t in doc.tools if isinstance(t, Block)]
    if not doc.tools:
        errors.append(Finding("document contains no tool block; at least one is required", "§3.1"))
    if doc.defs == []:
        errors.append(Finding("$defs block is present but contains no definitions", "§3.2"))
    used = set().union(*(closure(t.fields, by_name) for t in blocks)) if blocks else set()
    warnings += [Finding(f"definition {d.name!r} is never referenced by any tool", "§3.2") for d in defs if d.name not in used]
    for what, some, into, section in (("definition", defs, errors, "§3.2"), ("tool", blocks, warnings, "§3.5")):
        seen: set[str] = set()
        for b in some:
            if b.name in seen:
                into.append(Finding(f"duplicate {what} name {b.name!r} in {'$defs' if what == 'definition' else 'the document'}", section))
            seen.add(b.name)
    for d in defs:
        if not _IDENTIFIER.match(d.name):
            errors.append(Finding(f"definition name {d.name!r} is not a bare identifier (no hyphens or quoting; §2.3)", "§3.2", d.name))
        errors += [Finding(f.message, f.section, d.name) for f in _field_findings(d.fields, set(by_name))]
    for t in blocks:
        errors += [Finding(f.message, f.section, t.name) for f in _field_findings(t.fields, set(by_name))]
    return errors, warnings


@dataclass
class Conversion:
    """What convert() found: the text, and all that happened on the way."""

    text: str
    tree: Any
    fallbacks: list[tuple[str | None, str]] = field(default_factory=list)
    warnings: list[Finding] = field(default_factory=list)
    closed: list[str] = field(default_factory=list)
    renames: dict[str, int] = field(default_factory=dict)
    touched: list[str] = field(default_factory=list)


def require_tools(schema: Any) -> None:
    """Tools only: a list of some, or a schema with a name."""
    if isinstance(schema, list):
        if not schema:
            raise ValueError("at least one tool definition is expected in the list")
    elif not isinstance(schema, dict):
        raise ValueError("a tool definition or a list of them is expected")
    elif "name" not in prepare(schema)[0]:
        raise ValueError("tool definitions are converted (a schema with a top-level 'name', or a list of such), not fragments of types")


def finalise(tree: Any, source: Any, fallbacks: list, warnings: list[Finding]) -> Any:
    """Check a tree; a tool with errors is kept raw as its source has it. Documents with raw tools aren't checked further."""
    doc = tree if isinstance(tree, Doc) else Doc([tree], None) if isinstance(tree, Block) else None
    if doc is None:
        return tree
    errors, more = check(doc)
    warnings += more
    if any(isinstance(t, Raw) for t in doc.tools):
        return tree
    warnings += [Finding(f"document: {e.message}", e.section) for e in errors]
    sources = [x for x in source if isinstance(x, dict)] if isinstance(source, list) else [prepare(source)[0]]
    tools: list[Any] = []
    for i, t in enumerate(doc.tools):
        own = check(Doc([t], doc.defs))[0]
        if own:
            fallbacks.append((t.name, f"semantic validation failed: {own[0].message} [{own[0].section}]"))
            warnings += [Finding(f"tool {t.name!r}: {e.message}", e.section) for e in own]
        tools.append(Raw(copy.deepcopy(sources[i] if i < len(sources) else {"name": t.name, "type": "object", "properties": {}})) if own else t)
    return Doc(tools, doc.defs)


def convert(schema: Any, assume_closed: bool = False, map_types: bool = False) -> Conversion:
    """A tool definition or a list of them (JSON text or parsed) to notation text, with the report."""
    source = load(schema)
    require_tools(source)
    r = read(source, assume_closed, map_types)
    out = Conversion("", None, r.fallbacks, [], r.closed, r.renames, r.touched)
    out.tree = finalise(r.tree, source, out.fallbacks, out.warnings)
    out.text = to_text(out.tree)
    return out


def back(text: str) -> list:
    """Notation text to JSON Schema tools; broken rules don't stop it."""
    return to_schema(parse(text))


def back_json(text: str, pretty: bool = False) -> str:
    return json.dumps(back(text), indent=2 if pretty else None)
