"""The tree of a tool document: types, fields, blocks."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Stands for "no default", which differs from a default of null.
ABSENT: Any = type("Absent", (), {"__repr__": lambda s: "ABSENT", "__reduce__": lambda s: "ABSENT"})()

#: The type words of the notation, and the words that read as literals.
TYPE_WORDS = ("string", "integer", "number", "boolean", "array", "object", "null", "any")
LITERAL_WORDS = ("true", "false", "null")
#: Format values that would read as another annotation.
RESERVED_FORMATS = ("length", "regex", "encoding", "media", "unique")


@dataclass
class Ty:
    """A type: one of the type words, or ref, union, enum, const. marks holds its constraints under their JSON names."""

    kind: str
    marks: dict[str, Any] = field(default_factory=dict)
    item: Ty | None = None
    fields: list[Fld] = field(default_factory=list)
    branches: list[Ty] = field(default_factory=list)
    values: list[Any] = field(default_factory=list)
    base: str | None = None
    name: str | None = None

    def children(self) -> list[Ty]:
        """Types nested in this one, fields included."""
        return ([self.item] if self.item else []) + self.branches + [f.type for f in self.fields]


@dataclass
class Fld:
    name: str
    type: Ty
    required: bool = False
    default: Any = ABSENT
    description: str | None = None


@dataclass
class Block:
    """A tool or a definition."""

    name: str
    fields: list[Fld]
    description: str | None = None


@dataclass
class Raw:
    """A tool kept as JSON Schema."""

    schema: Any


@dataclass
class Doc:
    """defs: None without a block of definitions, else a list (perhaps empty)."""

    tools: list[Block | Raw]
    defs: list[Block] | None = None


def json_kind(v: Any) -> str:
    """The JSON type name of a value; whole floats are numbers."""
    if v is None:
        return "null"
    for t, name in ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (list, "array"), (dict, "object")):
        if isinstance(v, t):
            return name
    return "unknown"


def is_number(v: Any) -> bool:
    return json_kind(v) in ("integer", "number")


def common_base(values: list[Any]) -> str | None:
    """The one type of a list of literals; integers and other numbers together are numbers; None if they differ."""
    kinds = {json_kind(v) for v in values}
    if kinds == {"integer", "number"}:
        return "number"
    return kinds.pop() if len(kinds) == 1 and kinds <= {"boolean", "integer", "number", "string"} else None


def references(fields: list[Fld]) -> list[str]:
    """Names that fields refer to, in order, each once."""
    out: dict[str, None] = {}
    todo = [f.type for f in reversed(fields)]
    while todo:
        t = todo.pop()
        if t.kind == "ref":
            out[t.name] = None
        todo += reversed(t.children())
    return list(out)


def closure(fields: list[Fld], defs: dict[str, Block]) -> set[str]:
    """Names that fields reach over definitions; a name without a definition is in it, but leads nowhere."""
    seen: set[str] = set()
    todo = references(fields)
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += references(defs[n].fields) if n in defs else []
    return seen
