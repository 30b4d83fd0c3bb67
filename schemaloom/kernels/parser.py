"""Notation text to the tree, by a scanner over lines and recursive descent over a line's tokens."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from .model import ABSENT, TYPE_WORDS, Block, Doc, Fld, Raw, Ty, common_base

#: A token's kind is the name of the group that matches; blanks part tokens.
_TOKEN = re.compile(
    r"""(?P<blank>\ +)
      | (?P<string>"(?:[^"\\]|\\["\\])*")
      | (?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)
      | (?P<word>[A-Za-z_][A-Za-z0-9_-]*)
      | (?P<mark>[$*|:%,<>\[\]()=])""",
    re.X,
)
#: Token kinds of the marks.
MARKS = {"$": "dollar", "*": "star", "|": "pipe", ":": "colon", "%": "percent", ",": "comma", "<": "langle", ">": "rangle", "[": "lbracket", "]": "rbracket", "(": "lparen", ")": "rparen", "=": "equals"}


class NotationError(ValueError):
    """Text that isn't notation, with the place."""

    def __init__(self, message: str, line: int, col: int):
        super().__init__(f"{message} (line {line}, column {col})")
        self.message, self.line, self.col = message, line, col


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    line: int
    col: int


def _json_end(line: str, at: int, no: int) -> int:
    """Where the JSON array or object that starts at `at` ends: by depth, strings skipped."""
    depth, i, inside = 0, at, False
    while i < len(line):
        c = line[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise NotationError("unterminated JSON literal", no, at + 1)


def _scan(line: str, at: int, no: int) -> list[Token]:
    out: list[Token] = []
    while at < len(line):
        if line[at] == "#":
            out.append(Token("hash", "#", no, at + 1))
            at += 2 if line[at + 1 : at + 2] == " " else 1
            out.append(Token("description", line[at:], no, at + 1))
            break
        m = _TOKEN.match(line, at)
        if not m:
            what = "tab character is not a valid token separator" if line[at] == "\t" else "unterminated string literal" if line[at] == '"' else "'-' is not the start of a valid number" if line[at] == "-" else f"unexpected character {line[at]!r}"
            raise NotationError(what, no, at + 1)
        kind, text = m.lastgroup, m[0]
        if kind == "string":
            out.append(Token("string", re.sub(r"\\(.)", r"\1", text[1:-1]), no, at + 1))
        elif kind == "mark":
            out.append(Token(MARKS[text], text, no, at + 1))
            if text == "=" and line[at + 1 : at + 2] in ("{", "["):
                end = _json_end(line, at + 1, no)
                out.append(Token("json", line[at + 1 : end], no, at + 2))
                at = end
                continue
        elif kind != "blank":
            out.append(Token(kind, text, no, at + 1))
        at = m.end()
    out.append(Token("newline", "", no, len(line) + 1))
    return out


def tokenize(text: str) -> list[Token]:
    """All tokens, with indent and dedent tokens where the depth of lines changes, and an end."""
    if text.startswith("﻿"):
        raise NotationError("a byte-order mark must not start a document", 1, 1)
    out: list[Token] = []
    open_levels = [0]
    lines = text.split("\n")
    for no, line in enumerate(lines, 1):
        line = line.removesuffix("\r")
        if not line.strip():
            continue
        blank = len(line) - len(line.lstrip(" "))
        if line[blank] == "\t":
            raise NotationError("tab characters must not be used for indentation", no, blank + 1)
        level, odd = divmod(blank, 2)
        if odd:
            raise NotationError("indentation must be a multiple of two spaces", no, 1)
        if level > open_levels[-1]:
            open_levels.append(level)
            out.append(Token("indent", "", no, blank + 1))
        while level < open_levels[-1]:
            open_levels.pop()
            out.append(Token("dedent", "", no, blank + 1))
        if level != open_levels[-1]:
            raise NotationError("dedent does not match any enclosing indentation level", no, blank + 1)
        out += _scan(line, blank, no)
    end = len(lines) + 1
    return out + [Token("dedent", "", end, 1)] * (len(open_levels) - 1) + [Token("end", "", end, 1)]


def number(text: str) -> int | float:
    return float(text) if any(c in text for c in ".eE") else int(text)


#: Which types an annotation may stand on; format stands on all but null and any.
_HOME = {"bounds": ("integer", "number", "array"), "multipleOf": ("integer", "number"), "length": ("string",), "pattern": ("string",), "contentEncoding": ("string",), "contentMediaType": ("string",), "uniqueItems": ("array",)}
_SAYS = {"bounds": "numeric bound", "multipleOf": "%divisor", "length": ":length", "pattern": ":regex", "contentEncoding": ":encoding", "contentMediaType": ":media", "uniqueItems": ":unique"}


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def fail(self, what: str, t: Token | None = None):
        t = t or self.peek()
        raise NotationError(what, t.line, t.col)

    def take(self, *kinds: str, what: str = "") -> Token:
        t = self.peek()
        if kinds and t.kind not in kinds:
            self.fail(f"expected {what or ' or '.join(kinds)}, got {t.kind}")
        self.at += 1
        return t

    def maybe(self, kind: str) -> Token | None:
        return self.take() if self.peek().kind == kind else None

    def document(self) -> Doc:
        defs = None
        if self.peek().kind == "dollar":
            self.take()
            if self.take("word", what="'defs' after '$'").value != "defs":
                self.fail("expected '$defs' at the top level", self.tokens[self.at - 1])
            self.take("newline", what="end of the '$defs' line")
            defs = []
            if self.maybe("indent"):
                while self.peek().kind != "dedent":
                    defs.append(self.block(need_body=True))
                self.take("dedent")
        tools = []
        while self.peek().kind != "end":
            tools.append(self.block())
        return Doc(tools, defs)

    def block(self, need_body: bool = False) -> Block:
        head = self.take("word", "string", what="a name at the start of a block")
        name = head.value
        text = self.description()
        self.take("newline", what="end of the header line")
        if need_body and self.peek().kind != "indent":
            self.fail(f"definition {name!r} has no body", head)
        return Block(name, self.body() if self.peek().kind == "indent" else [], text)

    def body(self) -> list[Fld]:
        self.take("indent")
        out = []
        while self.peek().kind != "dedent":
            out.append(self.line())
        self.take("dedent")
        return out

    def line(self) -> Fld:
        name = self.take("word", "string", what="a field name").value
        required = bool(self.maybe("star"))
        if self.peek().kind not in ("word", "string", "number", "dollar"):
            self.fail(f"field {name!r} has no type expression")
        t = self.expression()
        default = self.default() if self.maybe("equals") else ABSENT
        text = self.description()
        self.take("newline", what="end of field line")
        if (deeper := self.peek()).kind == "indent":
            home = t if t.kind == "object" else t.item if t.kind == "array" and t.item and t.item.kind == "object" else None
            inner = self.body()
            if home is None:
                self.fail("nested block under a field whose type cannot contain fields", deeper)
            home.fields = inner
        return Fld(name, t, required, default, text)

    def description(self) -> str | None:
        if not self.maybe("hash"):
            return None
        text = self.take("description").value
        return text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text

    def default(self) -> Any:
        t = self.take("json", "string", "number", "word", what="a default value after '='")
        if t.kind == "json":
            try:
                return json.loads(t.value)
            except json.JSONDecodeError as e:
                self.fail(f"invalid JSON default {t.value!r}: {e.msg}", t)
        return self.literal(t, {"true": True, "false": False, "null": None})

    @staticmethod
    def literal(t: Token, words: dict) -> Any:
        return number(t.value) if t.kind == "number" else words.get(t.value, t.value) if t.kind == "word" else t.value

    def expression(self) -> Ty:
        """All branches types: a union; all values: an enum, or a const if one; mixed: a union with consts in it."""
        parts = [self.branch()]
        while self.maybe("pipe"):
            parts.append(self.branch())
        if len(parts) == 1:
            return parts[0]
        if all(p.kind == "const" for p in parts):
            values = [p.values[0] for p in parts]
            return Ty("enum", values=values, base=common_base(values))
        return Ty("union", branches=parts)

    def branch(self) -> Ty:
        t = self.take("dollar", "word", "string", "number", what="a type or value")
        if t.kind == "dollar":
            return self.chain(Ty("ref", name=self.take("word", what="a name after '$'").value))
        if t.kind != "word" or t.value not in TYPE_WORDS:
            return Ty("const", values=[self.literal(t, {"true": True, "false": False})])
        out = Ty(t.value)
        if t.value == "array" and self.maybe("langle"):
            out.item = self.expression()
            self.take("rangle", what="'>' to close the array element type")
        return self.chain(out)

    def chain(self, t: Ty) -> Ty:
        """Annotations in any order; of repeats the last counts."""
        got: dict[str, tuple[Any, Token]] = {}
        while (at := self.peek()).kind in ("colon", "lbracket", "lparen", "percent"):
            if at.kind == "colon":
                self.take()
                name, value = self.named()
                got[name] = (value, at)
            elif at.kind == "percent":
                self.take()
                got["multipleOf"] = (number(self.take("number", what="a number after '%'").value), at)
            else:
                got["bounds"] = (self.bounds(), at)
        for name, (value, at) in got.items():
            if t.kind in ("null", "any"):
                self.fail(f"annotation cannot attach to a {t.kind} type", at)
            if name in _HOME and t.kind not in _HOME[name]:
                self.fail(f"{_SAYS[name]} cannot attach to a {t.kind if t.kind != 'ref' else 'reference'} type", at)
            if name == "bounds":
                low, high, open_low, open_high = value
                keys = ("minItems", "maxItems") if t.kind == "array" else ("exclusiveMinimum" if open_low else "minimum", "exclusiveMaximum" if open_high else "maximum")
                t.marks |= {k: v for k, v in zip(keys, (low, high), strict=True) if v is not None}
            elif name == "length":
                t.marks |= {k: v for k, v in zip(("minLength", "maxLength"), value, strict=True) if v is not None}
            else:
                t.marks[name] = value
        return t

    def named(self) -> tuple[str, Any]:
        word = self.take("word", what="an annotation name after ':'").value
        if word == "unique":
            return "uniqueItems", True
        if word not in ("length", "regex", "encoding", "media") or self.peek().kind != "lbracket":
            return "format", word
        if word == "length":
            return "length", self.bounds()[:2]
        self.take("lbracket")
        value = self.take("word" if word == "encoding" else "string", what=f"the value of :{word}").value
        self.take("rbracket", what=f"']' to close ':{word}'")
        return {"regex": "pattern", "encoding": "contentEncoding", "media": "contentMediaType"}[word], value

    def bounds(self) -> tuple[Any, Any, bool, bool]:
        left = self.take("lbracket", "lparen").kind == "lparen"
        low = self.maybe("number")
        self.take("comma", what="',' separating the two bounds")
        high = self.maybe("number")
        right = self.take("rbracket", "rparen", what="']' or ')' to close the bounds").kind == "rparen"
        return number(low.value) if low else None, number(high.value) if high else None, left, right


def _raw(block: list[str]) -> Raw:
    if len(block) > 1:
        raise NotationError("a raw JSON Schema tool must be a single physical line", 2, 1)
    text = block[0].strip()
    try:
        got, end = json.JSONDecoder().raw_decode(text)
    except json.JSONDecodeError as e:
        raise NotationError(f"invalid raw JSON Schema tool object: {e.msg}", 1, e.pos + 1) from e
    if text[end:].strip():
        raise NotationError("trailing content after raw JSON Schema tool object", 1, end + 1)
    return Raw(got)


def parse_tokens(tokens: list[Token]) -> Doc:
    return _Parser(tokens).document()


def parse(text: str) -> Doc:
    """A document: blocks parted by blank lines, each raw JSON (it starts with a brace), definitions or tools."""
    out = Doc([], None)
    block: list[str] = []
    for line in [*text.strip().split("\n"), ""]:
        if line.strip():
            block.append(line)
            continue
        if block and block[0].lstrip().startswith("{"):
            out.tools.append(_raw(block))
        elif block:
            part = parse_tokens(tokenize("\n".join(block)))
            if part.defs is not None:
                if out.defs is not None:
                    raise NotationError("multiple '$defs' blocks in one document", 1, 1)
                out.defs = part.defs
            out.tools += part.tools
        block = []
    return out
