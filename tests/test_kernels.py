"""The compiler: reading, writing, parsing, checks, options, node rows and schema equivalence."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaloom.kernels import instances, nodes
from schemaloom.kernels.convert import back, back_json, check, convert, require_tools
from schemaloom.kernels.model import ABSENT, Block, Doc, Raw, closure
from schemaloom.kernels.normal import apply_options, canonical, content_hash, load, prepare
from schemaloom.kernels.parser import NotationError, parse, parse_tokens, tokenize
from schemaloom.kernels.reader import read, read_type
from schemaloom.kernels.writer import inlinings, to_schema, to_text


def tool(props, required=(), name="t", **more):
    return {"name": name, "type": "object", "properties": props, "required": list(required), "additionalProperties": False, **more}


GOOD = tool(
    {
        "who": {"type": "string", "minLength": 1, "maxLength": 9, "pattern": '^"\\d+$', "description": "a # here"},
        "when": {"type": "string", "format": "date-time"},
        "n": {"type": "integer", "minimum": 1, "exclusiveMaximum": 10, "multipleOf": 3, "default": 3},
        "x": {"type": "number", "exclusiveMinimum": 0.5, "default": 1.0},
        "blob": {"type": "string", "contentEncoding": "base64", "contentMediaType": "image/png"},
        "tags": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}, "minItems": 1, "uniqueItems": True, "default": ["a b"]},
        "any thing": {},
        "either": {"anyOf": [{"type": "string"}, {"type": "null"}, {"$ref": "#/$defs/P"}]},
        "mode": {"enum": ["string", "a b", "ok", "true", "1"]},
        "lvl": {"type": "number", "enum": [1, 2.5]},
        "k": {"const": 4},
        "o": {"type": "object", "properties": {"a": {"type": "boolean"}, "b": {"$ref": "#/$defs/P"}}, "required": ["a"], "additionalProperties": False},
        "rows": {"type": "array", "items": {"type": "object", "properties": {"z": {"type": "null"}}, "additionalProperties": False}},
    },
    ["who", "o"],
    description="does it",
    **{"$defs": {"P": {"type": "object", "properties": {"q": {"$ref": "#/$defs/P"}}, "additionalProperties": False}}},
)


def test_text_of_everything():
    assert convert(GOOD).text.split("\n") == [
        "$defs",
        "  P",
        "    q $P",
        "",
        "t # does it",
        '  who* string:length[1,9]:regex["^\\"\\\\d+$"] # "a # here"',
        "  when string:date-time",
        "  n integer[1,10)%3 =3",
        "  x number(0.5,] =1.0",
        '  blob string:encoding[base64]:media["image/png"]',
        '  tags array<array<integer>>[1,]:unique =["a b"]',
        '  "any thing" any',
        "  either string|null|$P",
        '  mode "string"|"a b"|ok|"true"|"1"',
        "  lvl 1|2.5",
        "  k 4",
        "  o* object",
        "    a* boolean",
        "    b $P",
        "  rows array<object>",
        "    z null",
    ]


def test_round_trip_is_a_fixed_point():
    text = convert(GOOD).text
    again = back(text)
    assert convert(again).text == text
    assert instances.compare(GOOD, again[0])["same"]
    assert list(again[0]) == ["name", "description", "$defs", "type", "properties", "required", "additionalProperties"]
    assert list(again[0]["properties"]["n"]) == ["type", "default", "minimum", "exclusiveMaximum", "multipleOf"]
    assert json.loads(back_json(text, pretty=True)) == again


@pytest.mark.parametrize(
    ("prop", "reason"),
    [
        ({"oneOf": [{}]}, "unencodable keyword(s) ['oneOf']"),
        ({"allOf": [{}], "not": {}}, "['allOf', 'not']"),
        ({"$ref": "#/$defs/A", "type": "string"}, "sibling"),
        ({"$ref": "other.json"}, "only #/$defs/Name"),
        ({"$ref": "#/$defs/a-b"}, "bare identifier"),
        ({"const": 1, "minimum": 0}, "const with"),
        ({"const": "a", "type": "integer"}, "contradicts"),
        ({"enum": []}, "non-empty"),
        ({"enum": [1, "a"]}, "mixed-type"),
        ({"enum": ["abc", "a"], "minLength": 2}, "minLength"),
        ({"enum": [0.3, 0.6], "multipleOf": 0.1}, "multipleOf"),
        ({"enum": ["a", "b"], "format": "x"}, "enum with"),
        ({"anyOf": [{}], "type": "string"}, "anyOf combined"),
        ({"type": ["string", "null"], "format": "date"}, "type-array"),
        ({"type": []}, "empty type array"),
        ({"type": "strange"}, "unknown type"),
        ({"minimum": 1}, "typeless"),
        ({"type": "string", "minimum": 1}, "string with"),
        ({"type": "integer", "minimum": 1, "exclusiveMinimum": 1}, "both"),
        ({"type": "integer", "minimum": True}, "non-numeric"),
        ({"type": "number", "multipleOf": 0}, "positive"),
        ({"type": "array", "items": [{}]}, "tuple-style"),
        ({"type": "object"}, "open object"),
        ({"type": "string", "format": "unique"}, "reserved"),
        ({"type": "null", "format": "x"}, "null with"),
        (True, "boolean schema"),
        ({"anyOf": [{"type": "object", "properties": {"a": {}}, "additionalProperties": False}]}, "shaped object"),
        ({"type": "array", "items": {"type": "array", "items": {"type": "object", "properties": {"a": {}}, "additionalProperties": False}}}, "shaped object"),
    ],
)
def test_what_keeps_a_tool_raw(prop, reason):
    c = convert(tool({"q": prop}))
    assert len(c.fallbacks) == 1 and reason in c.fallbacks[0][1]
    assert json.loads(c.text) == tool({"q": prop}) and back(c.text) == [tool({"q": prop})]


def test_collapses():
    t = read_type({"enum": [True, False]})
    assert t.kind == "boolean" and read_type({"enum": ["a"]}).kind == "const" and read_type({"type": ["string"]}).kind == "string"
    assert read_type({"enum": [1, 2], "type": "number", "minimum": 0}).base == "number"
    assert read_type({"title": "x", "examples": [1]}).kind == "any"


def test_options():
    s, closed, renames, touched = apply_options(tool({"a": {"type": "float"}, "b": {"type": "dict", "properties": {"c": {"type": "any"}}}, "d": {"type": "tuple"}, "e": {"type": ["object", "null"]}}), True, True)
    assert renames == {"float": 1, "dict": 1, "tuple": 1, "any": 1}
    assert closed == ["/properties/b", "/properties/e"] and touched == ["/properties/a", "/properties/b", "/properties/b/properties/c", "/properties/d"]
    assert s["properties"]["b"]["additionalProperties"] is False and "type" not in s["properties"]["b"]["properties"]["c"]
    source = tool({"a": {"type": "dict"}})
    before = json.dumps(source)
    assert convert(source).fallbacks and not convert(source, True, True).fallbacks and json.dumps(source) == before


def test_literals_and_envelopes():
    assert load({"additionalProperties": "FALSE", "default": "null", "type": ["string", "null"], "const": "Null"}) == {"additionalProperties": False, "default": None, "type": ["string", "null"], "const": None}
    inner = tool({"a": {"type": "string"}})
    bare = {k: v for k, v in inner.items() if k != "name"}
    for e in ({"name": "t", "parameters": bare, "strict": True}, {"name": "t", "input_schema": bare}, {"type": "function", "function": {"name": "t", "parameters": bare}}):
        assert convert(e).text == convert(inner).text
    assert prepare({"name": "n", "description": "outer", "parameters": {"type": "object", "description": "in"}})[0]["description"] == "outer"


def test_legacy_spellings():
    s = tool({"a": {"$ref": "#/definitions/D"}, "nullable": {"type": "string", "nullable": True}, "r": {"$ref": "#/definitions/D", "nullable": True}, "f": {"type": "string", "nullable": False}}, definitions={"D": tool({}, name="x") | {"name": "x"}})
    s["definitions"]["D"].pop("name")
    text = convert(s).text
    assert "  a $D" in text and "  nullable string|null" in text and "  r $D|null" in text and "  f string" in text
    both = tool({}, **{"definitions": {}, "$defs": {}})
    assert "both present" in convert(both).fallbacks[0][1]


def test_definitions_of_many_tools():
    d = lambda k: {"type": "object", "properties": {k: {}}, "additionalProperties": False}
    use = {"a": {"$ref": "#/$defs/D"}}
    same = [tool(use, name="x", **{"$defs": {"D": d("q")}}), tool(use, name="y", **{"$defs": {"D": d("q")}})]
    assert convert(same).text.count("$defs") == 1 and not convert(same).fallbacks
    differ = [*same, tool(use, name="z", **{"$defs": {"D": d("w")}}), tool({}, name="free")]
    c = convert(differ)
    assert [t for t, _ in c.fallbacks] == ["x", "y", "z"] and "conflicting" in c.fallbacks[0][1]
    assert convert([{"no": 1}]).fallbacks == [(None, "envelope element is not a tool schema")]
    unread = [tool(use, name="x", **{"$defs": {"D": {"type": "string"}}})]
    assert convert(unread).fallbacks[0][0] == "x"


def test_guards():
    for bad in ([], {"type": "string"}, 3, "[]"):
        with pytest.raises(ValueError):
            require_tools(load(bad))


@pytest.mark.parametrize(
    ("prop", "message"),
    [
        ({"type": "integer", "minimum": 5, "maximum": 1}, "numeric bound lower bound 5 exceeds upper bound 1"),
        ({"type": "string", "minLength": 5, "maxLength": 1}, "string length"),
        ({"type": "array", "minItems": 5, "maxItems": 1}, "array item count"),
        ({"anyOf": [{"const": 1}, {"type": "string"}]}, "union mixes"),
        ({"$ref": "#/$defs/Gone"}, "does not resolve"),
    ],
)
def test_checks_keep_tools_raw(prop, message):
    c = convert([tool({"q": prop}), tool({}, name="fine")])
    assert [t for t, _ in c.fallbacks] == ["t"] and message in c.fallbacks[0][1]
    assert isinstance(c.tree.tools[0], Raw) and isinstance(c.tree.tools[1], Block) and c.warnings


def test_mixed_documents_are_not_checked_further():
    c = convert([tool({"q": {"not": {}}}), tool({"q": {"type": "integer", "minimum": 5, "maximum": 1}}, name="u")])
    assert [t for t, _ in c.fallbacks] == ["t"]


def test_all_findings_at_once():
    text = '$defs\n  "a-b"\n    x string\n  D\n    x string\n  D\n    x string\n\nt\n  a* integer =1\n  a 1|x\n  b string|"v"\n  c $No\n\nt\n  z any'
    doc = parse(text)
    before = to_text(doc)
    errors, warnings = check(doc)
    assert len(errors) == 7 and len(warnings) == 4 and to_text(doc) == before
    assert [e.section for e in check(Doc([], []))[0]] == ["§3.1", "§3.2"]


@pytest.mark.parametrize(
    ("text", "line"),
    [
        ("﻿t\n  a string", 1), ("t\n\ta string", 2), ("t\n   a string", 2), ("t\n    a string\n  b string", 3), ("t\n  a string\tx", 2), ('t\n  a "open', 2), ("t\n  a -x", 2),
        ("t\n  a", 2), ("t\n  a string[1,2]", 2), ("t\n  a object:unique", 2), ("t\n  a null:date", 2), ("t\n  a any[1,2]", 2), ("t\n  a integer:length[1,2]", 2), ("t\n  a integer%x", 2),
        ("t\n  a integer[1 2]", 2), ("t\n  a integer[1,2", 2), ("t\n  a array<string", 2), ("t\n  a string\n    b string", 3), ("t\n  a string =", 2), ("t\n  a any ={bad}", 2), ("t\n  a any ={", 2),
        ("$defs # no\n  D\n    x any", 1), ("$defs\n  D\nt\n  x any", 2), ("{bad", 1), ('{"a":1} x', 1), ("$defs\n  D\n    x any\n\n$defs\n  E\n    x any", 1), ("t\n  a é", 2),
    ],
)
def test_errors_have_places(text, line):
    with pytest.raises(NotationError) as e:
        parse(text)
    assert e.value.line == line


def test_reading_rules():
    doc = parse('t # "quoted"\r\n\r\n  ')
    assert doc.tools[0].description == "quoted" and doc.tools[0].fields == [] and doc.defs is None
    f = parse('t\n  a integer%5[1,):int64[2,] =null # x\n  "b.c"* string:length[,3]:format =word\n  d array<string|null>[2,3]:unique =[1, "]"]\n  e true|false\n  f string:unique2').tools[0].fields
    assert f[0].type.marks == {"multipleOf": 5, "minimum": 2, "format": "int64"} and f[0].default is None and f[0].description == "x"
    assert f[1].required and f[1].default == "word" and f[1].type.marks == {"maxLength": 3, "format": "format"}
    assert f[2].default == [1, "]"] and f[2].type.item.kind == "union" and f[3].type.kind == "enum" and f[4].default is ABSENT
    assert [t.kind for t in tokenize("t\n  a* string =1 # d")] == ["word", "newline", "indent", "word", "star", "word", "equals", "number", "hash", "description", "newline", "dedent", "end"]
    assert parse_tokens(tokenize("t\n  a string")) == parse("t\n  a string")
    assert parse("$defs\n\nt").defs == []


def test_closure_and_inlinings():
    doc = parse("$defs\n  A\n    x $B\n  B\n    y $A\n  C\n    z string\n\nt\n  a array<$A>\n\nu\n  b $C|null\n  c $Gone\n\n" + '{"name": "raw"}')
    defs = {d.name: d for d in doc.defs}
    assert closure(doc.tools[0].fields, defs) == {"A", "B"} and closure(doc.tools[1].fields, defs) == {"C", "Gone"}
    assert inlinings(doc) == 3
    got = to_schema(doc)
    assert [list(x.get("$defs", {})) for x in got] == [["A", "B"], ["C"], []]


def test_node_rows():
    rows = nodes.rows(read(GOOD).tree)
    assert len({r["node_path"] for r in rows}) == len(rows) and all(set(r) == set(nodes.COLUMNS) for r in rows)
    n = next(r for r in rows if r["field_name"] == "n" and r["kind"] == "integer")
    assert (n["min_val"], n["max_val"], n["excl_min"], n["excl_max"], n["multiple_of"]) == (1.0, 10.0, False, True, "3")
    assert {r["kind"] for r in rows} >= {"defs", "definition", "tool", "field", "union", "enum", "const", "ref", "object", "array"}


def test_hash_ignores_order():
    assert content_hash({"b": 1, "a": [1.0, "é"]}) == content_hash({"a": [1.0, "é"], "b": 1}) != content_hash({"b": 1, "a": [1, "é"]})
    assert canonical({"b": "é", "a": 1.0}) == '{"a":1.0,"b":"\\u00e9"}'


def test_instances():
    ok = instances.conforms
    s = tool({"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string"}, "uniqueItems": True}}, ["a"])
    assert ok({"a": 1.0, "b": ["x"]}, s) and not ok({"a": True}, s) and not ok({"a": 1, "c": 2}, s) and not ok({"a": 1, "b": ["x", "x"]}, s) and not ok({}, s)
    assert ok(3, {"oneOf": [{"type": "integer"}, {"type": "string"}]}) and not ok(3, {"oneOf": [{}, {"type": "integer"}]}) and not ok(1, {"not": {}})
    loop = {"$defs": {"L": {"anyOf": [{"type": "null"}, {"type": "array", "items": {"$ref": "#/$defs/L"}}]}}, "$ref": "#/$defs/L"}
    assert ok([[None], []], loop) and not ok([1], loop)
    assert instances.compare({"type": "string"}, {"type": "string", "maxLength": 5})["disagree"]
    assert instances.compare({"const": 1}, {"enum": [1]})["thin"]
    with pytest.raises(ValueError):
        instances.align([{"name": "a"}], [])
    assert [b["name"] for _, b in instances.align([{"name": "a"}, {"name": "b"}], [{"name": "b"}, {"name": "a"}])] == ["a", "b"]


@pytest.mark.parametrize("bad", [{"type": "float"}, {"minLength": -1}, {"required": "a"}, {"properties": {"a": {"type": 1}}}, {"anyOf": []}, {"pattern": "("}, {"multipleOf": 0}, {"items": 3}, {"enum": "a"}])
def test_malformed(bad):
    assert instances.malformed(bad) and instances.malformed({"not": bad}) and not instances.malformed({"title": "fine", "items": True})


LEAF = st.one_of(
    st.just({}), st.just({"type": "boolean"}), st.just({"type": "null"}),
    st.builds(lambda a, b: {"type": "integer", "minimum": min(a, b), "maximum": max(a, b)}, st.integers(-5, 5), st.integers(-5, 5)),
    st.builds(lambda a, p: {"type": "string", "minLength": a} | ({"pattern": p} if p else {}), st.integers(0, 3), st.sampled_from(["", "^a", '"\\\\', "a|b#"])),
    st.builds(lambda v: {"enum": v}, st.lists(st.text(st.sampled_from("ab #\"\\|1"), max_size=4), min_size=1, max_size=3, unique=True)),
    st.builds(lambda v: {"const": v}, st.one_of(st.text(st.sampled_from('ab"\\'), max_size=3), st.integers(), st.booleans(), st.floats(allow_nan=False, allow_infinity=False))),
)
TREE = st.recursive(LEAF, lambda inner: st.one_of(st.builds(lambda x: {"type": "array", "items": x}, inner), st.builds(lambda xs: {"anyOf": xs}, st.lists(LEAF.filter(lambda s: "enum" not in s and "const" not in s), min_size=1, max_size=3))), max_leaves=5)
NAMES = st.text(st.sampled_from("abz_-9. é\""), min_size=1, max_size=5)
TOOL = st.builds(lambda props, text: tool(props, list(props)[:1]) | ({"description": text} if text else {}), st.dictionaries(NAMES, TREE, max_size=4), st.sampled_from(["", "plain", "with # sign"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(TOOL, min_size=1, max_size=3))
def test_any_tools_round_trip(tools):
    for i, t in enumerate(tools):
        t["name"] = f"t{i}"
    c = convert(tools)
    got = back(c.text)
    assert to_text(parse(c.text)) == c.text
    for a, b in instances.align(tools, got):
        assert instances.compare(a, b, most=10)["same"]
    assert convert(got).text == c.text or c.fallbacks


def test_sampling_is_repeatable():
    assert [instances.sample(GOOD, GOOD, random.Random(5)) for _ in range(3)] == [instances.sample(GOOD, GOOD, random.Random(5)) for _ in range(3)]
