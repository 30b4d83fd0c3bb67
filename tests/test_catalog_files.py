"""Catalog files: a line is parsed once however many tools it holds, and entries are gathered and written by many tasks."""

import json

from pyspark.sql import functions as F

from schemaloom.plans import derived, queries
from schemaloom.sources import files

SF = "/root/testdata/sf0.001"


def test_lines_are_parsed_before_tools_become_rows(spark, tmp_path):
    path = tmp_path / "tools_v4_simple.json"
    lines = ['{"id":"a","function":[{"z":1,"b":[{"c":null}]},{}]}', '{"function":[{"y":"é,]"}],"id":"b"}', '{"id":"c","function":[]}', '{"id":"d"}', "", '{"id":"e","function":3}', "no JSON", '{"id":"a","function":[{"x":2}]}']
    path.write_text("\n".join(lines))
    got = files.read_catalog(spark, str(path))
    assert got.columns == ["category", "entry", "ord", "schema"]
    want = [("a", 0, '{"z":1,"b":[{"c":null}]}'), ("a", 1, "{}"), ("b", 0, '{"y":"é,]"}'), ("c", None, None), ("d", None, None), ("e", None, None), (None, None, None), ("a", 0, '{"x":2}')]
    assert sorted((tuple(r) for r in got.select("entry", "ord", "schema").collect()), key=repr) == sorted(want, key=repr)
    assert {r.category for r in got.collect()} == {"simple"}
    for df in (got, got.groupBy("entry").agg(F.count("schema"), F.max("ord"))):
        after, generate, before = df._jdf.queryExecution().optimizedPlan().toString().partition("Generate ")
        assert generate and before.count("get_json_object(") == 2
        assert "get_json_object(" not in after and "line#" not in after + before.split("\n")[0]


def test_entries_are_written_whole_and_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch", lambda _, label: f"{tmp_path}/{label}")
    queries.s_catalog_files(spark, SF).collect()
    parts = [p.read_text().splitlines() for p in (tmp_path / "catalog" / "tools_v4_simple.json").glob("part-*")]
    assert sum(bool(p) for p in parts) > 20 and max(map(len, parts)) < 10
    got = {e["id"]: e["function"] for p in parts for e in map(json.loads, p)}
    want = {}
    for r in sorted(derived.occurrences(spark, SF).collect(), key=lambda r: r.ord):
        want.setdefault(f"e{r.ord % 100}", []).append(json.loads(r.schema))
    assert got == want and sum(map(len, parts)) == len(want)
