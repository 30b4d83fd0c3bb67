"""Every registered query beside its SQL on the smallest tables, and the operators' edges."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import TABLES, rows_of
from schemaloom.operators import breakeven, catalog, closure, distributions, extract, ingest, plan, prompts, requests, scoring, validate
from schemaloom.plans import oracles, queries
from schemaloom.sources import files
from schemaloom.streaming import resume

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_its_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in oracles.oracles():
        cur = db.execute(oracles.oracles()[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cur.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())


def test_broken_schemas_are_rows_not_failures(spark):
    df = spark.createDataFrame([("{", "c", 1), ("3", "c", 2), ('{"type":"string"}', "c", 3), ("[]", "c", 4)], "schema string, category string, ord int")
    got = catalog.bucketed(df.select(F.col("ord").alias("tool_hash"), "schema")).select("tool_hash", "bucket", "conversion.error").orderBy("tool_hash").collect()
    assert [g.bucket for g in got] == ["invalid_input", "invalid_input", "fell_back", "invalid_input"] and "tool definitions" in got[2].error


def test_finalised_leaves_mixed_documents(spark):
    texts = spark.createDataFrame([(1, 't\n  a integer[5,1]\n\nu\n  b string'), (2, 't\n  a integer[5,1]\n\n{"name":"r"}'), (3, "$defs\n  D\n    x integer[5,1]\n\nt\n  a $D")], "doc int, text string")
    nodes = catalog.text_table(texts, "doc", "text")
    got = {(x.doc_id, x.tool_ord): (x.raw, x.reason) for x in validate.finalised(nodes, validate.findings(nodes)).collect()}
    assert got == {(1, 0): (True, "crossed_bounds"), (1, 1): (False, None), (2, 0): (False, None), (2, 1): (True, None), (3, 0): (True, "crossed_bounds")}


def test_misplaced_objects_by_plan(spark):
    s = '{"name":"t","type":"object","additionalProperties":false,"properties":{"a":{"type":"array","items":{"type":"object","properties":{"x":{}},"additionalProperties":false}}}}'
    nodes = catalog.node_table(spark.createDataFrame([("h", s)], "tool_hash string, schema string"))
    assert validate.misplaced_objects(nodes).count() == 0


def test_long_chains_and_cycles_close(spark):
    edges = spark.range(30).select(F.lit(1).alias("doc_id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.concat(F.lit("n"), (F.col("id") + 1) % 30).alias("target"))
    seeds = spark.createDataFrame([(1, 0, "n7"), (1, 1, "gone"), (2, 0, "n1")], "doc_id int, owner int, name string")
    got = closure.reference_closure(seeds, edges).groupBy("doc_id", "owner").count().collect()
    assert sorted(tuple(x) for x in got) == [(1, 0, 30), (1, 1, 1), (2, 0, 1)]


def test_uniformity_and_sections(spark):
    texts = spark.createDataFrame([(1, "t\n  a* string\n  o* object\n    b* any"), (2, "t\n  a* array<object>\n    b string"), (3, "ping"), (4, '{"name":"r"}'), (5, "t\n  n integer(0,]\n  m number[1,2)")], "doc int, text string")
    m = prompts.manifest(catalog.text_table(texts, "doc", "text"), ["doc_id"])
    got = {x.doc_id: x for x in m.withColumn("text", prompts.primer()).withColumn("prompt", prompts.system_prompt(F.lit("TOOLS"))).withColumn("end", prompts.contract_section(F.col("prompt"))).collect()}
    assert [got[i].required_uniformity for i in (1, 2, 3, 4, 5)] == ["all_required", "all_required", "all_optional", "all_optional", "all_optional"]
    assert got[4].all_fallback and got[4].text == "" and got[4].prompt is None
    assert got[3].has_parameterless_tool and prompts.PARAMETERLESS in got[3].text
    assert prompts.BOUNDS_BOTH in got[5].text and prompts.OPEN_BOUND in got[5].text
    assert got[1].end.strip() == (prompts.CONTRACT + prompts.CONTRACT_BY["all_required"] + prompts.CONTRACT_END)
    full = spark.range(1).select(*[c.alias(k) for k, c in prompts.full_manifest().items()]).select(prompts.primer().alias("t")).first().t
    assert full.count("\n\n") == 16 and full.count(prompts.OPEN_BOUND) == 2


@pytest.mark.parametrize(
    ("said", "outcome"),
    [
        (None, "no_fenced_block"), ("", "no_fenced_block"), ("{}", "no_fenced_block"), ("```json\n{\n```", "invalid_json"), ("```\n[1]\n```", "invalid_shape"), ("```\n\n```", "invalid_json"),
        ('```JSON {"name": "f", "arguments": {}} ```', "valid"), ('``` {"name": "f", "arguments": []} ```', "invalid_shape"), ('``` {"name": 1, "arguments": {}} ```', "invalid_shape"), ('``` {"name": null, "arguments": {}} ```', "invalid_shape"),
        ('``` {"name": "f", "arguments": {"a": {"b": [1]}}} ``` and ``` no ```', "invalid_json"),
    ],
)
def test_calls_in_text(spark, said, outcome):
    assert spark.createDataFrame([(said,)], "t string").select(extract.parse_call(F.col("t")).alias("p")).first().p.outcome == outcome


def test_provider_shapes(spark):
    rows = [
        ("openai", "a", '{"output":[{"type":"message","content":[{"type":"output_text","text":"x"},{"type":"output_text","text":"y"}]}]}'),
        ("anthropic", "a", '{"content":[{"type":"text","text":"x"},{"type":"tool_use","name":"n"},{"type":"text","text":"y"}]}'),
        ("qwen", "a", '{"choices":[{"message":{"content":null}},{"message":{"content":"x\\ny"}}]}'),
        ("openai", "a", "{}"),
    ]
    df = spark.createDataFrame(rows, "provider string, condition string, response string")
    assert [x.t for x in df.select(extract.prompt_text(F.col("provider"), F.col("response")).alias("t")).collect()] == ["x\ny", "x\ny", "x\ny", ""]
    none = df.select(extract.native_calls(F.col("provider"), F.col("response")).alias("c")).collect()
    assert [x.c and x.c[0].name for x in none] == [None, "n", None, None]


def test_answers(spark):
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.from_json(F.lit("{}"), "map<string,string>")
    ok = F.create_map(F.lit("x"), F.array(F.lit("1"), F.lit("2")), F.lit("y"), F.array(F.lit(""), F.lit("3")))
    judge = lambda name, d: spark.range(1).select(scoring.semantically_correct(F.lit(name), m(d), F.lit("f"), ok).alias("r")).first().r
    assert judge("f", {"x": "1"}) and judge("f", {"x": "2", "y": "3"})
    assert not judge("g", {"x": "1"}) and not judge("f", {}) and not judge("f", {"x": "1", "z": "0"}) and not judge("f", {"x": "3"})


def test_missing_answers_are_errors(spark):
    a = spark.createDataFrame([(1, "p"), (2, "q")], "id int, v string")
    b = spark.createDataFrame([(1, "r")], "id int, w string")
    for bad in (lambda: plan.join_answers(a, b), lambda: plan.join_answers(a.union(a), b), lambda: plan.select_ids(b, a.select("id")), lambda: plan.union_categories({"a": a, "b": a.limit(1)}, {"a": 2, "b": 2})):
        with pytest.raises(ValueError):
            bad()


def test_places_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("ord"))
    assert plan.places(df, "ord").where("place <> ord").count() == 0 and plan.places(df.limit(0), "ord").count() == 0


def test_parsers_of_results(spark):
    a = spark.createDataFrame([('{"custom_id":"1","result":{"type":"succeeded","message":{"a":1}}}', 0), ('{"custom_id":"2","result":{"type":"expired"}}', 0), ('{"custom_id":"3"}', 0), ("  ", 0), ('{"custom_id":"2","result":{"type":"succeeded","message":{}}}', 1)], "line string, file_ord int")
    got = {x.custom_id: (x.status, x.error) for x in ingest.latest(ingest.parse_anthropic(a)).collect()}
    assert got == {"1": ("completed", None), "2": ("completed", None), "3": ("api_error", "unknown_batch_result")}
    q = spark.createDataFrame([('{"custom_id":"1","status":"completed","http_status":200,"response_body":{},"extraction_error":"odd"}', 0), ('{"custom_id":"2","status":"failed"}', 0)], "line string, file_ord int")
    assert {x.custom_id: (x.status, x.error) for x in ingest.parse_checkpoint(q).collect()} == {"1": ("completed", "odd"), "2": ("api_error", "qwen_sync_error")}


def test_crossings(spark):
    rows = [("at", 1, 10.0, 10.0, 0.0), ("at", 2, 10.0, 9.0, 10.0), ("under", 1, 10.0, 9.0, 10.0), ("under", 2, 10.0, 8.0, 20.0), ("never", 1, 10.0, 12.0, -20.0), ("never", 2, 10.0, 11.0, -10.0), ("mid", 1, 10.0, 12.0, -20.0), ("mid", 3, 10.0, 8.0, 20.0)]
    c = spark.createDataFrame(rows, "arm string, n int, mean_json double, mean_compact double, saving double")
    assert {x.arm: x.break_even for x in breakeven.break_even(c, ["arm"]).collect()} == {"at": 1.0, "under": 1.0, "never": None, "mid": 2.0}
    got = {(x.arm, x.threshold): x.n for x in breakeven.threshold_crossing(c, ["arm"], [10.0, 15.0]).collect()}
    assert got == {("at", 10.0): 2.0, ("at", 15.0): None, ("under", 10.0): 1.0, ("under", 15.0): 1.5, ("never", 10.0): None, ("never", 15.0): None, ("mid", 10.0): 2.5, ("mid", 15.0): 2.75}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id int, v string")
    assert files.write_once(df, str(tmp_path / "once")) and not files.write_once(df.limit(0), str(tmp_path / "once"))
    assert spark.read.json(str(tmp_path / "once")).count() == 2
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    (tmp_path / "bad.jsonl").write_text('{"id":1}\n\n{"id":\n')
    with pytest.raises(Exception, match="not JSON"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id int").collect()
    bad = spark.createDataFrame([('{"custom_id":"a b"}',), ("x",), ('{"custom_id":"c"}',), ('{"custom_id":"c"}',)], "line string")
    got = files.check_artifact(bad, max_lines=3).first()
    assert (got.n, got.not_json, got.repeated_ids, got.bad_ids, got.ok) == (4, 1, 1, 2, False)


def test_runs_resume(spark, tmp_path):
    src, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    go = lambda: resume.run_available(spark, src, "custom_id string", lambda d: d.withColumn("status", F.lit("completed")), sink, state)
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("c"), "id").alias("custom_id"))
    rows(0, 30).write.parquet(src)
    go()
    go()
    done = lambda: spark.read.parquet(sink)
    assert done().count() == 30
    rows(20, 50).write.mode("append").parquet(src)
    assert resume.pending(rows(0, 60).union(rows(0, 5)), done()).count() == 30
    go()
    assert done().count() == done().distinct().count() == 50
    p = resume.progress(done(), 60).first()
    assert (p.done, p.total, p.failed, p.left) == (50, 60, 0, 10)


def test_request_bodies_of_all_kinds(spark):
    import json

    tools = F.array(F.struct(F.lit("n").alias("name"), F.lit("d").alias("description"), F.struct(F.lit("object").alias("type")).alias("parameters")))
    rows = [(p, c, None if c == "c" else "TOOLS", s) for p in requests.BODIES for c in "abc" for s in (None, 'sys "x"')] + [("openai", "a", None, None)]
    df = spark.createDataFrame(rows, "provider string, condition string, tool_prompt string, system_text string").select("*", F.lit("m").alias("model"), F.lit("hi").alias("user_text"), tools.alias("tools"))
    for x in requests.request_bodies(df).collect():
        if x.tool_prompt is None and x.condition != "c":
            assert x.body is None
            continue
        b = json.loads(x.body)
        assert ("tools" in b) == (x.condition == "c") and "hi" in x.body
        want = x.system_text if x.condition == "c" else f"{x.system_text}\n\nTOOLS" if x.system_text else "TOOLS"
        system = b.get("instructions") or b.get("system") or next((m["content"] for m in b.get("messages", b.get("input", [])) if not isinstance(m, str) and m["role"] in ("system", "developer")), None)
        assert system == want


def test_native_names_lose_their_dots_where_asked(spark):
    import json

    tools = F.array(F.struct(F.lit("do.it").alias("name"), F.lit(None).cast("string").alias("description"), F.struct(F.lit("object").alias("type")).alias("parameters")))
    df = spark.createDataFrame([(p, r) for p in requests.BODIES for r in (True, False, None)], "provider string, renames boolean").select("*", F.lit("c").alias("condition"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("tool_prompt"), F.lit(None).cast("string").alias("system_text"), F.lit("hi").alias("user_text"), tools.alias("tools"))
    for x in requests.request_bodies(df).collect():
        tool = json.loads(x.body)["tools"][0]
        assert tool.get("function", tool)["name"] == ("do_it" if x.renames else "do.it")


def test_the_reason_is_the_first_rule_checked(spark):
    nodes = catalog.text_table(spark.createDataFrame([(1, "t\n  a* integer =1\n  b integer[5,1]\n  b string\n  c $Nope")], "doc int, text string"), "doc", "text")
    found = validate.findings(nodes)
    assert {x.rule for x in found.collect()} == {"required_default", "crossed_bounds", "duplicate_field", "dangling_reference"}
    assert [x.reason for x in validate.finalised(nodes, found).collect()] == ["required_default"]


def test_dedupe_counts_texts_before_reading_them(spark):
    rows = [('{"name": "a", "type": "dict"}', "x", 3), ('{"type":"dict","name":"a"}', "y", 1), ('{"type":"dict","name":"a"}', "x", 2), ('{"type":"object","name":"a"}', "z", 9)]
    got = catalog.dedupe(spark.createDataFrame(rows, "schema string, category string, ord int")).collect()
    assert [(x.occurrences, x.categories, x.renamed) for x in got] == [(4, ["x", "y", "z"], 3)]


def test_prompts_have_plain_fences_and_raw_documents_none(spark):
    texts = spark.createDataFrame([(1, "t\n  a* string"), (2, '{"name":"r"}')], "doc int, text string")
    nodes = catalog.text_table(texts, "doc", "text")
    got = {x.doc: x for x in prompts.prompt_rows(texts, nodes, "doc").collect()}
    assert "\n---\n\n```\nt\n  a* string\n```\n\n---\n" in got[1].prompt and got[1].prompt.startswith(got[1].primer)
    assert got[2].primer == "" and got[2].prompt is None and got[2].all_fallback
    full = {x.doc: x for x in prompts.prompt_rows(texts, nodes, "doc", full_grammar=True).collect()}
    assert prompts.REFERENCE in full[1].primer and prompts.FALLBACK in full[1].primer and full[2].prompt is None
    assert prompts.prompt_rows(texts.limit(0), nodes.limit(0), "doc").count() == 0


def test_combined_features_are_those_of_all_tools(spark):
    texts = spark.createDataFrame([(1, "t\n  a* string"), (2, "ping"), (3, "u\n  n integer[1,]"), (4, "t\n  b* string\n\nv\n  c* any")], "doc int, text string")
    nodes = catalog.text_table(texts, "doc", "text").withColumn("g", F.when(F.col("doc_id") == 3, "y").otherwise("x"))
    one = prompts.features(nodes, ["g", "doc_id"]).groupBy("g").agg(*prompts.combined())
    key = lambda df: sorted(map(str, df.collect()))
    assert key(prompts.with_uniformity(one)) == key(prompts.manifest(nodes, ["g"]))


def test_questions_that_cannot_be_asked(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (2, 0, "system", "s"), (3, 0, "user", None), (3, 1, "user", "x"), (4, 0, None, "x"), (5, 0, "user", "")], "conv_id int, turn int, role string, text string")
    got = {x.conv_id: (x.problem, x["at"]) for x in prompts.question_problems(m).collect()}
    assert got == {2: ("no user message", None), 3: ("missing role or content", 0), 4: ("missing role or content", 0)}
    with pytest.raises(ValueError, match="no user message: conv_id 2"):
        prompts.checked_questions(m)
    assert prompts.checked_questions(m.where("conv_id in (1, 5)")).count() == 2 and prompts.checked_questions(m.limit(0)).count() == 0
    assert sorted(x.conv_id for x in prompts.with_system_ids(m).collect()) == [1, 2]


def test_caches_take_new_counts(spark):
    old = spark.createDataFrame([("a", 9, 9), ("b", 2, 1)], "tool_hash string, json long, compact long")
    new = spark.createDataFrame([("a", 5, 4), ("a", 5, 3), ("c", 7, 6), ("d", None, 1)], "tool_hash string, json long, compact long")
    got = sorted(tuple(x) for x in catalog.merge_cache(old, new).collect())
    assert got == [("a", 5, 4), ("b", 2, 1), ("c", 7, 6)]
    assert sorted(tuple(x) for x in catalog.merge_cache(old, new.limit(0)).collect()) == [("a", 9, 9), ("b", 2, 1)]


def test_an_index_is_complete(spark):
    rows = spark.createDataFrame([("a", "converted"), ("b", "fell_back")], "tool_hash string, bucket string")
    ask = lambda *h: catalog.indexed(rows, spark.createDataFrame([(x,) for x in h], "tool_hash string"))
    assert [x.tool_hash for x in ask("a", "a").collect()] == ["a"]
    with pytest.raises(ValueError, match="no converted tool for b"):
        ask("a", "b")


def test_bins_of_equal_count(spark):
    rows = [("x", i, 10 + i // 3, 5) for i in range(23)] + [("y", i, 7, 7) for i in range(4)] + [("z", 0, 0, 1)]
    p = spark.createDataFrame(rows, "tokenizer string, key int, j long, c long")
    got = {}
    for x in distributions.equal_count_bins(p, 5).collect():
        got[x.tokenizer, x.bin] = x.n
    want = {}
    for t, n in (("x", 23), ("y", 4)):
        for i in range(n):
            b = -(-(i + 1) * 5 // n) - 1
            want[t, b] = want.get((t, b), 0) + 1
    assert got == want and distributions.equal_count_bins(p.limit(0)).count() == 0


def test_tools_of_entries_are_normalised(spark):
    e = spark.createDataFrame([(1, '{"name":"a","type":"dict"}'), (2, '{"name":"a","type":"dict"}'), (3, None)], "entry_id int, schema string")
    got = {x.entry_id: x.schema for x in requests.entry_tools(e).collect()}
    assert got[1] == got[2] == '{"name":"a","type":"object"}' and got[3] is None


def test_native_names(spark):
    got = spark.createDataFrame([("a.b.c", True), ("a.b", False)], "n string, r boolean").select(prompts.native_name(F.col("n"), F.col("r")).alias("n")).collect()
    assert [x.n for x in got] == ["a_b_c", "a.b"]


def test_offline_counter(spark):
    got = spark.createDataFrame([("ab 12, é!",), ("",), (None,)], "t string").select(distributions.offline_tokens(F.col("t")).alias("n")).collect()
    assert [x.n for x in got][:2] == [6, 0]


def test_bpe_counter(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    from schemaloom.functions.tokens import bpe_counter

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "Hello  world!", "é\n日本 123", "<|endoftext|>"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", bpe_counter(path, P.PATTERN)(F.col("t")).alias("n")).orderBy("i").collect()
    assert [x.n for x in got] == [None if t is None else len(enc.encode_ordinary(t)) for t in texts]
