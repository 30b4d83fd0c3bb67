"""Registered queries over the whole tables, by operator group."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.tokens import bpe_counter
from ..operators import breakeven, catalog, closure, distributions, equivalence, extract, inference, ingest, plan, prompts, requests, scoring, validate
from ..operators.storage import cut, shared_folder
from ..sources import files
from ..streaming import resume
from . import derived as D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared place."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def tools(spark, sf_dir) -> DataFrame:
    return catalog.dedupe(D.occurrences(spark, sf_dir))


def rows(spark, sf_dir) -> DataFrame:
    return catalog.attach_tokens(catalog.bucketed(tools(spark, sf_dir)), {"offline": distributions.offline_tokens})


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles to a number of places: sums differ in their last bits with the order of rows."""
    return df.select(*[(F.round(F.col(c), places) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def a_dedupe(spark, sf_dir):
    return tools(spark, sf_dir).select("tool_hash", "occurrences", F.array_join("categories", ",").alias("categories"), "renamed")


def a_records(spark, sf_dir):
    out = catalog.records(rows(spark, sf_dir), ["offline"])
    return out.select("tool_hash", F.array_join("source_categories", ",").alias("source_categories"), "raw_occurrence_count", "bucket", F.col("fallback_reason").isNotNull().alias("has_reason"), F.col("invalid_reason").isNotNull().alias("is_invalid"), "tokens_json_offline", "tokens_compact_offline", "delta_offline")


def a_summary(spark, sf_dir):
    return rounded(catalog.summary(rows(spark, sf_dir), ["offline"]))


def a_fallback_causes(spark, sf_dir):
    got = catalog.bucketed(tools(spark, sf_dir)).select(F.regexp_replace("fallback_reason", r"\d+", "N").alias("reason"))
    return distributions.cause_histogram(got)


def a_invalid(spark, sf_dir):
    got = catalog.invalid_counts(catalog.bucketed(tools(spark, sf_dir)))
    return got.agg(F.count("reason").alias("reasons"), F.sum("definitions").alias("definitions"), F.sum("occurrences").alias("occurrences"))


def t_merged_cache(spark, sf_dir):
    """A cache that knows some tools, partly with stale counts, brought up to date from what is pending."""
    got = rows(spark, sf_dir).where("bucket = 'converted'").select("tool_hash", F.col("tokens_json_offline").alias("json"), F.col("tokens_compact_offline").alias("compact"))
    old = got.where("json % 3 = 0").select("tool_hash", (F.col("json") + 1000).alias("json"), "compact")
    return catalog.merge_cache(old, got.where("json % 2 = 0"))


def t_index(spark, sf_dir):
    """The tools that a pool of hashes names, with their text."""
    got = rows(spark, sf_dir)
    pool = got.where("bucket = 'converted' and tokens_json_offline > tokens_compact_offline").select("tool_hash")
    return catalog.indexed(got, pool.union(pool)).select("tool_hash", "text")


def t_pending_tokens(spark, sf_dir):
    got = rows(spark, sf_dir)
    cache = got.where("bucket = 'converted' and tokens_json_offline % 2 = 0").select("tool_hash", F.col("tokens_json_offline").alias("json"), F.col("tokens_compact_offline").alias("compact"))
    with_cache = catalog.attach_tokens(catalog.bucketed(tools(spark, sf_dir)), {"cached": cache})
    return catalog.pending(got, cache).join(with_cache, "tool_hash").select("tool_hash", F.col("tokens_json_cached").isNull().alias("missing"))


def t_bpe_savings(spark, sf_dir):
    """Savings under a public vocabulary and the offline counter, per counter and pooled."""
    import public_tokenizers

    bpe = bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = catalog.attach_tokens(catalog.bucketed(tools(spark, sf_dir)), {"offline": distributions.offline_tokens, "bpe": bpe}).where("bucket = 'converted'")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(f"tokens_json_{n}").alias("j"), F.col(f"tokens_compact_{n}").alias("c")) for n in ("offline", "bpe")]))
    return rounded(distributions.saving_summary(got.select(F.col("tool_hash").alias("key"), each.alias("p")).select("key", "p.*")), 6)


def n_options(spark, sf_dir):
    """Closing and renaming, counted over occurrences."""
    texts = D.occurrences(spark, sf_dir).groupBy("schema").agg(F.count("*").alias("n"))
    c = texts.select("n", K.convert_schema(F.col("schema"), True, True).alias("c"))
    total = lambda x, name: F.sum(F.col("n") * x).alias(name)
    renamed = [total(F.col(f"c.renamed_{t}"), f"{t}s") for t in ("float", "dict", "tuple", "any")]
    return c.agg(*renamed, total(F.size("c.closed"), "closed"), total(F.size("c.touched"), "touched"))


def w_text(spark, sf_dir):
    return catalog.bucketed(tools(spark, sf_dir)).where("text is not null").select("tool_hash", "text")


def p_nodes(spark, sf_dir):
    nodes = catalog.text_table(w_text(spark, sf_dir), "tool_hash", "text")
    return nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce("required", F.lit(False))).alias("required"), F.max("depth").alias("depth"))


def l_tokens(spark, sf_dir):
    got = w_text(spark, sf_dir).select(F.explode(K.text_tokens(F.col("text"))).alias("t"))
    return got.where("t.kind in ('word', 'newline', 'star', 'description')").groupBy(F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"))


def j_schema(spark, sf_dir):
    return w_text(spark, sf_dir).select("tool_hash", K.text_to_schema(F.col("text")).alias("schema"))


def documents_of_suppliers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS doc", f"{D.DOC} AS text")


def supplier_nodes(spark, sf_dir) -> DataFrame:
    return catalog.text_table(documents_of_suppliers(spark, sf_dir), "doc", "text").cache()


def v_findings(spark, sf_dir):
    return validate.findings(supplier_nodes(spark, sf_dir)).groupBy("level", "rule", "section").agg(F.count("*").alias("n"))


def v_kernel_findings(spark, sf_dir):
    f = documents_of_suppliers(spark, sf_dir).select(F.explode(K.text_findings(F.col("text"))).alias("f"))
    return f.groupBy("f.level", "f.section").agg(F.count("*").alias("n"))


def f_finalised(spark, sf_dir):
    nodes = catalog.node_table(tools(spark, sf_dir)).cache()
    return validate.finalised(nodes, validate.findings(nodes)).groupBy("raw", "reason").agg(F.count("*").alias("n"))


def j_closure(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    seeds = n.selectExpr("1 AS doc_id", "n_nationkey AS owner", "'R' || CAST(n_regionkey AS STRING) AS name")
    edges = table(spark, sf_dir, "region").selectExpr("1 AS doc_id", "'R' || CAST(r_regionkey AS STRING) AS name", "'R' || CAST((r_regionkey + 1) % 4 AS STRING) AS target")
    return closure.reference_closure(seeds, edges).select("owner", "name")


def j_inlinings(spark, sf_dir):
    return closure.inlining_count(supplier_nodes(spark, sf_dir)).select(F.col("doc_id").alias("doc"), "inlinings")


def r_definitions(spark, sf_dir):
    """Suppliers of a nation as tools of one document, their definitions differing by supplier."""
    t = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS doc_id", "s_suppkey AS tool_ord", "'D' || CAST(s_suppkey % 3 AS STRING) AS def_name", "'body ' || CAST(s_suppkey % 7 AS STRING) AS def_json")
    return catalog.conflicting_tools(t).select("doc_id", "tool_ord", F.array_join("names", ",").alias("names"))


def brand_manifest(spark, sf_dir) -> DataFrame:
    occ = D.occurrences(spark, sf_dir).withColumn("tool_hash", F.sha2(K.map_aliases(F.col("schema")), 256)).select("tool_hash", F.col("category").alias("brand")).distinct()
    good = catalog.bucketed(tools(spark, sf_dir)).where("bucket <> 'invalid_input'").select("tool_hash", F.col("conversion.text").alias("text"))
    return prompts.manifest(catalog.text_table(good, "tool_hash", "text").withColumnRenamed("doc_id", "tool_hash").join(occ, "tool_hash").withColumn("doc_id", F.col("tool_hash")), ["brand"])


def m_manifest(spark, sf_dir):
    return brand_manifest(spark, sf_dir)


def m_overhead(spark, sf_dir):
    text = prompts.overhead(F.col("required_uniformity"))
    return brand_manifest(spark, sf_dir).select("brand", F.length(text).alias("chars"), F.sha2(text.cast("binary"), 256).alias("sha"))


def m_prompts(spark, sf_dir):
    """The whole prompt of each tool by itself: calibrated, and of the whole grammar."""
    good = catalog.bucketed(tools(spark, sf_dir)).where("bucket <> 'invalid_input'").select("tool_hash", F.col("conversion.text").alias("text"))
    nodes = catalog.text_table(good, "tool_hash", "text")
    one = lambda full: prompts.prompt_rows(good, nodes, "tool_hash", full).select("tool_hash", F.lit(full).alias("full_grammar"), F.length("primer").alias("primer_chars"), F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha"))
    return one(False).unionByName(one(True))


def q_problems(spark, sf_dir):
    """Questions that can't be asked, and whether a question has a system message."""
    m = table(spark, sf_dir, "conversations")
    ids = m.select("conv_id").distinct()
    has = prompts.with_system_ids(m).withColumn("has_system", F.lit(True))
    return ids.join(prompts.question_problems(m), "conv_id", "left").join(has, "conv_id", "left").select("conv_id", "problem", "at", F.coalesce("has_system", F.lit(False)).alias("has_system"))


def q_json_prompts(spark, sf_dir):
    occ = D.occurrences(spark, sf_dir).select(F.col("category").alias("brand"), K.map_aliases(F.col("schema")).alias("schema"))
    text = prompts.json_prompt(F.col("tools"), F.col("required_uniformity"))
    return prompts.json_arm(occ, ["brand"]).select("brand", F.length(text).alias("chars"), F.sha2(text.cast("binary"), 256).alias("sha"))


def q_questions(spark, sf_dir):
    return prompts.question_parts(table(spark, sf_dir, "conversations")).select("conv_id", "system_text", "user_text", "has_system")


def _requests(spark, sf_dir) -> DataFrame:
    q = prompts.question_parts(table(spark, sf_dir, "conversations")).select("conv_id", "system_text", "user_text")
    arms = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(c).alias("condition")) for p in requests.BODIES for c in "abc"]))
    tool = F.array(F.struct(F.lit("do.it").alias("name"), F.lit(None).cast("string").alias("description"), F.struct(F.lit("object").alias("type")).alias("parameters")))
    r = q.withColumn("x", arms).select(F.col("conv_id").alias("entry_id"), "x.provider", "x.condition", F.lit("m").alias("model"), F.when(F.col("x.condition") == "a", "tools A").when(F.col("x.condition") == "b", "tools B").alias("tool_prompt"), "system_text", "user_text", tool.alias("tools"), F.lit(True).alias("renames"))
    return requests.request_bodies(r).withColumn("custom_id", F.concat(F.lit("r"), F.col("entry_id"), F.lit("-"), F.col("provider"), F.lit("-"), F.col("condition")))


def q_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select("custom_id", "body")


def q_entry_tools(spark, sf_dir):
    """Tools as requests carry them, all occurrences."""
    occ = D.occurrences(spark, sf_dir).withColumnRenamed("ord", "entry_id")
    return requests.entry_tools(occ).select("entry_id", "schema")


def s_batches(spark, sf_dir):
    """Batch files written, read again and checked."""
    path = files.write_batches(requests.batch_lines(_requests(spark, sf_dir)), scratch(spark, "batches"))
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return files.check_artifact(lines).select("n", "not_json", "repeated_ids", "bad_ids", "ok")


def s_catalog_files(spark, sf_dir):
    """A catalog written as JSON lines, read with its functions unnested.

    Entries are dealt out before they are gathered, so that a task holds the tools of a few entries only, and each task
    writes its own file.
    """
    occ = D.occurrences(spark, sf_dir).select((F.col("ord") % 100).alias("g"), "ord", "schema").repartition(100, "g")
    entries = occ.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "schema"))), lambda x: x["schema"]), ",").alias("f"))
    base = scratch(spark, "catalog")
    entries.select(F.concat(F.lit('{"id":"e'), F.col("g"), F.lit('","function":['), F.col("f"), F.lit("]}")).alias("value")).write.text(f"{base}/tools_v4_simple.json")
    got = files.read_catalog(spark, f"{base}/tools_v4_simple.json")
    return got.groupBy("entry").agg(F.count("schema").alias("n"), F.max("ord").alias("last"))


def s_csv(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    path = files.write_csv(df, scratch(spark, "csv"))
    return files.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


def s_summary_json(spark, sf_dir):
    return files.summary_json(catalog.summary(rows(spark, sf_dir), []).select("converted", "fell_back", "invalid", "occurrences"))


def c_join_answers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return plan.join_answers(plan.select_ids(docs, labels.select("id")), labels).groupBy("lang", "quality").agg(F.count("*").alias("n"))


def c_categories(spark, sf_dir):
    """Events by type, a part per type: the types are few, and each part is a filter that reaches the scan."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    kinds = [r[0] for r in ev.select("event_type").distinct().orderBy("event_type").collect()]
    return plan.union_categories({k: ev.where(F.col("event_type") == k).select("event_id") for k in kinds}).groupBy("category").agg(F.count("*").alias("n"))


def c_sample(spark, sf_dir):
    return plan.stable_sample(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 100, 20260604)


def _cells(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("entry_id"), F.col("c_mktsegment").alias("category"))
    skip = e.where("entry_id % 97 = 0").select("entry_id", F.lit("a").alias("condition"), F.lit("all_fallback").alias("skip_reason"))
    return plan.cell_plan(e, ["a", "b", "c"], ["m1", "m2", "m3"], skip)


def c_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


def c_slices(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    side = plan.sidecar(cells).groupBy("model").agg(F.count_distinct("key").cast("int").alias("cells"))
    return side.join(plan.provider_slice(cells, "m1").groupBy("model").agg(F.count("*").alias("sent")), "model", "left")


def _result_lines(spark, sf_dir) -> DataFrame:
    cid = "'c' || lpad(CAST(event_id % 9000 + 1 AS STRING), 7, '0')"
    line = f"""'{{"custom_id":"' || {cid} || '","error":' || (CASE WHEN event_id % 17 = 0 THEN '"boom"' ELSE 'null' END) || ',"response":{{"status_code":' || (CASE WHEN event_id % 5 = 0 THEN '500' ELSE '200' END) || ',"body":{{"output_text":"' || event_type || '"}}}}}}'"""
    return table(spark, sf_dir, "events").selectExpr(f"{line} AS line", "event_id AS file_ord")


def c_latest(spark, sf_dir):
    return ingest.latest(ingest.parse_openai(_result_lines(spark, sf_dir))).select("custom_id", "status", F.get_json_object("raw", "$.output_text").alias("said"), "error")


def _store(spark, sf_dir) -> DataFrame:
    got = ingest.latest(ingest.parse_openai(_result_lines(spark, sf_dir)))
    return ingest.raw_store(_cells(spark, sf_dir), got, "run", F.when(F.col("model") == "m1", "openai").when(F.col("model") == "m2", "anthropic").otherwise("qwen"))


def c_raw_store(spark, sf_dir):
    return _store(spark, sf_dir).select("custom_id", "provider", "status", "skip_reason", "error")


def c_status_rollup(spark, sf_dir):
    store = _store(spark, sf_dir)
    ids = ingest.error_ids(store).groupBy("provider").agg(F.count("custom_id").cast("int").alias("n_error_ids"))
    return ingest.status_rollup(store).join(ids, "provider", "left").select("provider", "completed", "skipped", "api_error", F.coalesce("n_error_ids", F.lit(0)).alias("n_error_ids"), "first_error")


def i_resume(spark, sf_dir):
    """A worklist in two parts with repeats, processed by two runs over one checkpoint."""
    base = scratch(spark, "resume")
    work = table(spark, sf_dir, "events").select(F.concat(F.lit("w"), F.col("event_id") % 4000).alias("custom_id"), (F.col("event_id") % 4).alias("part"))
    for part in (0, 1):
        work.where(F.col("part") % 2 == part).select("custom_id").write.mode("append").parquet(f"{base}/in")
        resume.run_available(spark, f"{base}/in", "custom_id string", lambda df: df.withColumn("status", F.when(F.col("custom_id").endswith("7"), "api_error").otherwise("completed")), f"{base}/out", f"{base}/state")
    return spark.read.schema("custom_id string, status string").parquet(f"{base}/out")


def x_extract(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{D.RESPONSE} AS said")
    return r.select("conv_id", "turn", extract.parse_call(F.col("said")).alias("p")).select("conv_id", "turn", "p.outcome", "p.name")


def x_expected(spark, sf_dir):
    want = F.create_map(F.lit("x"), F.array(F.lit(""), F.col("c_mktsegment")), F.lit("y"), F.array(F.lit("")))
    e = table(spark, sf_dir, "customer").select("c_custkey", extract.expected_call(F.lit("do.it"), want, F.col("c_custkey") % 2 == 0).alias("e"))
    return e.select("c_custkey", "e.name", F.map_keys("e.arguments").cast("string").alias("keys"), F.try_element_at("e.arguments", F.lit("x")).alias("x"))


def _records(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "conversations").selectExpr("'k' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS custom_id", "conv_id AS entry_id", "role AS category", f"{D.CONDITION} AS condition", f"{D.PROVIDER} AS provider", f"{D.STATUS} AS status", f"{D.RESPONSE} AS said", f"{D.CALL} AS call", "turn")
    esc = F.to_json(F.struct(F.col("said").alias("t")))
    text = F.expr("substring(to_json(struct(said as t)), 6, length(to_json(struct(said as t))) - 6)")
    args = F.get_json_object("call", "$.arguments")
    quoted = F.expr("substring(to_json(struct(get_json_object(call, '$.arguments') as t)), 6, length(to_json(struct(get_json_object(call, '$.arguments') as t))) - 6)")
    prompt = F.when(F.col("provider") == "openai", F.concat(F.lit('{"output_text":'), text, F.lit("}"))).when(F.col("provider") == "anthropic", F.concat(F.lit('{"content":[{"type":"text","text":'), text, F.lit("}]}"))).otherwise(F.concat(F.lit('{"choices":[{"message":{"content":'), text, F.lit("}}]}")))
    native = F.when(F.col("provider") == "openai", F.concat(F.lit('{"output":[{"type":"function_call","name":"do_it","arguments":'), quoted, F.lit("}]}"))).when(F.col("provider") == "anthropic", F.concat(F.lit('{"content":[{"type":"tool_use","name":"do_it","input":'), args, F.lit("}]}"))).otherwise(F.concat(F.lit('{"choices":[{"message":{"tool_calls":[{"function":{"name":"do_it","arguments":'), quoted, F.lit("}}]}}]}")))
    raw = F.when(F.col("status") == "completed", F.when(F.col("turn") % 9 == 8, None).when(F.col("condition") == "c", native).otherwise(prompt))
    return r.withColumn("raw_response", raw).withColumns({"model": F.col("provider"), "skip_reason": F.lit("no_tools"), "error": F.lit("timeout"), "__unused": esc}).drop("__unused")


def _scored(spark, sf_dir) -> DataFrame:
    acceptable = F.create_map(F.lit("x"), F.array(F.lit("0"), F.lit("1")), F.lit("y"), F.array(F.lit("2"), F.lit("")))
    answers = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("entry_id")).distinct().select("entry_id", F.lit("do.it").alias("want"), acceptable.alias("acceptable"), F.lit(True).alias("renames"))
    return scoring.score_records(_records(spark, sf_dir), answers)


def g_scored(spark, sf_dir):
    return _scored(spark, sf_dir).select("custom_id", "status", "syntactic_valid", "semantic_correct", "parse_outcome", "skip_reason", "api_error")


def g_summary(spark, sf_dir):
    return scoring.summarise(_scored(spark, sf_dir))


def h_paired(spark, sf_dir):
    cells = inference.usable(D.scored_cells(spark, sf_dir))
    want = [*inference.COMPARISONS, ("a", "b", "joint")]
    return rounded(inference.paired_statistics(inference.paired_tables(cells, want)))


def h_descriptive(spark, sf_dir):
    return rounded(inference.descriptive(inference.usable(D.scored_cells(spark, sf_dir), [0, 7])))


def h_reconcile(spark, sf_dir):
    t = inference.paired_tables(inference.usable(D.scored_cells(spark, sf_dir)))
    return inference.reconcile(t, t.withColumn("first_only", F.col("first_only") + F.when(F.col("model") == "en", 1).otherwise(0)))


def _pairs(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    j, c = distributions.offline_tokens(F.col("text")), F.length(F.regexp_replace("text", "[aeiou]", "")).cast("long")
    two = F.array(F.struct(F.lit("words").alias("tokenizer"), j.alias("j"), F.size(F.split("text", " ")).cast("long").alias("c")), F.struct(F.lit("chars").alias("tokenizer"), F.col("n_chars").alias("j"), c.alias("c")))
    return docs.select(F.col("doc_id").alias("key"), F.explode(two).alias("p")).select("key", "p.*")


def d_savings(spark, sf_dir):
    return rounded(distributions.saving_summary(_pairs(spark, sf_dir)), 6)


def d_correlation(spark, sf_dir):
    return rounded(distributions.size_correlation(_pairs(spark, sf_dir)), 6)


def d_bins(spark, sf_dir):
    return rounded(distributions.equal_count_bins(_pairs(spark, sf_dir)), 6)


def d_wins(spark, sf_dir):
    return distributions.win_split(_pairs(spark, sf_dir))


def d_regressions(spark, sf_dir):
    return distributions.regressions(_pairs(spark, sf_dir)).select("tokenizer", "key", "delta")


def d_gap(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return rounded(distributions.baseline_gap(p, p.withColumn("j", F.col("j") + 20)), 6)


def d_categories(spark, sf_dir):
    r = rows(spark, sf_dir).select("categories", F.array(F.when(F.col("tokens_json_offline") > 0, -F.col("delta_offline") * 100.0 / F.col("tokens_json_offline")), F.lit(None).cast("double")).alias("savings"))
    return rounded(distributions.category_savings(r), 6)


TRIALS = 1000


def _pool(spark, sf_dir) -> DataFrame:
    """Converted tools, numbered in order of their hashes, with both token counts and their features."""
    got = rows(spark, sf_dir).where("bucket = 'converted'").select("tool_hash", F.col("tokens_json_offline").alias("j"), F.col("tokens_compact_offline").alias("c"), "text")
    placed = plan.places(got, "tool_hash", "idx")
    return placed.drop("text").join(prompts.features(catalog.text_table(placed, "tool_hash", "text"), ["doc_id"]).withColumnRenamed("doc_id", "tool_hash"), "tool_hash")


def _curves(spark, sf_dir, *full: bool) -> DataFrame:
    """Curves of the arms calibrated and, where full is true, full, over one pool."""
    pool = cut(_pool(spark, sf_dir))
    made = cut(breakeven.sampled(breakeven.trials(spark, pool.count(), TRIALS), pool))
    out = None
    for f in full:
        one = breakeven.curve(breakeven.costs(made, distributions.offline_tokens, f)).withColumn("arm", F.lit("full" if f else "calibrated"))
        out = one if out is None else out.unionByName(one)
    return out


def b_curve(spark, sf_dir):
    return rounded(_curves(spark, sf_dir, False).drop("arm"))


def b_break_even(spark, sf_dir):
    return rounded(breakeven.break_even(_curves(spark, sf_dir, False, True), ["arm"]))


def b_thresholds(spark, sf_dir):
    return rounded(breakeven.threshold_crossing(_curves(spark, sf_dir, False), ["arm"], [10.0, 20.0, 25.0, 99.0]))


def b_ratio(spark, sf_dir):
    both = cut(_curves(spark, sf_dir, False, True))
    arm = lambda name: both.where(F.col("arm") == name).withColumn("arm", F.lit("x"))
    return rounded(breakeven.overhead_ratio(arm("calibrated"), arm("full"), ["arm"]).select("n", "ratio"))


def o_round_trips(spark, sf_dir):
    good = catalog.bucketed(tools(spark, sf_dir)).where("bucket <> 'invalid_input'").select("tool_hash", "schema")
    return equivalence.round_trip_report(equivalence.round_trips(good)).select("n", "same", "any_differs")


def o_votes(spark, sf_dir):
    good = tools(spark, sf_dir)
    return equivalence.votes(good).groupBy("probe_id").agg(F.count_if("ok").alias("accepting"), F.count("ok").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        a_summary, a_dedupe, a_records, a_fallback_causes, a_invalid, t_merged_cache, t_index, t_pending_tokens, t_bpe_savings, n_options, w_text, p_nodes, l_tokens, j_schema, v_findings, v_kernel_findings, f_finalised,
        j_closure, j_inlinings, r_definitions, m_manifest, m_overhead, m_prompts, q_json_prompts, q_questions, q_problems, q_requests, q_entry_tools, s_batches, s_catalog_files, s_csv, s_summary_json,
        c_join_answers, c_categories, c_sample, c_cells, c_slices, c_latest, c_raw_store, c_status_rollup, i_resume, x_extract, x_expected, g_scored, g_summary,
        h_paired, h_descriptive, h_reconcile, d_savings, d_correlation, d_bins, d_wins, d_regressions, d_gap, d_categories, b_curve, b_break_even, b_thresholds, b_ratio,
        o_round_trips, o_votes,
    )
    return {f.__name__: f for f in made}
