"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..operators import prompts as P
from ..operators.breakeven import SIZES
from ..operators.distributions import TOKEN_PATTERN
from . import derived as D

Z = "1.959963984540054"

_TOOLS = f"""
occ AS (SELECT p_partkey, p_brand, p_size, {D.K} AS k, {D.SCHEMA} AS raw, {D.MAPPED} AS schema, {D.BUCKET} AS bucket, {D.TEXT} AS text, {D.BACK} AS back FROM part),
tools AS (SELECT sha256(schema) AS tool_hash, count(*) AS occurrences, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS categories, count(*) FILTER (WHERE raw <> schema) AS renamed,
  any_value(k) AS k, any_value(p_size) AS p_size, any_value(schema) AS schema, any_value(bucket) AS bucket, any_value(text) AS text, any_value(back) AS back FROM occ GROUP BY schema),
counted AS (SELECT *, CASE WHEN bucket = 'converted' THEN len(regexp_extract_all(schema, '{TOKEN_PATTERN}'))::BIGINT END AS tj,
  CASE WHEN bucket = 'converted' THEN len(regexp_extract_all(text, '{TOKEN_PATTERN}'))::BIGINT END AS tc FROM tools)
"""


def _with(body: str) -> str:
    return f"WITH {_TOOLS} {body}"


#: Per class of tool: required and optional fields that count for uniformity, other fields, nodes.
def _flags(source: str, key: str) -> str:
    """Manifests f of a source(key, ks), ks being the classes of its tools."""
    return f"""f AS (SELECT {key}, ks,
  list_contains(ks, 0) AS bounds_inclusive, false AS bounds_exclusive, false AS bounds_open, false AS has_multiple_of,
  list_contains(ks, 11) AS has_string_length, list_contains(ks, 11) AS string_length_open, false AS has_regex, false AS has_encoding_media,
  list_contains(ks, 8) AS has_typed_array, list_contains(ks, 8) AS has_array_bounds, list_contains(ks, 8) AS has_unique, list_contains(ks, 5) AS has_type_union,
  list_contains(ks, 9) AS enum_multi, list_contains(ks, 9) AS enum_single, false AS has_defs_reference, list_contains(ks, 7) AS has_parameterless_tool,
  list_contains(ks, 8) AS has_default_value, list_has_any(ks, [2, 3, 4]) AS has_fallback,
  CASE WHEN NOT list_has_any(ks, [0, 5, 9, 11]) THEN 'all_optional' ELSE 'mixed' END AS required_uniformity,
  len(list_filter(ks, lambda x: x NOT IN (2, 3, 4))) = 0 AS all_fallback FROM {source})"""


_BRAND = _with(f""", b AS (SELECT p_brand AS brand, list(DISTINCT k) AS ks FROM occ WHERE bucket <> 'invalid_input' GROUP BY p_brand),
{_flags('b', 'brand')}
""")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PRIMER = f"""CASE WHEN all_fallback THEN '' ELSE concat_ws(chr(10) || chr(10),
 {_q(P.INTRO)} || CASE required_uniformity WHEN 'mixed' THEN chr(10) || '- ' || {_q(P.RULES['mixed'])} ELSE '' END,
 CASE WHEN has_default_value THEN {_q(P.DEFAULT_VALUE)} END, CASE WHEN bounds_inclusive THEN {_q(P.BOUNDS)} END,
 CASE WHEN has_string_length THEN {_q(P.LENGTH + ' ' + P.OPEN_BOUND)} END, CASE WHEN has_typed_array THEN {_q(P.TYPED_ARRAY)} END,
 CASE WHEN has_array_bounds THEN {_q(P.ARRAY_BOUNDS)} END, CASE WHEN has_unique THEN {_q(P.UNIQUE)} END, CASE WHEN has_type_union THEN {_q(P.TYPE_UNION)} END,
 CASE WHEN enum_multi THEN {_q(P.ENUM_MULTI)} END, CASE WHEN enum_single THEN {_q(P.ENUM_SINGLE)} END,
 CASE WHEN has_parameterless_tool THEN {_q(P.PARAMETERLESS)} END, CASE WHEN has_fallback THEN {_q(P.FALLBACK)} END) END"""
_CONTRACT = f"""({_q(P.CONTRACT)} || CASE required_uniformity WHEN 'mixed' THEN {_q(P.CONTRACT_BY['mixed'])} ELSE {_q(P.CONTRACT_BY['all_optional'])} END || {_q(P.CONTRACT_END)})"""

_SUPPLIER = "SELECT s_suppkey % 10 AS k, count(*) AS n FROM supplier GROUP BY 1"
_CELLS = """cells AS (SELECT 'c' || lpad(((row_number() OVER (ORDER BY c_custkey) - 1) * 9 + i)::VARCHAR, 7, '0') AS custom_id, c_custkey AS entry_id, c_mktsegment AS category, condition, model,
  c_custkey % 97 = 0 AND condition = 'a' AS skipped, CASE WHEN c_custkey % 97 = 0 AND condition = 'a' THEN 'all_fallback' END AS skip_reason
  FROM (SELECT *, dense_rank() OVER (ORDER BY c_custkey) AS r FROM customer) c CROSS JOIN (VALUES (1,'a','m1'),(2,'a','m2'),(3,'a','m3'),(4,'b','m1'),(5,'b','m2'),(6,'b','m3'),(7,'c','m1'),(8,'c','m2'),(9,'c','m3')) a(i, condition, model))""".replace("((row_number() OVER (ORDER BY c_custkey) - 1) * 9 + i)", "((r - 1) * 9 + i)")
_RESULTS = """got AS (SELECT 'c' || lpad((event_id % 9000 + 1)::VARCHAR, 7, '0') AS custom_id, event_id, event_type FROM events),
last AS (SELECT custom_id, arg_max(event_id, event_id) AS e, arg_max(event_type, event_id) AS t FROM got GROUP BY custom_id),
results AS (SELECT custom_id, CASE WHEN e % 17 = 0 OR e % 5 = 0 THEN 'api_error' ELSE 'completed' END AS status, CASE WHEN e % 17 <> 0 AND e % 5 <> 0 THEN t END AS said,
  CASE WHEN e % 17 = 0 THEN 'boom' WHEN e % 5 = 0 THEN '{"output_text":"' || t || '"}' END AS error FROM last)"""
_STORE = f"""WITH {_CELLS}, {_RESULTS}, store AS (SELECT c.custom_id, CASE model WHEN 'm1' THEN 'openai' WHEN 'm2' THEN 'anthropic' ELSE 'qwen' END AS provider,
  CASE WHEN skipped THEN 'skipped' WHEN r.status IS NULL THEN 'api_error' ELSE r.status END AS status, skip_reason,
  CASE WHEN NOT skipped THEN CASE WHEN r.status IS NULL THEN 'missing_from_provider_results' ELSE r.error END END AS error FROM cells c LEFT JOIN results r ON c.custom_id = r.custom_id)"""

_PAIRED = f"""
WITH cells AS ({D.CELLS}), ok AS (SELECT * FROM cells WHERE status = 'completed'),
cmp AS (SELECT * FROM (VALUES ('a','b','semantic'),('a','c','semantic'),('b','c','semantic'),('a','b','syntactic'){{extra}}) v(first, second, metric)),
pairs AS (SELECT x.model, first, second, metric,
  CASE metric WHEN 'semantic' THEN x.semantic WHEN 'syntactic' THEN x.syntactic ELSE x.syntactic AND x.semantic END AS p,
  CASE metric WHEN 'semantic' THEN y.semantic WHEN 'syntactic' THEN y.syntactic ELSE y.syntactic AND y.semantic END AS q
  FROM cmp JOIN ok x ON x.condition = first JOIN ok y ON y.condition = second AND y.model = x.model AND y.entry_id = x.entry_id
  WHERE metric <> 'semantic' OR (x.syntactic AND y.syntactic)),
t AS (SELECT model, first, second, metric, count(*) AS n, count(*) FILTER (WHERE p AND q) AS "both", count(*) FILTER (WHERE p AND NOT q) AS first_only,
  count(*) FILTER (WHERE NOT p AND q) AS second_only, count(*) FILTER (WHERE NOT p AND NOT q) AS neither FROM pairs GROUP BY ALL)
"""
_H_PAIRED = _PAIRED.format(extra=",('a','b','joint')") + f""",
s AS (SELECT *, (first_only - second_only)::DOUBLE / n AS diff, sqrt(first_only + second_only - pow(first_only - second_only, 2) / n) / n AS se, first_only + second_only AS d,
  pow(abs(first_only - second_only) - 1, 2) / nullif(first_only + second_only, 0) AS chi, least(first_only, second_only) AS m FROM t),
e AS (SELECT *, sqrt(chi / 2) AS x FROM s),
low AS (SELECT model, first, second, metric, 1 - 2 / sqrt(pi()) * exp(-x * x) * (x + list_sum(list_transform(range(1, 61), lambda k: x * list_product(list_transform(range(1, k + 1), lambda i: 2 * x * x / (2 * i + 1)))))) AS v FROM e WHERE d >= 25 AND x < 2),
high AS (SELECT model, first, second, metric, exp(-x * x) / sqrt(pi()) / (x + list_reduce(list_concat([0.0::DOUBLE], list_transform(range(80, 0, -1), lambda k: k::DOUBLE)), lambda a, k: k / 2 / (x + a))) AS v FROM e WHERE d >= 25 AND x >= 2),
exact AS (SELECT model, first, second, metric, least(1.0, 2 * list_sum(list_transform(range(0, m + 1), lambda i: list_product(list_concat([1.0::DOUBLE], list_transform(range(0, i), lambda j: (d - j)::DOUBLE / (j + 1)))))) * pow(0.5, d)) AS v FROM e WHERE d < 25)
SELECT model, first, second, metric, n, "both", first_only, second_only, neither, round(diff, 9) AS diff, round(diff - {Z} * se, 9) AS ci_low, round(diff + {Z} * se, 9) AS ci_high,
  d < 25 AS exact, round(CASE WHEN d < 25 THEN m::DOUBLE ELSE chi END, 9) AS statistic, round(CASE WHEN d = 0 THEN 1.0 ELSE p.v END, 9) AS p_value,
  CASE WHEN first = 'a' AND second = 'b' AND metric <> 'syntactic' THEN CASE WHEN diff - {Z} * se > -0.03 THEN 'pass' WHEN diff + {Z} * se <= -0.03 THEN 'fail' ELSE 'inconclusive' END END AS verdict
FROM e JOIN (SELECT * FROM low UNION ALL SELECT * FROM high UNION ALL SELECT * FROM exact) p USING (model, first, second, metric)
"""


def _wilson(k: str, n: str, sign: str) -> str:
    return f"CASE WHEN {n} > 0 THEN round((({k}::DOUBLE / {n} + {Z} * {Z} / (2 * {n})) {sign} {Z} * sqrt(({k}::DOUBLE / {n}) * (1 - {k}::DOUBLE / {n}) / {n} + {Z} * {Z} / (4 * {n}::DOUBLE * {n}))) / (1 + {Z} * {Z} / {n}), 9) END"


_PAIRS = f"""p AS (SELECT doc_id AS key, 'words' AS tokenizer, len(regexp_extract_all(text, '{TOKEN_PATTERN}'))::BIGINT AS j, len(string_split(text, ' '))::BIGINT AS c FROM documents
  UNION ALL SELECT doc_id, 'chars', n_chars, length(regexp_replace(text, '[aeiou]', '', 'g'))::BIGINT FROM documents),
r AS (SELECT *, c - j AS delta, (j - c) * 100.0::DOUBLE / j AS saving FROM p WHERE j > 0)"""
_STATS = "count(*) AS n, round(avg(saving), 6) AS mean, round(min(saving), 6) AS least, round(max(saving), 6) AS most, " + ", ".join(f"round(quantile_cont(saving, {q}), 6) AS {n}" for q, n in ((0.05, "p5"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"))) + ", count(*) FILTER (WHERE c > j) AS worse, round((sum(j) - sum(c)) * 100.0::DOUBLE / sum(j), 6) AS ratio_of_sums"

_SIZES = ", ".join(f"({n})" for n in SIZES)
#: The text of the whole grammar: every clause, in order.
_FULL = "\n\n".join((
    P.INTRO + "\n- " + P.RULES["mixed"], P.DEFAULT_VALUE, f"{P.BOUNDS} {P.BOUNDS_BOTH} {P.OPEN_BOUND}", P.MULTIPLE_OF, f"{P.LENGTH} {P.OPEN_BOUND}", P.REGEX, P.ENCODING, P.TYPED_ARRAY, P.ARRAY_BOUNDS,
    P.UNIQUE, P.TYPE_UNION, P.ENUM_MULTI, P.ENUM_SINGLE, P.REFERENCE, P.PARAMETERLESS, P.FALLBACK,
))
_FULL_END = P.CONTRACT + P.CONTRACT_BY["mixed"] + P.CONTRACT_END
_CURVE = f"""{_TOOLS}, pool AS (SELECT row_number() OVER (ORDER BY tool_hash) - 1 AS idx, tj AS j, tc AS c, k FROM counted WHERE bucket = 'converted'),
drawn AS (SELECT n, trial, ('0x' || substr(md5('42|' || n || '|' || trial || '|' || slot), 1, 8))::BIGINT % (SELECT count(*) FROM pool) AS idx
  FROM (VALUES {_SIZES}) s(n), range(1000) t(trial), LATERAL (SELECT unnest(range(1, n + 1)) AS slot)),
per AS (SELECT n, trial, sum(j) AS j, sum(pool.c) AS c, list(DISTINCT k) AS ks FROM drawn JOIN pool USING (idx) GROUP BY n, trial),
{_flags('per', 'n, trial, j, c')},
o AS (SELECT n, trial, j, c, len(regexp_extract_all(concat_ws(chr(10) || chr(10), {_PRIMER}, '---', '```' || chr(10) || chr(10) || '```', '---', {_CONTRACT}), '{TOKEN_PATTERN}')) AS o FROM f),
cost AS (SELECT *, 'calibrated' AS arm FROM o UNION ALL SELECT n, trial, j, c, len(regexp_extract_all({_q(_FULL + chr(10) * 2 + '---' + chr(10) * 2 + '```' + chr(10) * 2 + '```' + chr(10) * 2 + '---' + chr(10) * 2 + _FULL_END)}, '{TOKEN_PATTERN}')), 'full' FROM o),
curve AS (SELECT arm, n, avg(j) AS mean_json, avg(c + o) AS mean_compact, avg(CASE WHEN c + o < j THEN 1.0 ELSE 0.0 END) AS win_rate, avg(o) AS mean_overhead FROM cost GROUP BY arm, n),
saved AS (SELECT *, (mean_json - mean_compact) / mean_json * 100 AS saving FROM curve)"""

_ANSWER = f"""m AS (SELECT *, 'k' || conv_id || '-' || turn AS custom_id, {D.SHAPE} AS shape, {D.CONDITION} AS condition, {D.PROVIDER} AS provider, {D.STATUS} AS status, turn % 3 AS x FROM conversations),
s AS (SELECT *, status = 'completed' AND turn % 9 <> 8 AND (condition = 'c' OR shape IN (1, 4)) AS valid FROM m),
g AS (SELECT *, CASE WHEN status = 'completed' THEN CASE WHEN turn % 9 = 8 THEN 'missing_raw_response' WHEN condition = 'c' THEN 'valid'
    ELSE CASE shape WHEN 0 THEN 'no_fenced_block' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'invalid_shape' ELSE 'valid' END END END AS parse_outcome,
  CASE WHEN valid THEN x IN (0, 1) END AS semantic_correct FROM s)"""


def oracles() -> dict[str, str]:
    out = {}
    out["a_dedupe"] = _with("SELECT tool_hash, occurrences, categories, renamed FROM tools")
    out["a_records"] = _with("SELECT tool_hash, categories AS source_categories, occurrences AS raw_occurrence_count, bucket, bucket = 'fell_back' AS has_reason, bucket = 'invalid_input' AS is_invalid, tj AS tokens_json_offline, tc AS tokens_compact_offline, tc - tj AS delta_offline FROM counted")
    out["a_summary"] = _with("""SELECT count(*) FILTER (WHERE bucket = 'converted') AS converted, count(*) FILTER (WHERE bucket = 'fell_back') AS fell_back, count(*) FILTER (WHERE bucket = 'invalid_input') AS invalid,
      sum(occurrences)::BIGINT AS occurrences, sum(renamed)::BIGINT AS renamed, round(avg(tc - tj), 9) AS mean_delta_offline, round(median(tc - tj), 9) AS median_delta_offline, round(avg((tj - tc) * 100.0::DOUBLE / tj), 9) AS mean_saving_offline,
      round(count(*) FILTER (WHERE bucket = 'converted')::DOUBLE / count(*) FILTER (WHERE bucket <> 'invalid_input'), 9) AS coverage FROM counted""")
    out["a_fallback_causes"] = _with("""SELECT CASE k WHEN 2 THEN 'unencodable keyword(s) [''oneOf'']' WHEN 3 THEN 'semantic validation failed: numeric bound lower bound N exceeds upper bound N [§N.N]' ELSE 'mixed-type enum: members span more than one JSON type' END AS reason, count(*) AS n FROM tools WHERE bucket = 'fell_back' GROUP BY 1""")
    out["t_pending_tokens"] = _with("SELECT tool_hash, true AS missing FROM counted WHERE bucket = 'converted' AND tj % 2 = 1")
    out["a_invalid"] = _with("SELECT 1::BIGINT AS reasons, count(*) AS definitions, sum(occurrences)::BIGINT AS occurrences FROM tools WHERE bucket = 'invalid_input'")
    out["t_merged_cache"] = _with("SELECT tool_hash, CASE WHEN tj % 2 = 0 THEN tj ELSE tj + 1000 END AS json, tc AS compact FROM counted WHERE bucket = 'converted' AND (tj % 2 = 0 OR tj % 3 = 0)")
    out["t_index"] = _with("SELECT tool_hash, text FROM counted WHERE bucket = 'converted' AND tj > tc")
    out["n_options"] = f"SELECT count(*) FILTER (WHERE {D.K} = 6) AS floats, 0::BIGINT AS dicts, 0::BIGINT AS tuples, 0::BIGINT AS anys, count(*) FILTER (WHERE {D.K} = 1) AS closed, count(*) FILTER (WHERE {D.K} = 6) AS touched FROM part"
    out["w_text"] = _with("SELECT tool_hash, text FROM tools WHERE bucket = 'converted'")
    out["p_nodes"] = _with(""", v(k, kind, n, req, depth) AS (VALUES (0,'tool',1,0,0),(0,'field',2,1,1),(0,'integer',1,0,2),(0,'string',1,0,2),(1,'tool',1,0,0),(1,'field',1,0,1),(1,'string',1,0,2),
      (5,'tool',1,0,0),(5,'field',2,1,1),(5,'union',1,0,2),(5,'string',2,0,3),(5,'null',1,0,3),(6,'tool',1,0,0),(6,'field',1,0,1),(6,'number',1,0,2),(7,'tool',1,0,0),
      (8,'tool',1,0,0),(8,'field',1,0,1),(8,'array',1,0,2),(8,'string',1,0,3),(9,'tool',1,0,0),(9,'field',2,1,1),(9,'const',1,0,2),(9,'enum',1,0,2),
      (11,'tool',1,0,0),(11,'field',3,2,3),(11,'object',1,0,2),(11,'string',2,0,4))
      SELECT kind, sum(n)::BIGINT AS n, sum(req)::BIGINT AS required, max(depth) AS depth FROM tools JOIN v USING (k) GROUP BY kind""")
    out["l_tokens"] = _with(""", v(k, kind, n) AS (VALUES (0,'newline',3),(0,'word',5),(0,'star',1),(0,'description',1),(1,'newline',2),(1,'word',3),(1,'description',1),(5,'newline',3),(5,'word',6),(5,'star',1),(5,'description',2),
      (6,'newline',2),(6,'word',3),(6,'description',1),(7,'newline',1),(7,'word',1),(7,'description',1),(8,'newline',2),(8,'word',5),(8,'description',1),(9,'newline',3),(9,'word',5),(9,'star',1),(9,'description',1),
      (11,'newline',4),(11,'word',8),(11,'star',2),(11,'description',1)) SELECT kind, sum(n)::BIGINT AS n FROM tools JOIN v USING (k) GROUP BY kind""")
    out["j_schema"] = _with("SELECT tool_hash, back AS schema FROM tools WHERE bucket = 'converted'")
    out["v_findings"] = f"""WITH s AS ({_SUPPLIER}), v(k, level, rule, section, m) AS (VALUES (1,'error','required_default','§4.1',1),(2,'error','dangling_reference','§5.7',1),(3,'error','no_tool','§3.1',1),(3,'warning','unused_definition','§3.2',1),
      (4,'error','definition_name','§3.2',1),(4,'warning','unused_definition','§3.2',1),(5,'error','mixed_union','§5.6',1),(6,'error','mixed_enum','§5.6',1),(7,'error','crossed_bounds','§6.2',1),(7,'error','crossed_bounds','§6.3',1),(7,'error','crossed_bounds','§6.4',1),
      (8,'error','duplicate_field','§4.2',2),(9,'warning','unused_definition','§3.2',1),(9,'warning','duplicate_tool','§3.5',1)) SELECT level, rule, section, sum(n * m)::BIGINT AS n FROM s JOIN v USING (k) GROUP BY ALL"""
    out["v_kernel_findings"] = out["v_findings"].replace("SELECT level, rule, section, sum", "SELECT level, section, sum")
    out["f_finalised"] = _with("SELECT k IN (2, 3, 4, 10) AND k <> 10 AS raw, CASE WHEN k = 3 THEN 'crossed_bounds' END AS reason, count(*) AS n FROM tools GROUP BY ALL")
    out["j_closure"] = """WITH RECURSIVE e AS (SELECT 'R' || r_regionkey AS name, 'R' || ((r_regionkey + 1) % 4) AS target FROM region),
      c(owner, name) AS (SELECT n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT c.owner, e.target FROM c JOIN e ON c.name = e.name) SELECT owner, name FROM c"""
    out["j_inlinings"] = "SELECT s_suppkey AS doc, 2::BIGINT AS inlinings FROM supplier WHERE s_suppkey % 10 = 9"
    out["r_definitions"] = """WITH t AS (SELECT s_nationkey AS doc_id, s_suppkey AS tool_ord, 'D' || (s_suppkey % 3) AS d, s_suppkey % 7 AS b FROM supplier),
      bad AS (SELECT doc_id, d FROM t GROUP BY ALL HAVING count(DISTINCT b) > 1) SELECT doc_id, tool_ord, d AS names FROM t JOIN bad USING (doc_id, d)"""
    flags = ", ".join((*P.FLAGS, "required_uniformity", "all_fallback"))
    out["m_manifest"] = _BRAND + f"SELECT brand, {flags} FROM f"
    out["m_overhead"] = _BRAND + f", t AS (SELECT brand, concat_ws(chr(10) || chr(10), {_PRIMER}, '---', '```' || chr(10) || chr(10) || '```', '---', {_CONTRACT}) AS text FROM f) SELECT brand, length(text) AS chars, sha256(text) AS sha FROM t"
    out["m_prompts"] = _with(f""", b AS (SELECT tool_hash, text, [k] AS ks FROM tools WHERE bucket <> 'invalid_input'), {_flags('b', 'tool_hash, text')},
      p AS (SELECT tool_hash, {_PRIMER} AS primer, CASE WHEN NOT all_fallback THEN concat_ws(chr(10) || chr(10), {_PRIMER}, '---', '```' || chr(10) || text || chr(10) || '```', '---', {_CONTRACT}) END AS prompt, false AS full_grammar FROM f
        UNION ALL SELECT tool_hash, CASE WHEN all_fallback THEN '' ELSE {_q(_FULL)} END, CASE WHEN NOT all_fallback THEN concat_ws(chr(10) || chr(10), {_q(_FULL)}, '---', '```' || chr(10) || text || chr(10) || '```', '---', {_q(_FULL_END)}) END, true FROM f)
      SELECT tool_hash, full_grammar, length(primer)::INT AS primer_chars, sha256(prompt) AS prompt_sha FROM p""")
    out["q_problems"] = """SELECT conv_id, CASE WHEN bool_or(role IS NULL OR text IS NULL) THEN 'missing role or content' WHEN count(*) FILTER (WHERE role = 'user') = 0 THEN 'no user message' END AS problem,
      min(turn) FILTER (WHERE role IS NULL OR text IS NULL) AS "at", coalesce(bool_or(role = 'system'), false) AS has_system FROM conversations GROUP BY conv_id"""
    out["q_json_prompts"] = f"""WITH {_TOOLS}, b AS (SELECT p_brand AS brand, string_agg(DISTINCT schema, ',' ORDER BY schema) AS tools, CASE WHEN bool_or(k IN (0, 5, 9, 11)) THEN 'mixed' ELSE 'all_optional' END AS required_uniformity FROM occ GROUP BY 1),
      t AS (SELECT brand, concat_ws(chr(10) || chr(10), {_q(P.JSON_INTRO)}, '---', '```json' || chr(10) || '[' || tools || ']' || chr(10) || '```', '---', {_CONTRACT}) AS text FROM b) SELECT brand, length(text) AS chars, sha256(text) AS sha FROM t"""
    out["q_questions"] = "SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS system_text, arg_max(text, turn) FILTER (WHERE role = 'user') AS user_text, count(*) FILTER (WHERE role = 'system') > 0 AS has_system FROM conversations GROUP BY conv_id"
    questions = f"q AS ({out['q_questions']})"
    msg = lambda role, text: f"""'{{"role":"' || {role} || '","content":' || to_json({text}) || '}}'"""
    user = msg("'user'", "user_text")
    sys_of = lambda role, text: f"CASE WHEN {text} IS NOT NULL THEN {msg(role, text)} || ',' ELSE '' END"
    out["q_requests"] = f"""WITH {questions}, a AS (SELECT *, CASE condition WHEN 'a' THEN 'tools A' WHEN 'b' THEN 'tools B' END AS tool_prompt FROM q, (VALUES ('openai'), ('anthropic'), ('qwen')) p(provider), (VALUES ('a'), ('b'), ('c')) c(condition)),
      b AS (SELECT *, CASE WHEN condition = 'c' THEN system_text ELSE coalesce(system_text || chr(10) || chr(10) || tool_prompt, tool_prompt) END AS s FROM a)
      SELECT 'r' || conv_id || '-' || provider || '-' || condition AS custom_id, CASE provider
      WHEN 'openai' THEN '{{"model":"m","reasoning":{{"effort":"none"}},"text":{{"verbosity":"medium"}},"temperature":0.0,"top_p":1.0,"max_output_tokens":512,"store":true,' || CASE WHEN condition = 'c'
        THEN '"input":[' || {sys_of("'developer'", 's')} || {user} || '],"tools":[{{"type":"function","name":"do_it","description":"","parameters":{{"type":"object"}},"strict":false}}],"tool_choice":"auto"}}'
        ELSE '"instructions":' || to_json(s) || ',"input":' || to_json(user_text) || '}}' END
      WHEN 'anthropic' THEN '{{"model":"m","max_tokens":512,"temperature":0.0,"thinking":{{"type":"disabled"}},"messages":[' || {user} || ']' || CASE WHEN s IS NOT NULL THEN ',"system":' || to_json(s) ELSE '' END
        || CASE WHEN condition = 'c' THEN ',"tools":[{{"name":"do_it","description":"","input_schema":{{"type":"object"}}}}],"tool_choice":{{"type":"auto"}}}}' ELSE '}}' END
      ELSE '{{"model":"m","messages":[' || {sys_of("'system'", 's')} || {user} || '],"temperature":0.0,"top_p":1.0,"max_tokens":512,"reasoning":{{"effort":"none"}}'
        || CASE WHEN condition = 'c' THEN ',"tools":[{{"type":"function","function":{{"name":"do_it","description":"","parameters":{{"type":"object"}}}}}}],"tool_choice":"auto"}}' ELSE '}}' END END AS body FROM b"""
    out["q_entry_tools"] = f"SELECT p_partkey AS entry_id, {D.MAPPED} AS schema FROM part"
    out["s_batches"] = "SELECT count(DISTINCT conv_id) * 9 AS n, 0::BIGINT AS not_json, 0::BIGINT AS repeated_ids, 0::BIGINT AS bad_ids, true AS ok FROM conversations"
    out["s_catalog_files"] = "SELECT 'e' || (p_partkey % 100) AS entry, count(*) AS n, (count(*) - 1)::INT AS last FROM part GROUP BY 1"
    out["s_csv"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
    out["s_summary_json"] = _with("""SELECT '{"converted":' || count(*) FILTER (WHERE bucket = 'converted') || ',"fell_back":' || count(*) FILTER (WHERE bucket = 'fell_back') || ',"invalid":' || count(*) FILTER (WHERE bucket = 'invalid_input') || ',"occurrences":' || sum(occurrences)::BIGINT || '}' AS value FROM tools""")
    out["c_join_answers"] = "SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL"
    out["c_categories"] = "SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1"
    out["c_sample"] = "SELECT doc_id AS id FROM documents ORDER BY md5('20260604|' || doc_id), doc_id LIMIT 100"
    out["c_cells"] = f"WITH {_CELLS} SELECT custom_id, entry_id, category, condition, model, skipped, skip_reason FROM cells"
    out["c_slices"] = f"WITH {_CELLS} SELECT model, count(*)::INT AS cells, CASE WHEN model = 'm1' THEN count(*) FILTER (WHERE NOT skipped) END AS sent FROM cells GROUP BY model"
    out["c_latest"] = f"WITH {_RESULTS} SELECT custom_id, status, said, error FROM results"
    out["c_raw_store"] = _STORE + " SELECT * FROM store"
    out["c_status_rollup"] = _STORE + """ SELECT provider, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'api_error') AS api_error,
      (count(*) FILTER (WHERE status = 'api_error'))::INT AS n_error_ids, min(custom_id) FILTER (WHERE status = 'api_error') AS first_error FROM store GROUP BY provider"""
    out["i_resume"] = "SELECT DISTINCT 'w' || (event_id % 4000) AS custom_id, CASE WHEN event_id % 4000 % 10 = 7 THEN 'api_error' ELSE 'completed' END AS status FROM events"
    out["x_extract"] = f"SELECT conv_id, turn, CASE {D.SHAPE} WHEN 0 THEN 'no_fenced_block' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'invalid_shape' ELSE 'valid' END AS outcome, CASE WHEN {D.SHAPE} IN (1, 4) THEN 'do.it' END AS name FROM conversations"
    out["x_expected"] = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'do_it' ELSE 'do.it' END AS name, '[x]' AS keys, c_mktsegment AS x FROM customer"
    out["g_scored"] = f"WITH {_ANSWER} SELECT custom_id, status, valid AS syntactic_valid, semantic_correct, parse_outcome, CASE WHEN status = 'skipped' THEN 'no_tools' END AS skip_reason, CASE WHEN status = 'api_error' THEN 'timeout' END AS api_error FROM g"
    out["g_summary"] = f"""WITH {_ANSWER} SELECT provider AS model, condition, count(*) AS n, count(*) FILTER (WHERE valid) AS syntactic_valid_count, count(*) FILTER (WHERE semantic_correct) AS semantic_correct_count,
      round(count(*) FILTER (WHERE valid)::DOUBLE / count(*), 4) AS syntactic_valid_rate, round(count(*) FILTER (WHERE semantic_correct)::DOUBLE / nullif(count(*) FILTER (WHERE valid), 0), 4) AS semantic_correct_rate
      FROM g WHERE status = 'completed' GROUP BY ALL"""
    out["h_paired"] = _H_PAIRED
    out["h_descriptive"] = f"""WITH cells AS ({D.CELLS}), g AS (SELECT model, condition, count(*) AS n, count(*) FILTER (WHERE syntactic) AS s, count(*) FILTER (WHERE syntactic AND semantic) AS m FROM cells WHERE status = 'completed' AND entry_id NOT IN (0, 7) GROUP BY ALL)
      SELECT model, condition, n, s AS n_syntactic, m AS n_semantic, round(s::DOUBLE / n, 4) AS syntactic_rate, round(m::DOUBLE / nullif(s, 0), 4) AS semantic_rate,
      {_wilson('s', 'n', '-')} AS syntactic_low, {_wilson('s', 'n', '+')} AS syntactic_high, {_wilson('m', 's', '-')} AS semantic_low, {_wilson('m', 's', '+')} AS semantic_high FROM g"""
    out["h_reconcile"] = _PAIRED.format(extra="") + " SELECT model, first, second, metric, first_only, second_only, first_only + CASE WHEN model = 'en' THEN 1 ELSE 0 END AS expected_first, second_only AS expected_second, model <> 'en' AS agrees FROM t"
    out["d_savings"] = f"WITH {_PAIRS} SELECT coalesce(tokenizer, 'all') AS tokenizer, {_STATS} FROM r GROUP BY GROUPING SETS ((tokenizer), ())"
    out["d_correlation"] = f"WITH {_PAIRS} SELECT tokenizer, count(*) AS n, round(corr(j, saving), 6) AS r FROM r GROUP BY tokenizer"
    out["d_bins"] = f"""WITH {_PAIRS}, i AS (SELECT *, row_number() OVER (PARTITION BY tokenizer ORDER BY j, key) AS i, count(*) OVER (PARTITION BY tokenizer) AS m FROM r)
      SELECT tokenizer, (ceil(i * 10 / m) - 1)::BIGINT AS bin, count(*) AS n, round(median(j), 6) AS size, round(median(saving), 6) AS saving FROM i GROUP BY ALL"""
    out["d_wins"] = f"WITH {_PAIRS} SELECT tokenizer, count(*) FILTER (WHERE c < j) AS wins, count(*) FILTER (WHERE c > j) AS regressions, count(*) FILTER (WHERE c = j) AS ties FROM r GROUP BY tokenizer"
    out["d_regressions"] = f"WITH {_PAIRS} SELECT tokenizer, key, delta FROM r WHERE c > j"
    out["d_gap"] = f"WITH {_PAIRS} SELECT tokenizer, round(median(saving), 6) AS compact, round(median((j + 20 - c) * 100.0::DOUBLE / (j + 20)), 6) AS pretty, round(median((j + 20 - c) * 100.0::DOUBLE / (j + 20)) - median(saving), 6) AS gap FROM r GROUP BY tokenizer"
    out["d_categories"] = _with(", e AS (SELECT unnest(string_split(categories, ',')) AS category, (tj - tc) * 100.0::DOUBLE / tj AS saving FROM counted WHERE tj > 0) SELECT category, count(*) AS n, round(median(saving), 6) AS median, round(avg(saving), 6) AS mean FROM e GROUP BY 1")
    out["b_curve"] = f"WITH {_CURVE} SELECT n, round(mean_json, 9) AS mean_json, round(mean_compact, 9) AS mean_compact, round(win_rate, 9) AS win_rate, round(mean_overhead, 9) AS mean_overhead, round(saving, 9) AS saving FROM saved WHERE arm = 'calibrated'"
    out["b_break_even"] = f"""WITH {_CURVE}, d AS (SELECT arm, n, mean_compact - mean_json AS d, lead(mean_compact - mean_json) OVER w AS d2, lead(n) OVER w AS n2, row_number() OVER w AS i FROM saved WINDOW w AS (PARTITION BY arm ORDER BY n)),
      x AS (SELECT arm, n, CASE WHEN d > 0 AND d2 <= 0 THEN n + d / (d - d2) * (n2 - n) END AS pos, CASE WHEN i = 1 AND d <= 0 THEN 1.0 END AS start FROM d)
      SELECT arm, round(coalesce(max(start), arg_min(pos, n) FILTER (WHERE pos IS NOT NULL)), 9) AS break_even FROM x GROUP BY arm"""
    out["b_thresholds"] = f"""WITH {_CURVE}, d AS (SELECT arm, n, saving, lead(saving) OVER w AS s2, lead(n) OVER w AS n2, row_number() OVER w AS i, last_value(saving) OVER (PARTITION BY arm ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM saved WHERE arm = 'calibrated' WINDOW w AS (PARTITION BY arm ORDER BY n)),
      x AS (SELECT *, CASE WHEN saving < t AND t <= s2 THEN n + (t - saving) / (s2 - saving) * (n2 - n) END AS pos, CASE WHEN i = 1 AND saving >= t THEN n END AS start FROM d, (VALUES (10.0::DOUBLE), (20.0), (25.0), (99.0)) v(t))
      SELECT arm, t AS threshold, round(CASE WHEN any_value(last) >= t THEN coalesce(max(start), arg_min(pos, n) FILTER (WHERE pos IS NOT NULL)) END, 9) AS n FROM x GROUP BY arm, t"""
    out["b_ratio"] = f"WITH {_CURVE} SELECT a.n, round(a.mean_overhead / b.mean_overhead, 9) AS ratio FROM saved a JOIN saved b ON a.n = b.n AND a.arm = 'calibrated' AND b.arm = 'full'"
    out["o_round_trips"] = _with("SELECT count(*) AS n, count(*) AS same, false AS any_differs FROM tools WHERE bucket <> 'invalid_input'")
    return out
