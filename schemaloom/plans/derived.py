"""Inputs of the queries, derived from the tables by SQL expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Class of a part's tool definition, and what its size adds to a bound.
K, S = "(p_partkey % 12)", "CAST(p_size AS STRING)"
S10 = "CAST(p_size + 10 AS STRING)"
NAME = f"('tool_' || CAST({K} AS STRING) || '_' || {S})"


def _case(parts: dict[int, str], other: str) -> str:
    return f"(CASE {K} " + " ".join(f"WHEN {k} THEN {v}" for k, v in parts.items()) + f" ELSE {other} END)"


def _properties(float_word: str) -> str:
    return _case(
        {
            0: f"""'"limit":{{"maximum":' || {S10} || ',"minimum":1,"type":"integer"}},"q":{{"type":"string"}}'""",
            1: """'"q":{"type":"string"}'""",
            2: """'"q":{"oneOf":[{"type":"string"},{"type":"integer"}]}'""",
            3: f"""'"n":{{"maximum":1,"minimum":' || {S10} || ',"type":"integer"}}'""",
            4: """'"q":{"enum":["a",1]}'""",
            5: """'"note":{"nullable":true,"type":"string"},"q":{"description":"text","type":"string"}'""",
            6: f"""'"x":{{"type":"{float_word}"}}'""",
            7: "''",
            8: f"""'"tags":{{"default":[],"items":{{"type":"string"}},"maxItems":' || {S} || ',"type":"array","uniqueItems":true}}'""",
            9: """'"mode":{"const":"auto"},"sort":{"enum":["asc","desc"]}'""",
            10: """'"q":{"maxLength":-1,"type":"string"}'""",
        },
        """'"place":{"additionalProperties":false,"properties":{"city":{"minLength":1,"type":"string"},"zip":{"type":"string"}},"required":["city"],"type":"object"}'""",
    )


_REQUIRED = _case({0: """',"required":["q"]'""", 5: """',"required":["q"]'""", 9: """',"required":["sort"]'""", 11: """',"required":["place"]'"""}, "''")


def schema_sql(float_word: str = "float") -> str:
    """A part's tool definition as canonical JSON text."""
    closed = _case({1: "'{'"}, """'{"additionalProperties":false,'""")
    return f"""({closed} || '"description":"size ' || {S} || '","name":"' || {NAME} || '","properties":{{' || {_properties(float_word)} || '}}' || {_REQUIRED} || ',"type":"object"}}')"""


SCHEMA, MAPPED = schema_sql(), schema_sql("number")
BUCKET = _case({2: "'fell_back'", 3: "'fell_back'", 4: "'fell_back'", 10: "'invalid_input'"}, "'converted'")
#: The notation of what converts.
TEXT = (
    f"({NAME} || ' # size ' || {S} || "
    + _case(
        {
            0: f"chr(10) || '  limit integer[1,' || {S10} || ']' || chr(10) || '  q* string'",
            1: "chr(10) || '  q string'",
            5: "chr(10) || '  note string|null' || chr(10) || '  q* string # text'",
            6: "chr(10) || '  x number'",
            7: "''",
            8: f"chr(10) || '  tags array<string>[,' || {S} || ']:unique =[]'",
            9: """chr(10) || '  mode "auto"' || chr(10) || '  sort* asc|desc'""",
            11: "chr(10) || '  place* object' || chr(10) || '    city* string:length[1,]' || chr(10) || '    zip string'",
        },
        "''",
    )
    + ")"
)
#: What comes back from that notation.
BACK = (
    f"""('[{{"name": "' || {NAME} || '", "description": "size ' || {S} || '", "type": "object", "properties": {{' || """
    + _case(
        {
            0: f"""'"limit": {{"type": "integer", "minimum": 1, "maximum": ' || {S10} || '}}, "q": {{"type": "string"}}}}, "required": ["q"]'""",
            1: """'"q": {"type": "string"}}'""",
            5: """'"note": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "q": {"type": "string", "description": "text"}}, "required": ["q"]'""",
            6: """'"x": {"type": "number"}}'""",
            7: "'}'",
            8: f"""'"tags": {{"type": "array", "default": [], "items": {{"type": "string"}}, "maxItems": ' || {S} || ', "uniqueItems": true}}}}'""",
            9: """'"mode": {"const": "auto"}, "sort": {"type": "string", "enum": ["asc", "desc"]}}, "required": ["sort"]'""",
            11: """'"place": {"type": "object", "properties": {"city": {"type": "string", "minLength": 1}, "zip": {"type": "string"}}, "required": ["city"], "additionalProperties": false}}, "required": ["place"]'""",
        },
        "''",
    )
    + """ || ', "additionalProperties": false}]')"""
)

#: A supplier's notation document by class, most with something wrong.
DOC = """(CASE (s_suppkey % 10)
 WHEN 0 THEN 't' || chr(10) || '  a string'
 WHEN 1 THEN 't' || chr(10) || '  a* integer =1'
 WHEN 2 THEN 't' || chr(10) || '  a $Nope'
 WHEN 3 THEN '$defs' || chr(10) || '  D' || chr(10) || '    x string'
 WHEN 4 THEN '$defs' || chr(10) || '  "bad-name"' || chr(10) || '    x string' || chr(10) || chr(10) || 't' || chr(10) || '  a string'
 WHEN 5 THEN 'u' || chr(10) || '  a string|"x"'
 WHEN 6 THEN 'u' || chr(10) || '  a 1|x'
 WHEN 7 THEN 'c' || chr(10) || '  n integer[5,1]' || chr(10) || '  s string:length[3,2]' || chr(10) || '  r array<string>[4,0]'
 WHEN 8 THEN 'd' || chr(10) || '  a string' || chr(10) || '  a integer' || chr(10) || '  a number'
 ELSE '$defs' || chr(10) || '  D' || chr(10) || '    x $E' || chr(10) || '  E' || chr(10) || '    y $D' || chr(10) || '  F' || chr(10) || '    z string' || chr(10) || chr(10) || 't' || chr(10) || '  a $D' || chr(10) || chr(10) || 't' || chr(10) || '  b string' END)"""

#: A message's response by class: no fence, one, broken JSON, no arguments, two fences.
SHAPE = "((conv_id + turn) % 5)"
CALL = """('{"name": "do.it", "arguments": {"x": "' || CAST(turn % 3 AS STRING) || '"' || (CASE WHEN conv_id % 2 = 0 THEN ', "y": "2"' ELSE '' END) || '}}')"""
RESPONSE = f"""(CASE {SHAPE}
 WHEN 0 THEN 'no call here'
 WHEN 1 THEN 'see ```json' || chr(10) || {CALL} || chr(10) || '```'
 WHEN 2 THEN '```' || chr(10) || '{{"name": oops}}' || chr(10) || '```'
 WHEN 3 THEN '```json {{"name": "do.it"}} ```'
 ELSE '```json {{"name": 1}} ``` then ```JSON' || chr(10) || {CALL} || chr(10) || '``` end' END)"""
CONDITION = "(CASE conv_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END)"
PROVIDER = "(CASE (conv_id + turn) % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'qwen' END)"
STATUS = "(CASE WHEN turn % 11 = 7 THEN 'skipped' WHEN turn % 13 = 5 THEN 'api_error' ELSE 'completed' END)"

#: A document's paired cells: three arms by class.
CELLS = """SELECT d.lang AS model, d.doc_id AS entry_id, arm.condition AS condition,
 (CASE arm.condition WHEN 'a' THEN l.quality = 1 OR d.doc_id % 3 = 0 WHEN 'b' THEN l.quality = 1 ELSE d.n_chars % 7 <> 0 END) AS syntactic,
 (CASE arm.condition WHEN 'a' THEN l.toxic = 0 WHEN 'b' THEN l.toxic = 0 OR d.n_chars % 2 = 0 ELSE d.n_chars % 5 <> 0 END) AS semantic,
 (CASE WHEN d.doc_id % 41 = 0 THEN 'skipped' WHEN d.doc_id % 43 = 0 THEN 'api_error' ELSE 'completed' END) AS status
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (SELECT 'a' AS condition UNION ALL SELECT 'b' UNION ALL SELECT 'c') arm"""


def view(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool occurrences of parts: schema, category, ord, class."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.selectExpr(f"{SCHEMA} AS schema", "p_brand AS category", "p_partkey AS ord")


def scored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "documents", "labels")
    return spark.sql(CELLS)
