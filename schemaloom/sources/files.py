"""File sources and sinks of the engine, all through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the categories of the catalog's corpus.
CATEGORIES = (
    "simple_python", "multiple", "parallel", "parallel_multiple", "live_simple", "live_multiple", "live_parallel",
    "live_parallel_multiple", "irrelevance", "live_irrelevance", "live_relevance",
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of text files; empty lines are left out."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a schema; a line that isn't JSON ends the job, when it is read, with the line in the message."""
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = F.try_parse_json("line").isNotNull()
    return read_lines(spark, path).withColumn("ok", F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not JSON in "), F.col("file"), F.lit(": "), F.substring("line", 1, 200))).cast("boolean"))).where("ok").select("file", parsed.alias("r")).select("file", "r.*")


def category_of(file: Column) -> Column:
    """The category in a file's name: what stands between the last underscore-free prefix and the extension."""
    return F.regexp_extract(file, r"_v\d+_([a-z_]+)\.jsonl?$", 1)


def read_catalog(spark: SparkSession, path: str, categories: tuple[str, ...] | None = None) -> DataFrame:
    """Tool occurrences of JSON-lines files: (category, entry, ord, schema), a row per element of `function`.

    Elements stay JSON text, so that key order survives. Lines are parsed before elements become rows: a column taken
    from the line afterwards would parse the whole line again for each element.
    """
    rows = read_lines(spark, path).withColumn("category", category_of(F.col("file")))
    if categories:
        rows = rows.where(F.col("category").isin(*categories))
    tools = F.from_json(F.get_json_object("line", "$.function"), "array<string>")
    parsed = rows.select("category", F.get_json_object("line", "$.id").alias("entry"), tools.alias("tools"))
    return parsed.select("category", "entry", F.posexplode_outer("tools").alias("ord", "schema"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).json(path)
    return path


def write_once(df: DataFrame, path: str) -> bool:
    """Write JSON lines unless the folder is there and complete; whether it was written."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
        return False
    df.write.mode("overwrite").json(path)
    return True


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a log with the time of writing."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def summary_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with keys in order."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("value"))


def write_batches(lines: DataFrame, path: str) -> str:
    """lines(provider, line): a folder per provider."""
    lines.select("provider", F.col("line").alias("value")).write.mode("overwrite").partitionBy("provider").text(path)
    return path


def check_artifact(lines: DataFrame, max_lines: int | None = None, max_bytes: int | None = None, id_pattern: str = r"^[A-Za-z0-9_-]{1,64}$") -> DataFrame:
    """One row about lines(line): count, bytes, lines that aren't JSON, repeated and ill-formed ids, and whether all is well."""
    i = F.get_json_object("line", "$.custom_id")
    g = lines.agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.count_if(F.try_parse_json("line").isNull()).alias("not_json"), (F.count(i) - F.count_distinct(i)).alias("repeated_ids"), F.count_if(~F.coalesce(i, F.lit("")).rlike(id_pattern)).alias("bad_ids"))
    ok = (F.col("not_json") == 0) & (F.col("repeated_ids") == 0) & (F.col("bad_ids") == 0)
    if max_lines is not None:
        ok &= F.col("n") <= max_lines
    if max_bytes is not None:
        ok &= F.col("bytes") <= max_bytes
    return g.withColumn("ok", ok)
