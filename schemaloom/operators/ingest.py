"""Provider results: parsers, later files over earlier ones, the merge with the plan, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _json(path: str) -> Column:
    return F.get_json_object("line", path)


def parse_openai(lines: DataFrame) -> DataFrame:
    """lines(line, file_ord) -> custom_id, status, raw, error, file_ord. A top error or any status but 200 is an API error."""
    top, code, body = _json("$.error"), _json("$.response.status_code").cast("int"), _json("$.response.body")
    ok = top.isNull() & F.coalesce(code == 200, F.lit(False))
    error = F.coalesce(top, body, F.concat(F.lit("HTTP "), F.coalesce(code.cast("string"), F.lit("None"))))
    return _results(lines, ok, F.when(ok, body).otherwise(F.col("line")), error)


def parse_anthropic(lines: DataFrame) -> DataFrame:
    kind = _json("$.result.type")
    ok = F.coalesce(kind == "succeeded", F.lit(False))
    return _results(lines, ok, F.when(ok, _json("$.result.message")).otherwise(F.col("line")), F.coalesce(kind, F.lit("unknown_batch_result")))


def parse_checkpoint(lines: DataFrame) -> DataFrame:
    """Lines of a synchronous run; a completed call may carry an extraction error along."""
    ok = F.coalesce((_json("$.status") == "completed") & (_json("$.http_status") == "200"), F.lit(False))
    error = F.when(ok, _json("$.extraction_error")).otherwise(F.coalesce(_json("$.error"), _json("$.extraction_error"), F.lit("qwen_sync_error")))
    return _results(lines, ok, _json("$.response_body"), error)


def _results(lines: DataFrame, ok: Column, raw: Column, error: Column) -> DataFrame:
    """Error texts of completed rows are null unless the parser's error column says otherwise for them."""
    rows = lines.where(F.trim("line") != "")
    return rows.select(_json("$.custom_id").alias("custom_id"), F.when(ok, "completed").otherwise("api_error").alias("status"), raw.alias("raw"), F.when(~ok, error).otherwise(F.when(_json("$.extraction_error").isNotNull(), _json("$.extraction_error"))).alias("error"), "file_ord")


def latest(results: DataFrame, key: str = "custom_id", order: str = "file_ord") -> DataFrame:
    """The last result of each id."""
    rest = [c for c in results.columns if c not in (key, order)]
    return results.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def raw_store(cells: DataFrame, results: DataFrame, run_id: str, provider: Column) -> DataFrame:
    """The plan's cells with what came back: skipped, missing, error or completed; one record per cell."""
    r = results.select("custom_id", F.col("status").alias("__s"), F.col("raw").alias("__r"), F.col("error").alias("__e"))
    j = cells.join(r, "custom_id", "left")
    status = F.when(F.col("skipped"), "skipped").when(F.col("__s").isNull(), "api_error").otherwise(F.col("__s"))
    sent = ~F.col("skipped")
    return j.select(
        "custom_id", F.lit(run_id).alias("run_id"), "entry_id", "category", "condition", "model", provider.alias("provider"), status.alias("status"),
        F.when(F.col("skipped"), F.col("skip_reason")).alias("skip_reason"), F.when(sent, F.col("__r")).alias("raw_response"),
        F.when(sent, F.when(F.col("__s").isNull(), "missing_from_provider_results").otherwise(F.col("__e"))).alias("error"),
    )


def status_rollup(records: DataFrame) -> DataFrame:
    """Per provider: counts by status, and the least id of an error; error_ids has them all."""
    s = F.col("status")
    return records.groupBy("provider").agg(F.count_if(s == "completed").alias("completed"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "api_error").alias("api_error"), F.min(F.when(s == "api_error", F.col("custom_id"))).alias("first_error"))


def error_ids(records: DataFrame) -> DataFrame:
    """A row per failed cell, in order of provider and id: the rollup's list, which isn't gathered in one row."""
    return records.where("status = 'api_error'").select("provider", "custom_id").orderBy("provider", "custom_id")
