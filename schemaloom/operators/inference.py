"""Paired inference: 2x2 tables, McNemar, paired differences, verdicts, Wilson intervals, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.math import Z95, binomial_two_sided, erfc, wilson

#: The non-inferiority margin, and discordant pairs under which the test is exact.
MARGIN, EXACT_UNDER = 0.03, 25
#: Comparisons made per model: arms and metric.
COMPARISONS = [("a", "b", "semantic"), ("a", "c", "semantic"), ("b", "c", "semantic"), ("a", "b", "syntactic")]


def usable(cells: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Cells that count: completed ones whose entry isn't excluded."""
    out = cells.where(~F.coalesce(F.col("status"), F.lit("")).isin("skipped", "api_error"))
    return out.where(~F.col("entry_id").isin(excluded)) if excluded else out


def paired_tables(cells: DataFrame, comparisons: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """cells(model, entry_id, condition, syntactic, semantic) -> per model and comparison: n, both, first_only, second_only, neither.

    One aggregation pivots an entry's arms into a row; the 2x2 counts are conditional counts over it. Semantic pairs
    need both arms to be syntactically valid; joint success is both at once and needs only the pair.
    """
    arms = ["a", "b", "c"]
    per = cells.groupBy("model", "entry_id").agg(*[F.max(F.when(F.col("condition") == c, F.struct(F.col("syntactic"), F.coalesce("semantic", F.lit(False)).alias("semantic")))).alias(c) for c in arms])
    want = F.array(*[F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), F.lit(m).alias("metric")) for x, y, m in comparisons or COMPARISONS])
    pick = lambda name: F.when(F.col(f"w.{name}") == "a", F.col("a")).when(F.col(f"w.{name}") == "b", F.col("b")).otherwise(F.col("c"))
    rows = per.withColumn("w", F.explode(want)).withColumns({"x": pick("first"), "y": pick("second")}).where("x is not null and y is not null")
    rows = rows.where((F.col("w.metric") != "semantic") | (F.col("x.syntactic") & F.col("y.syntactic")))
    hit = lambda s: F.when(F.col("w.metric") == "semantic", F.col(f"{s}.semantic")).when(F.col("w.metric") == "syntactic", F.col(f"{s}.syntactic")).otherwise(F.col(f"{s}.syntactic") & F.col(f"{s}.semantic"))
    x, y = hit("x"), hit("y")
    return rows.groupBy("model", F.col("w.first").alias("first"), F.col("w.second").alias("second"), F.col("w.metric").alias("metric")).agg(
        F.count("*").alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(~x & ~y).alias("neither")
    )


def mcnemar(b: Column, c: Column) -> tuple[Column, Column, Column]:
    """(exact?, statistic, p): the smaller count and exact binomial for few discordant pairs, else corrected chi-square."""
    n = b + c
    exact = n < EXACT_UNDER
    chi = F.pow(F.abs(b - c) - 1, F.lit(2.0)) / n
    stat = F.when(exact, F.least(b, c).cast("double")).otherwise(chi)
    p = F.when(n == 0, F.lit(1.0)).when(exact, binomial_two_sided(F.least(b, c).cast("int"), n)).otherwise(erfc(F.sqrt(chi / 2)))
    return exact, stat, p


def paired_statistics(tables: DataFrame) -> DataFrame:
    """Difference with its interval, the test, and the verdict (first arm not worse by the margin; semantic and joint a-b only)."""
    b, c, n = F.col("first_only"), F.col("second_only"), F.col("n")
    diff = (b - c) / n
    se = F.sqrt(b + c - F.pow(b - c, F.lit(2.0)) / n) / n
    exact, stat, p = mcnemar(b, c)
    low, high = diff - Z95 * se, diff + Z95 * se
    judged = (F.col("first") == "a") & (F.col("second") == "b") & F.col("metric").isin("semantic", "joint")
    verdict = F.when(judged, F.when(low > -MARGIN, "pass").when(high <= -MARGIN, "fail").otherwise("inconclusive"))
    return tables.select("*", diff.alias("diff"), low.alias("ci_low"), high.alias("ci_high"), exact.alias("exact"), stat.alias("statistic"), p.alias("p_value"), verdict.alias("verdict"))


def descriptive(cells: DataFrame) -> DataFrame:
    """Per model and condition: counts, rates and Wilson intervals; the semantic base is what is syntactically valid."""
    g = cells.groupBy("model", "condition").agg(F.count("*").alias("n"), F.count_if("syntactic").alias("n_syntactic"), F.count_if(F.col("syntactic") & F.coalesce("semantic", F.lit(False))).alias("n_semantic"))
    s_low, s_high = wilson(F.col("n_syntactic"), F.col("n"))
    m_low, m_high = wilson(F.col("n_semantic"), F.col("n_syntactic"))
    return g.select("*", F.round(F.col("n_syntactic") / F.col("n"), 4).alias("syntactic_rate"), F.round(F.try_divide("n_semantic", "n_syntactic"), 4).alias("semantic_rate"), s_low.alias("syntactic_low"), s_high.alias("syntactic_high"), m_low.alias("semantic_low"), m_high.alias("semantic_high"))


def reconcile(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Discordant counts beside expected ones(model, first, second, metric, first_only, second_only), and whether they agree."""
    keys = ["model", "first", "second", "metric"]
    e = expected.select(*keys, F.col("first_only").alias("expected_first"), F.col("second_only").alias("expected_second"))
    ok = F.col("first_only").eqNullSafe(F.col("expected_first")) & F.col("second_only").eqNullSafe(F.col("expected_second"))
    return actual.join(e, keys, "full_outer").select(*keys, "first_only", "second_only", "expected_first", "expected_second", ok.alias("agrees"))


def comparisons_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPARISONS, "first string, second string, metric string")
