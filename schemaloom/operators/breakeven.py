"""Break-even simulation: repeated draws with replacement, overhead per drawn feature set, crossings by windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import prompts

#: Fixed value: the numbers of tools that are simulated.
SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 40, 50)


def draw(n_pool: Column, *parts: Column) -> Column:
    """A stateless draw: the first 8 hex digits of an MD5 of the parts, modulo the pool. The same anywhere, any time."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long"), n_pool)


def trials(spark: SparkSession, n_pool: int, n_trials: int, sizes: tuple[int, ...] = SIZES, seed: int = 42) -> DataFrame:
    """(n, trial, slot, idx): which pool member fills each slot."""
    n = F.explode(F.array(*[F.lit(x) for x in sizes]))
    rows = spark.range(n_trials).select(F.col("id").alias("trial"), n.alias("n")).select("n", "trial", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"))
    return rows.withColumn("idx", draw(F.lit(n_pool), F.lit(seed), F.col("n"), F.col("trial"), F.col("slot")))


def sampled(drawn: DataFrame, pool: DataFrame) -> DataFrame:
    """Per trial: totals of both forms and the manifest of the tools drawn.

    pool(idx, j, c, a feature row of the tool) is joined once; features combine, so no tool is read again.
    """
    t = drawn.join(pool, "idx").groupBy("n", "trial").agg(F.sum("j").alias("j"), F.sum("c").alias("c"), *prompts.combined())
    return prompts.with_uniformity(t)


def costs(trials_: DataFrame, counter: Callable[[Column], Column], full_grammar: bool = False) -> DataFrame:
    """Per trial: totals of both forms, and tokens of the text around its tools, counted once per manifest. With
    full_grammar the text has every clause."""
    t = trials_.withColumns(prompts.full_manifest()) if full_grammar else trials_
    kinds = [*prompts.FLAGS, "required_uniformity", "all_fallback"]
    texts = t.select(kinds).distinct().withColumn("overhead", counter(prompts.overhead(F.col("required_uniformity"))))
    return t.join(texts, kinds).select("n", "trial", "j", "c", "overhead")


def curve(per_trial: DataFrame) -> DataFrame:
    """Per n: mean costs, saving as a ratio of means, share of trials won, mean overhead."""
    cost = F.col("c") + F.col("overhead")
    g = per_trial.groupBy("n").agg(F.avg("j").alias("mean_json"), F.avg(cost).alias("mean_compact"), F.avg((cost < F.col("j")).cast("int")).alias("win_rate"), F.avg("overhead").alias("mean_overhead"))
    return g.withColumn("saving", F.when(F.col("mean_json") != 0, (F.col("mean_json") - F.col("mean_compact")) / F.col("mean_json") * 100).otherwise(0.0))


def break_even(curve_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the n at which compact stops costing more, linear between sizes; null if it always does.

    Below cost from the first size on: 1; level there: that size.
    """
    w = W.partitionBy(*keys).orderBy("n")
    d = curve_rows.withColumn("d", F.col("mean_compact") - F.col("mean_json")).withColumns({"d2": F.lead("d").over(w), "n2": F.lead("n").over(w), "first": F.row_number().over(w) == 1})
    at = F.when((F.col("d") > 0) & (F.col("d2") <= 0), F.col("n") + F.col("d") / (F.col("d") - F.col("d2")) * (F.col("n2") - F.col("n")))
    start = F.when(F.col("first") & (F.col("d") == 0), F.col("n").cast("double")).when(F.col("first") & (F.col("d") < 0), 1.0)
    return d.groupBy(*keys).agg(F.coalesce(F.max(start), F.min_by(at, F.when(at.isNotNull(), F.col("n")))).alias("break_even"))


def threshold_crossing(curve_rows: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Per key and threshold: the n at which the saving first reaches it; null if the last size is below it."""
    w = W.partitionBy(*keys).orderBy("n")
    rows = curve_rows.withColumns({"s2": F.lead("saving").over(w), "n2": F.lead("n").over(w), "first": F.row_number().over(w) == 1}).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    t, s, s2 = F.col("threshold"), F.col("saving"), F.col("s2")
    at = F.when((s < t) & (t <= s2), F.col("n") + (t - s) / (s2 - s) * (F.col("n2") - F.col("n")))
    g = rows.groupBy(*keys, "threshold").agg(F.max_by("saving", "n").alias("last"), F.max(F.when(F.col("first") & (s >= t), F.col("n").cast("double"))).alias("start"), F.min_by(at, F.when(at.isNotNull(), F.col("n"))).alias("cross"))
    return g.select(*keys, "threshold", F.when(F.col("last") >= t, F.coalesce("start", "cross")).alias("n"))


def overhead_ratio(calibrated_curve: DataFrame, full_curve: DataFrame, keys: list[str]) -> DataFrame:
    """Calibrated overhead as a share of the whole grammar's, per size."""
    f = full_curve.select(*keys, "n", F.col("mean_overhead").alias("full_overhead"))
    return calibrated_curve.join(f, [*keys, "n"]).select(*keys, "n", (F.col("mean_overhead") / F.col("full_overhead")).alias("ratio"))
