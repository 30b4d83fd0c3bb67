"""Token statistics: reductions, summaries by tokenizer and pooled, correlation, equal-count bins, categories, causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plan import places

#: Fixed value: what the offline counter takes for a token: a run of letters, a digit, or another visible character.
TOKEN_PATTERN = r"[A-Za-z]+|\d|[^\sA-Za-z\d]"


def offline_tokens(text: Column) -> Column:
    """A deterministic stand-in for a tokenizer's count, by built-in functions; it isn't a BPE count."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))).cast("long")


def reductions(pairs: DataFrame) -> DataFrame:
    """pairs(tokenizer, key, j, c) with j > 0 -> also the change c - j and the percentage saved."""
    return pairs.where("j > 0").select("*", (F.col("c") - F.col("j")).alias("delta"), ((F.col("j") - F.col("c")) * 100.0 / F.col("j")).alias("saving"))


def saving_summary(pairs: DataFrame) -> DataFrame:
    """Eight numbers of the saving per tokenizer and, as tokenizer 'all', over all; how many grew; the ratio of sums."""
    r = reductions(pairs)
    q = F.percentile("saving", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    g = r.groupingSets([["tokenizer"], []], "tokenizer").agg(
        F.count("*").alias("n"), F.avg("saving").alias("mean"), F.min("saving").alias("least"), F.max("saving").alias("most"), q.alias("q"),
        F.count_if(F.col("c") > F.col("j")).alias("worse"), ((F.sum("j") - F.sum("c")) * 100.0 / F.sum("j")).alias("ratio_of_sums"), F.grouping("tokenizer").alias("pooled"),
    )
    return g.select(F.when(F.col("pooled") == 1, "all").otherwise(F.col("tokenizer")).alias("tokenizer"), "n", "mean", "least", *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("p5", "p25", "median", "p75", "p95"))], "most", "worse", "ratio_of_sums")


def baseline_gap(compact: DataFrame, pretty: DataFrame) -> DataFrame:
    """Median savings against two baselines of the same keys, and the gap in percentage points."""
    m = lambda df, n: reductions(df).groupBy("tokenizer").agg(F.median("saving").alias(n))
    return m(compact, "compact").join(m(pretty, "pretty"), "tokenizer").select("*", (F.col("pretty") - F.col("compact")).alias("gap"))


def size_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson correlation of size and saving per tokenizer; NaN where either doesn't vary."""
    r = reductions(pairs).groupBy("tokenizer").agg(F.count("*").alias("n"), F.covar_pop("j", "saving").alias("c"), F.stddev_pop("j").alias("sj"), F.stddev_pop("saving").alias("ss"))
    varies = (F.col("sj") > 0) & (F.col("ss") > 0)
    return r.select("tokenizer", "n", F.when(varies, F.try_divide("c", F.col("sj") * F.col("ss"))).otherwise(F.lit(float("nan"))).alias("r"))


def equal_count_bins(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Median size and saving in bins of equal count by size: of n rows, row i (from 0) is in bin ceil((i + 1) * bins / n) - 1.

    Rows are numbered over all tokenizers at once by range partitions, and a tokenizer's first number is taken off; so no
    task sorts all of a tokenizer's rows.
    """
    r = places(reductions(pairs).select("tokenizer", "key", "j", "saving"), ["tokenizer", "j", "key"])
    of = r.groupBy("tokenizer").agg(F.min("place").alias("first"), F.count("*").alias("m"))
    bin_of = F.ceil((F.col("place") - F.col("first") + 1) * bins / F.col("m")) - 1
    return r.join(of, "tokenizer").withColumn("bin", bin_of).groupBy("tokenizer", "bin").agg(F.count("*").alias("n"), F.median("j").alias("size"), F.median("saving").alias("saving"))


def win_split(pairs: DataFrame) -> DataFrame:
    """Per tokenizer: how many shrank, grew, stayed."""
    return pairs.where("j > 0").groupBy("tokenizer").agg(F.count_if(F.expr("c < j")).alias("wins"), F.count_if(F.expr("c > j")).alias("regressions"), F.count_if(F.expr("c = j")).alias("ties"))


def regressions(pairs: DataFrame) -> DataFrame:
    """Rows that grew, the largest growth first."""
    return reductions(pairs).where("c > j").orderBy(F.desc("delta"), F.desc("key"))


def category_savings(rows: DataFrame) -> DataFrame:
    """rows(categories array, savings array of a row's tokenizers, nulls allowed) -> per category: n, median and mean of the
    rows' means over the tokenizers that have one; best first."""
    have = F.filter("savings", lambda x: x.isNotNull())
    mean = F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have)
    one = rows.where(F.size(have) > 0).select(F.explode("categories").alias("category"), mean.alias("saving"))
    return one.groupBy("category").agg(F.count("*").alias("n"), F.median("saving").alias("median"), F.avg("saving").alias("mean")).orderBy(F.desc("median"), "category")


def cause_histogram(rows: DataFrame) -> DataFrame:
    """Why rows fell back, rarest first."""
    return rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy("n", "reason")
