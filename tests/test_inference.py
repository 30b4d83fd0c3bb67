"""Statistics against published numbers and plain formulas."""

import math

import pytest
from pyspark.sql import functions as F

from schemaloom.functions.math import binomial_two_sided, erfc
from schemaloom.operators import distributions, inference

# Published paired rows. model, metric, pair, both, first only, second only, neither, difference, interval, p, verdict
PUBLISHED = [
    ("M1", "semantic", "ab", 755, 19, 25, 113, -0.0066, -0.0208, 0.0077, 0.4510, "pass"),
    ("M1", "semantic", "ac", 688, 68, 26, 105, 0.0474, 0.0262, 0.0685, 2.35e-5, None),
    ("M1", "semantic", "bc", 692, 66, 19, 106, 0.0532, 0.0331, 0.0734, 6.06e-7, None),
    ("M1", "syntactic", "ab", 912, 35, 10, 27, 0.0254, 0.0121, 0.0387, 3.47e-4, None),
    ("M2", "semantic", "ab", 766, 27, 45, 107, -0.0190, -0.0366, -0.0015, 0.0451, "inconclusive"),
    ("M2", "semantic", "ac", 752, 38, 34, 114, 0.0043, -0.0135, 0.0220, 0.7237, None),
    ("M2", "semantic", "bc", 773, 35, 16, 117, 0.0202, 0.0054, 0.0350, 0.0117, None),
    ("M2", "syntactic", "ab", 945, 10, 8, 21, 0.0020, -0.0064, 0.0105, 0.8145, None),
    ("M3", "semantic", "ab", 760, 24, 49, 123, -0.0262, -0.0436, -0.0087, 0.0050, "inconclusive"),
    ("M3", "semantic", "ac", 742, 29, 55, 113, -0.0277, -0.0467, -0.0086, 0.0064, None),
    ("M3", "semantic", "bc", 775, 29, 33, 117, -0.0042, -0.0204, 0.0120, 0.7032, None),
    ("M3", "syntactic", "ab", 956, 2, 20, 6, -0.0183, -0.0276, -0.0090, 1.21e-4, None),
    ("M1", "joint", "ab", 755, 42, 32, 155, 0.0102, -0.0070, 0.0273, 0.2955, "pass"),
    ("M2", "joint", "ab", 766, 32, 51, 135, -0.0193, -0.0374, -0.0012, 0.0482, "inconclusive"),
    ("M3", "joint", "ab", 760, 26, 60, 138, -0.0346, -0.0529, -0.0162, 3.73e-4, "inconclusive"),
]
# Published counts. model, arm, n, syntactic, semantic, their rates
RATES = [
    ("M1", "a", 984, 947, 797, 0.9624, 0.8416), ("M1", "b", 985, 923, 788, 0.9371, 0.8537), ("M1", "c", 985, 904, 722, 0.9178, 0.7987),
    ("M2", "a", 984, 955, 798, 0.9705, 0.8356), ("M2", "b", 985, 954, 817, 0.9685, 0.8564), ("M2", "c", 984, 948, 793, 0.9634, 0.8365),
    ("M3", "a", 984, 958, 786, 0.9736, 0.8205), ("M3", "b", 985, 977, 820, 0.9919, 0.8393), ("M3", "c", 985, 958, 811, 0.9726, 0.8466),
]


def test_published_pairs(spark):
    rows = [(m, p[0], p[1], k, b + x + y + n, b, x, y, n) for m, k, p, b, x, y, n, *_ in PUBLISHED]
    t = spark.createDataFrame(rows, "model string, first string, second string, metric string, n long, both long, first_only long, second_only long, neither long")
    got = {(x.model, x.metric, x.first + x.second): x for x in inference.paired_statistics(t).collect()}
    for m, k, p, _, x, y, _, d, lo, hi, pv, v in PUBLISHED:
        g = got[m, k, p]
        assert (round(g["diff"], 4), round(g.ci_low, 4), round(g.ci_high, 4), g.verdict) == (d, lo, hi, v)
        # p values are published to four places, small ones to three digits
        assert g.p_value == pytest.approx(pv, rel=0, abs=5.1e-5 if pv > 1e-3 else pv * 5e-3) and g.exact == (x + y < 25)


def test_published_rates(spark):
    """Cells that have the published counts."""
    parts = None
    for m, a, n, s, c, *_ in RATES:
        one = spark.range(n).select(F.lit(m).alias("model"), F.lit(a).alias("condition"), (F.col("id") < s).alias("syntactic"), (F.col("id") < c).alias("semantic"))
        parts = one if parts is None else parts.unionByName(one)
    got = {(x.model, x.condition): x for x in inference.descriptive(parts).collect()}
    for m, a, n, s, c, rs, rc in RATES:
        g = got[m, a]
        assert (g.n, g.n_syntactic, g.n_semantic, g.syntactic_rate, g.semantic_rate) == (n, s, c, rs, rc)
        assert 0 < g.syntactic_low < s / n < g.syntactic_high < 1 and 0 < g.semantic_low < c / s < g.semantic_high < 1


def test_erfc_and_binomial(spark):
    xs = [0.0, 1e-6, 0.3, 1.0, 1.999, 2.0, 2.5, 4.0, 7.0, 12.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    for g in got:
        assert g.y == pytest.approx(math.erfc(g.x), rel=1e-11, abs=1e-15)
    kn = [(k, n) for n in range(1, 25) for k in range(n // 2 + 1)]
    got = spark.createDataFrame(kn, "k int, n int").select("k", "n", binomial_two_sided(F.col("k"), F.col("n")).alias("p")).collect()
    for g in got:
        assert g.p == pytest.approx(min(1, 2 * sum(math.comb(g.n, i) for i in range(g.k + 1)) / 2**g.n), rel=1e-12)


def test_pairs_need_both_arms(spark):
    cells = [("m", 1, "a", True, True), ("m", 1, "b", True, False), ("m", 2, "a", True, True), ("m", 3, "a", False, None), ("m", 3, "b", True, True), ("m", 4, "a", True, None), ("m", 4, "b", True, True)]
    df = spark.createDataFrame(cells, "model string, entry_id long, condition string, syntactic boolean, semantic boolean")
    got = {x.metric: x for x in inference.paired_tables(df, [("a", "b", m) for m in ("semantic", "syntactic", "joint")]).collect()}
    assert [(g.n, g.both, g.first_only, g.second_only, g.neither) for g in (got["semantic"], got["syntactic"], got["joint"])] == [(2, 0, 1, 1, 0), (3, 2, 0, 1, 0), (3, 0, 1, 2, 0)]


@pytest.mark.parametrize("n", [1, 9, 10, 23, 37])
def test_bins(spark, n):
    df = spark.range(n).select(F.lit("t").alias("tokenizer"), F.col("id").alias("key"), (F.col("id") + 1).alias("j"), F.lit(1).alias("c"))
    got = [(x.bin, x.n) for x in distributions.equal_count_bins(df).orderBy("bin").collect()]
    want = {}
    for i in range(n):
        b = math.ceil((i + 1) * 10 / n) - 1
        want[b] = want.get(b, 0) + 1
    assert got == sorted(want.items())


def test_degenerate_statistics(spark):
    df = spark.createDataFrame([("t", 1, 5, 5), ("t", 2, 5, 5), ("u", 1, 0, 3)], "tokenizer string, key long, j long, c long")
    assert math.isnan(distributions.size_correlation(df).where("tokenizer = 't'").first().r)
    assert {x.tokenizer for x in distributions.saving_summary(df).collect()} == {"t", "all"}
