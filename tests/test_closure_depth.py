"""Closures deeper than any fixed number of rounds."""

from pyspark.sql import functions as F

from schemaloom.operators import closure


def test_chain_of_seventy_definitions(spark):
    edges = spark.range(69).select(F.lit(1).alias("doc_id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.concat(F.lit("n"), F.col("id") + 1).alias("target"))
    seeds = spark.createDataFrame([(1, 0, "n0")], "doc_id int, owner int, name string")
    got = closure.reference_closure(seeds.coalesce(1), edges.coalesce(1))
    assert sorted(x.name for x in got.collect()) == sorted(f"n{i}" for i in range(70))


def test_deep_instances_are_judged_to_the_end():
    from schemaloom.kernels.instances import conforms

    s = {"$ref": "#/$defs/T", "$defs": {"T": {"type": "object", "properties": {"x": {"$ref": "#/$defs/T"}}, "additionalProperties": False}, "L": {"$ref": "#/$defs/L"}}}
    nest = lambda leaf, n: leaf if n == 0 else {"x": nest(leaf, n - 1)}
    assert conforms(nest({}, 80), s) and not conforms(nest({"y": 1}, 80), s) and not conforms(nest(3, 80), s)
    assert conforms(3, {"$ref": "#/$defs/L", **{"$defs": s["$defs"]}})
