"""Do schemas accept the same instances? Every schema meets every probe in one bounded product, then votes are compared."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..kernels.instances import PROBES


def probe_table(spark: SparkSession) -> DataFrame:
    """The fixed instances, as JSON text; their number is a constant."""
    return spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(PROBES)], "probe_id int, instance string")


def votes(schemas: DataFrame, probes: DataFrame | None = None, key: str = "tool_hash", schema: str = "schema") -> DataFrame:
    """(key, probe_id, ok) of each schema and probe: the fixed list is exploded beside each schema, no join is needed."""
    if probes is None:
        both = schemas.select(key, schema, F.posexplode(F.array(*[F.lit(json.dumps(p)) for p in PROBES])).alias("probe_id", "instance"))
    else:
        both = schemas.select(key, schema).join(probes, F.lit(True))
    return both.select(key, "probe_id", K.conforms(F.col("instance"), F.col(schema)).alias("ok"))


def disagreements(a: DataFrame, b: DataFrame, key: str = "tool_hash") -> DataFrame:
    """Probes that one version of a schema accepts and the other doesn't."""
    y = votes(b, key=key).withColumnRenamed("ok", "ok_b")
    return votes(a, key=key).join(y, [key, "probe_id"]).where(~F.col("ok").eqNullSafe(F.col("ok_b")))


def round_trips(schemas: DataFrame, key: str = "tool_hash", schema: str = "schema") -> DataFrame:
    """Per schema: whether it and its round trip agree, by equal text or by probes and samples."""
    return schemas.select(key, K.round_trip(F.col(schema)).alias("r")).select(key, "r.*")


def round_trip_report(trips: DataFrame) -> DataFrame:
    return trips.agg(F.count("*").alias("n"), F.count_if("same").alias("same"), F.count_if("structural").alias("structural"), F.count_if("thin").alias("thin"), F.sum("tried").alias("tried"), F.bool_or(~F.coalesce("same", F.lit(False))).alias("any_differs"))
