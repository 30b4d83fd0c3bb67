"""Evaluation corpora and cell plans: checked joins, stable samples, cross products with sequential ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _first(df: DataFrame, message: str) -> None:
    if row := df.limit(1).collect():
        raise ValueError(f"{message}: {row[0].asDict()}")


def join_answers(prompts: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Inner join on unique ids; a repeated id on either side or a prompt without an answer is an error."""
    for df, side in ((prompts, "prompts"), (answers, "answers")):
        _first(df.groupBy(key).count().where("count > 1"), f"repeated id in {side}")
    _first(prompts.join(answers, key, "left_anti").select(key), "no answer for")
    return prompts.join(answers, key)


def select_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is listed; a listed id without a row is an error."""
    _first(ids.join(rows, key, "left_anti"), "listed but absent")
    return rows.join(ids, key, "left_semi")


def union_categories(parts: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """All parts with their category; counts other than expected are an error."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("category", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if expected:
        got = {r.category: r["count"] for r in out.groupBy("category").count().collect()}
        if wrong := {k: (n, got.get(k, 0)) for k, n in expected.items() if got.get(k, 0) != n}:
            raise ValueError(f"expected and actual counts differ: {wrong}")
    return out


def stable_sample(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows without replacement by the order of an MD5 of seed and id: the same on any cluster, ties by id."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def places(rows: DataFrame, order: str | list[str], name: str = "place") -> DataFrame:
    """Number rows from 0 in the order of a column or several, without bringing them to one task.

    Rows are sorted by range partitions and written once (numbering reads them twice, and ranges are sampled); a row's
    place is the count of rows in the partitions before, of which there are few, and its place in its own.
    """
    spark = rows.sparkSession
    mid = F.monotonically_increasing_id()
    by = [order] if isinstance(order, str) else order
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).withColumns({"__p": F.shiftright(mid, 33), "__i": mid.bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = cut(ranged)
    sizes = sorted((r["__p"], r["count"]) for r in ranged.groupBy("__p").count().collect())
    before, total = [], 0
    for p, n in sizes:
        before += [F.lit(p), F.lit(total)]
        total += n
    if not before:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("__p", "__i")
    return ranged.withColumn(name, F.element_at(F.create_map(*before), F.col("__p")) + F.col("__i")).drop("__p", "__i")


def cell_plan(entries: DataFrame, conditions: list[str], models: list[str], skip: DataFrame | None = None) -> DataFrame:
    """Every entry with every condition and model: custom_id (c0000001, ...), in order of entry, condition, model.

    entries(ord, entry_id, category, ...). skip(entry_id, condition, skip_reason) marks cells that aren't sent. The
    product is made by exploding a small literal list, so it needs no join; an entry at place p (see places()) begins
    at number p * conditions * models + 1.
    """
    arms = [(c, m) for c in conditions for m in models]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("condition"), F.lit(m).alias("model")) for i, (c, m) in enumerate(arms)]))
    cells = places(entries, "ord").withColumn("__a", each).select(F.format_string("c%07d", F.col("place") * len(arms) + F.col("__a.i") + 1).alias("custom_id"), "entry_id", "category", "__a.condition", "__a.model")
    if skip is None:
        return cells.withColumns({"skipped": F.lit(False), "skip_reason": F.lit(None).cast("string")})
    return cells.join(skip.select("entry_id", "condition", "skip_reason"), ["entry_id", "condition"], "left").withColumn("skipped", F.col("skip_reason").isNotNull()).select("custom_id", "entry_id", "category", "condition", "model", "skipped", "skip_reason")


def provider_slice(cells: DataFrame, model: str) -> DataFrame:
    return cells.where((F.col("model") == model) & ~F.col("skipped"))


def sidecar(cells: DataFrame) -> DataFrame:
    """A row per cell: model, custom_id as key, and what it stands for as value. Written by model it is a file of entries
    for each; no model's cells are gathered in one row."""
    return cells.select("model", F.col("custom_id").alias("key"), F.struct("entry_id", "category", "condition", "model", "skipped", "skip_reason").alias("value"))
