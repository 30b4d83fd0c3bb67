"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes, floats reranked."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Codes: rotations of the vector, bits per substring.
ROTATIONS, SUB_BITS = 2, 16


@dataclass(frozen=True)
class Codes:
    """Learned rotations (ITQ) of one dimension, the norm that scales vectors, and the calibrated radius."""

    rotations: np.ndarray
    scale: float
    radius: int

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """16-bit substrings of the vectors. Inner product becomes angle by one more coordinate: base vectors, divided by
        the largest norm, are filled up to norm 1; queries get 0 there."""
        x = lift(x, self.scale, query)
        return np.packbits(np.concatenate([x @ r > 0 for r in self.rotations], axis=1), axis=1, bitorder="little").view("<u2")


def lift(x: np.ndarray, scale: float, query: bool) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)
    if query:
        return np.hstack([x / np.maximum(norm, 1e-300)[:, None], np.zeros((len(x), 1))])
    y = x / scale
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - np.square(y).sum(axis=1)))[:, None]])


def learn_codes(x: np.ndarray, scale: float, k: int, target: float, seed: int = 7) -> Codes:
    """ITQ rotations of the sample, and the radius within which `target` of its true k nearest lie.

    In a sample, neighbours are farther than among all rows, so the radius errs on the wide side.
    """
    rng = np.random.default_rng(seed)
    base = lift(x, scale, False)
    d = base.shape[1]
    bits = -(-d // SUB_BITS) * SUB_BITS
    made = []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.standard_normal((bits, bits)))[0][:d]
        for _ in range(12):
            u, _, vt = np.linalg.svd(base.T @ np.where(base @ r > 0, 1.0, -1.0), full_matrices=False)
            r = u @ vt
        made.append(r)
    codes = Codes(np.array(made), scale, 0)
    q = np.arange(0, len(x), max(1, len(x) // 400))
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, max(1, len(x) - 1))]
    a, b = codes.codes(x[q], True), codes.codes(x, False)
    dist = np.bitwise_count(a[:, None, :] ^ b[near]).sum(axis=2)
    return Codes(codes.rotations, scale, int(np.quantile(dist, target)) if len(x) > 1 else 0)


class Tables:
    """A table per substring: the rows of each of its 65,536 values, and the balls to probe them by."""

    BALL = np.argsort(np.bitwise_count(np.arange(1 << SUB_BITS, dtype=np.uint16)), kind="stable").astype(np.uint16)
    BALL_SIZE = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << SUB_BITS, dtype=np.uint16))))

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=1 << SUB_BITS))]) for s in range(codes.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within the Hamming radius. A row that is within it differs by radius // substrings bits or fewer in
        some substring (pigeonhole), so the balls of that radius around each substring miss none."""
        subs = self.codes.shape[1]
        ball = self.BALL[: self.BALL_SIZE[min(SUB_BITS, radius // subs)]]
        if len(ball) >= len(self.codes):  # balls with more keys than there are rows: complete distances are fewer
            return np.flatnonzero(np.bitwise_count(self.codes ^ code).sum(axis=1) <= radius)
        seen = np.zeros(len(self.codes), bool)
        for s in range(subs):
            keys = (ball ^ code[s]).astype(np.int64)
            first, count = self.starts[s][keys], self.starts[s][keys + 1] - self.starts[s][keys]
            full = count > 0
            first, count = first[full], count[full]
            at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            seen[self.order[s][at]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def _best(scored: Iterable[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    """The k best (negated score, id), each id once."""
    out: dict[int, float] = {}
    for s, i in sorted(scored):
        if i not in out:
            out[i] = s
            if len(out) == k:
                break
    return [(s, i) for i, s in out.items()]


def _nearest_in(tables: Tables, x: np.ndarray, members: list[list[int]], radius: int, own: int, v: np.ndarray, code: np.ndarray, k: int):
    """The k best ids among the rows within the radius, which grows until it holds so many or all rows."""
    while True:
        rows, need = tables.within(code, radius), k + 1
        score = x[rows] @ v
        while True:
            # all rows that tie with the last one stay
            top = np.arange(len(rows)) if len(rows) <= need else np.flatnonzero(score >= np.partition(score, -need)[-need])
            found = _best(((-s, i) for s, r in zip(score[top].tolist(), rows[top].tolist(), strict=True) for i in members[r] if i != own), k)
            if len(found) == k or len(top) == len(rows):
                break
            need *= 2
        if len(found) == k or len(rows) == len(x):
            return found
        radius += max(1, SUB_BITS * len(code) // 16)


def _search(codes: dict[int, Codes], k: int):
    def run(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(base) and len(queries):
            own = codes[int(base["dim"].iloc[0])]
            x = np.stack(base["v"].to_numpy()).astype(np.float64)
            q = np.stack(queries["v"].to_numpy()).astype(np.float64)
            tables, qc = Tables(own.codes(x, False)), own.codes(q, True)
            members = base["ids"].tolist()
            for qid, v, c in zip(queries["query_id"].tolist(), q, qc, strict=True):
                found = _nearest_in(tables, x, members, own.radius, qid, v, c, k)
                out["query_id"] += [qid] * len(found)
                out["vec_id"] += [i for _, i in found]
                out["score"] += [-s for s, _ in found]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, sample: int = 20_000,
    target: float = 0.97, shard_rows: int = 1 << 13, query_rows: int = 1 << 13,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, its k nearest by inner product.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id.
    All vectors of an id that repeats are candidates, the id being listed once with its best; it asks with its largest
    vector (by array order). Vectors are compared within their dimension. Fewer than k others: all of them. Ties go to the
    smaller id. Every row is indexed; only the rotations and the radius are learned, from at most about `sample` rows by
    a hash of the id, the dimensions sharing it. Equal vectors are one index entry with their k + 1 smallest ids, which is
    all that a list of k can show of them, so a hot vector costs no more than another. Other columns aren't read.

    Shards of the index (at most about shard_rows entries) meet blocks of queries; each meeting returns its k best and a
    partial top-k joins them. What is within the radius is complete (pigeonhole); what lies beyond is the approximation.
    A shard is copied once per block and a block once per shard, so with sides of equal size the copies are fewest.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = rows.where(fine).withColumn("dim", F.size("v"))
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    # equal vectors: first per salt, then over salts, so that no task gathers all ids of a hot vector
    salted = rows.groupBy("dim", "v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(ids.alias("ids"))
    classes = materialise(salted.groupBy("dim", "v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")), "classes")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    asked = materialise(asked.select(F.col("vec_id").alias("query_id"), F.size("v").alias("dim"), "v"), "asked")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    dims = {r.dim: r for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("scale")).collect()}
    n_asked = {r.dim: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share, least = sample / len(dims), F.element_at("ids", 1)
    chosen = F.pmod(F.xxhash64(least), F.lit(1 << 30)) < _by_dim({d: int((1 << 30) * min(1.0, share / r.n)) for d, r in dims.items()})
    fit: dict[int, list] = {d: [] for d in dims}
    for r in classes.where(chosen).orderBy("dim", least).select("dim", "v").collect():
        fit[r.dim].append(r.v)
    codes = {d: learn_codes(np.array(fit[d], dtype=np.float64).reshape(-1, d), max(float(dims[d].scale), 1e-300), k, target) for d in n_asked}
    shards = _by_dim({d: max(1, -(-dims[d].n // shard_rows)) for d in n_asked})
    blocks = _by_dim({d: max(1, -(-n // query_rows)) for d, n in n_asked.items()})
    each = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    base = classes.where(shards.isNotNull()).select("dim", F.pmod(F.xxhash64(least), shards).cast("int").alias("shard"), each(blocks).alias("block"), "v", "ids")
    asked = asked.select("dim", each(shards).alias("shard"), F.pmod(F.xxhash64("query_id"), blocks).cast("int").alias("block"), "query_id", "v")
    meet = ["dim", "shard", "block"]
    found = base.groupBy(*meet).cogroup(asked.groupBy(*meet)).applyInPandas(_search(codes, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _by_dim(values: dict[int, int]) -> Column:
    """A number by the column dim, null for others."""
    return F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in values.items() for x in pair]), F.col("dim").cast("long"))
