"""SimHash near-dedup: multi-index hashing over fingerprint segments, small Hamming balls, verified distances."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, materialise, release, to_bytes
from .components import components

#: Seed of the shingle hash.
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of UTF-8 text: a bit is 1 if set in over half of the shingles' hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -shingle] + 1).tolist()]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _kernel(shingle: int):
    def make():
        def kernel(texts):
            out = np.array([fingerprint(t, shingle) for t in to_bytes(texts)], dtype=np.uint64)
            return [pa.array(out.view(np.int64))]

        return kernel

    return make


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long. Null and wordless texts have fingerprint 0."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(ids, _kernel(shingle), ["text"], ["doc_id"], [("fp", T.LongType())])


def _segment(fp, k: int, n: int):
    width = 64 // n
    return F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1))


def near_links(prints: DataFrame, segments: int = 4) -> DataFrame:
    """Links (a, b), a < b, that connect the distinct fingerprints of prints(fp, rep) at 2 or fewer differing bits.

    a and b are the reps. Two steps, exact for a radius of 2:
    1. Multi-index tables, one per pair of the 4 segments: two differing bits leave at least two segments
       untouched, so only fingerprints that share a table key with another have a link. Keys are counted, never paired.
    2. In each segment of those left, the ball of radius 1 is enumerated, the other segments being kept. Two
       fingerprints within 2 bits meet in a ball member, and whatever meets there is within 2 bits. A member has 65
       neighbours at most, so each group is bounded by 65 and links go from its first to the others: a large group
       of near copies gives 65 rows per fingerprint, not all its pairs. The complete distance is verified on each link.
    """
    fp = F.col("fp")
    pairs = list(itertools.combinations(range(segments), segments - 2))
    table = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.xxhash64(*[_segment(fp, k, segments) for k in p]).alias("key")) for i, p in enumerate(pairs)]))
    keys = prints.select("fp", "rep", table.alias("x")).select("fp", "rep", "x.t", "x.key")
    shared = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    near = materialise(keys.join(shared, ["t", "key"], "left_semi").select("fp", "rep").distinct(), "near")
    ball = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]))
    members = near.select("fp", "rep", ball.alias("bit")).select(fp.bitwiseXOR(F.col("bit")).alias("member"), "fp", "rep")
    met = members.groupBy("member").agg(F.collect_list(F.struct("rep", "fp")).alias("g")).where(F.size("g") > 1)
    star = met.select(F.array_min("g").alias("x"), F.explode("g").alias("y")).where("x.rep < y.rep")
    ok = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2
    return star.where(ok).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: the smallest id reachable over links of 2 or fewer bits.

    Equal fingerprints are one class with its smallest id as representative; only classes are linked. Wordless
    texts (null, empty) have fingerprint zero and are linked like any other. Rows without an id keep their
    fingerprint, take part in no link and have a null component. Repeated rows come back as often as they came.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    labels = components(near_links(classes)).withColumnRenamed("node", "rep")
    named = materialise(classes.join(labels, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "named")
    release(classes)
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
