"""Near copies by similarity: SimHash codes of many bits, multi-index tables over their segments, distances and sets verified."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_map, map_columns, materialise, release, small, to_bytes
from .components import components
from .simhash import SEED

#: Share of the pairs at exactly the asked similarity that may have no table key in common.
MISS = 0.004
#: Odd multipliers: of the polynomial over the words of a shingle, and of the mixing step.
_POLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int) -> set[bytes]:
    """The set of size-word shingles, case folded as in op9; a shorter text is one shingle, a wordless one has none."""
    words = text.lower().split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of the shingle set: words are hashed once, shingles are polynomials over them."""
    words = text.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    if not size:
        return h
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _POLY + h[k : k + len(out)]
    return np.unique(_mix(out))


@dataclass(frozen=True)
class Tables:
    """Segments of `width` bits, one table each. A code enters a table under its segment and those in the small ball that
    flipping its `flips` least certain bits gives; two codes meet where they differ in such bits only."""

    width: int
    flips: int
    similarity: float

    @property
    def turn(self) -> float:
        """Share of bits in which two sets of the least similarity differ: the angle between their vectors, over pi."""
        return math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi

    @cached_property
    def count(self) -> int:
        """Tables that leave a pair of the least similarity apart with probability MISS; how often one brings it
        together is counted over 40,000 drawn pairs of correlated sums."""
        rng = np.random.default_rng(SEED)
        a, b = rng.standard_normal((2, 40_000, self.width))
        cos = 2 * self.similarity / (1 + self.similarity)
        b = cos * a + math.sqrt(1 - cos * cos) * b
        apart = (a > 0) != (b > 0)
        for x in (a, b):
            np.put_along_axis(apart, np.argsort(np.abs(x), axis=1)[:, : self.flips], False, axis=1)
        p = 1 - apart.any(axis=1).mean()
        return max(1, math.ceil(math.log(MISS) / math.log1p(-min(p, 0.999))))

    @property
    def words(self) -> int:
        return -(-self.width * self.count // 64)

    def most(self, words: int) -> int:
        """Differing bits, of so many words, within which all but one in thirty thousand pairs of the least similarity lie."""
        bits, p = 64 * words, self.turn
        return int(bits * p + 4 * math.sqrt(bits * p * (1 - p)))

    @classmethod
    def of_size(cls, n: int, similarity: float) -> Tables:
        """Segments that grow with the logarithm of the rows, so that a key brings together few unlike codes at any size."""
        width = max(16, math.ceil(math.log2(max(n, 2))) + 5)
        return cls(width, width // 10, similarity)


def bit_sums(hashes: np.ndarray, words: int) -> np.ndarray:
    """Per bit of the code, in how many hashes it is set. A hash is widened to `words` words by multiplying and mixing."""
    multipliers = np.random.default_rng(SEED).integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):
        wide = _mix(hashes[at : at + 255, None] * multipliers)
        total += np.add.reduce(np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return total


def _sketch(size: int, tables: Tables):
    """Per text: the digest and size of its shingle set, its code, and per segment the places of the least certain bits."""

    def make():
        count, width, flips, words = tables.count, tables.width, tables.flips, tables.words

        def kernel(texts):
            sets = [shingle_hashes(t, size) for t in to_bytes(texts)]
            n = np.array([len(s) for s in sets], np.int64)
            digests = [xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets]
            codes, weak = [], []
            for at in range(0, len(sets), 256):
                sums = np.array([bit_sums(s, words) for s in sets[at : at + 256]])
                over = 2 * sums - n[at : at + 256, None]
                codes.append(np.packbits(over > 0, axis=1, bitorder="little").view("<i8"))
                parts = np.abs(over[:, : count * width]).reshape(-1, count, width)
                weak.append(np.argsort(parts, axis=2, kind="stable")[:, :, :flips].astype(np.uint8).reshape(len(over), -1))
            codes, weak = np.concatenate(codes), np.concatenate(weak)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * words), pa.array(codes.ravel()))
            return [pa.array(digests, pa.binary()), pa.array(n), flat, pa.array([w.tobytes() for w in weak], pa.binary())]

        return kernel

    return make


def _keys(tables: Tables):
    """A row per table key of a code: its segment, and those in the ball that flipping the least certain bits gives."""

    def make():
        count, width, flips, words = tables.count, tables.width, tables.flips, tables.words
        powers = np.int64(1) << np.arange(width, dtype=np.int64)
        table = np.arange(count, dtype=np.int64)[:, None] << width
        patterns = (np.arange(1 << flips)[:, None] >> np.arange(flips)) & 1

        def kernel(reps, codes, weak):
            if not len(reps):
                return None
            code = codes.flatten().to_numpy().reshape(-1, words).view(np.uint8)
            at = np.frombuffer(b"".join(weak.to_pylist()), np.uint8).reshape(-1, count, flips)
            bits = np.unpackbits(code, axis=1, bitorder="little")[:, : count * width].reshape(-1, count, width)
            own = np.zeros(bits.shape[:2], np.int64)
            for i in range(width):
                own |= bits[:, :, i].astype(np.int64) << i
            keys = (own[:, :, None] ^ (powers[at] @ patterns.T) | table).reshape(len(own), -1)
            return [pa.array(np.repeat(reps.to_numpy(), keys.shape[1])), pa.array(keys.ravel())]

        return kernel

    return make


def _alike(size: int, similarity: float):
    least = Fraction(str(similarity))

    def make():
        last = [None, None]

        def kernel(left, right):
            out = []
            for a, b in zip(to_bytes(left), to_bytes(right), strict=True):
                if last[0] != a:
                    last[:] = a, shingles(a, size)
                x, y = last[1], shingles(b, size)
                both = len(x & y)
                out.append(both * least.denominator >= least.numerator * (len(x) + len(y) - both))
            return [pa.array(out, pa.bool_())]

        return kernel

    return make


def near_dup_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each id: the smallest id reachable over pairs whose shingle sets have that Jaccard similarity.

    Texts with equal sets are one class, named by its smallest id; wordless texts are such a class. Each class has a SimHash
    code of about a thousand bits. Classes that share a table key are a bucket; the complete distance of two codes is
    verified first, then the sets themselves, so every link is exact. A pair at just the asked similarity has no key in
    common with probability MISS, a closer one with less. Rows without an id take part in no link and aren't listed;
    rows that repeat an id are one node. Other columns aren't read.

    A bucket is compared with one of its members, its pivot, not pairwise: that settles pairs, and buckets in which all come
    to be of one component, so a large group of near copies gives rows in proportion to its size. The texts of the other
    buckets, whichever these are, are joined by prefixes of their shingle sets: only those of different components
    that share a shingle rare enough for them to be similar are compared. That is exact, so all pairs of a bucket are settled.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    tables = Tables.of_size(texts.count(), similarity)
    fields = [("digest", T.BinaryType()), ("n", T.LongType()), ("code", T.ArrayType(T.LongType())), ("weak", T.BinaryType())]
    sketches = materialise(map_columns(texts, _sketch(shingle, tables), ["text"], ["doc_id"], fields), "sketches")
    reps = materialise(sketches.groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
    links = sketches.select("digest", "doc_id").join(reps, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = materialise(links.distinct(), "links")
    own = sketches.join(reps.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi")
    classes = materialise(own.select(F.col("doc_id").alias("rep"), "n", "code", "weak"), "classes")
    buckets = flat_map(classes.where("n > 0"), _keys(tables), ["rep", "code", "weak"], [("rep", T.LongType()), ("key", T.LongType())])
    shared = materialise(buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "shared")
    kept = materialise(buckets.join(shared.hint("merge"), "key", "left_semi"), "buckets")
    pivots = materialise(kept.groupBy("key").agg(F.count("*").alias("m"), F.min(_turned("rep")).alias("p")).select("key", "m", _turned("p").alias("p")), "pivots")
    met = materialise(kept.join(pivots, "key").where("rep <> p"), "met")
    release(shared, kept, pivots)
    first = materialise(_ordered(met.select("rep", "p")), "pairs")
    stars, known = _joined(links, materialise(_links(first, classes, texts, tables, shingle), "links"))
    left = met.where("m > 2").select("key", "rep").join(small(known.withColumnRenamed("node", "rep")), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    left = materialise(left, "left")
    mixed = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    still = materialise(left.join(mixed, "key", "left_semi").select("rep", "component").distinct(), "open")
    release(met, left)
    if still.isEmpty():
        labels = known
    else:
        # what is still open is far less than all
        ends = small(still)
        near = materialise(classes.join(ends, "rep", "left_semi"), "near")
        of = materialise(texts.join(ends.withColumnRenamed("rep", "doc_id"), "doc_id").dropDuplicates(["doc_id"]), "of")
        prefixes = materialise(_prefixes(of, shingle, similarity), "prefixes")
        pairs = materialise(_candidates(prefixes, similarity).join(first, ["a", "b"], "left_anti"), "pairs")
        _, labels = _joined(stars, materialise(_links(pairs, near, of.select("doc_id", "text"), tables, shingle), "links"))
        release(prefixes, pairs, near, of)
    release(classes, reps, first, still)
    ids = sketches.select("doc_id").distinct()
    return ids.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def _joined(links: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of all links, as stars (a, b) and as (node, component). The new links are deleted."""
    labels = materialise(components(links.unionByName(more)), "labels")
    release(more)
    return labels.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b"), labels


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()


def _members(size: int):
    """A row per shingle hash of a text, with the size of its set."""

    def make():
        def kernel(reps, components, texts):
            sets = [shingle_hashes(t, size) for t in to_bytes(texts)]
            n = np.array([len(s) for s in sets], np.int64)
            h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            return [pa.array(np.repeat(x, n)) for x in (reps.to_numpy(), components.to_numpy(), n)] + [pa.array(h.view(np.int64))]

        return kernel

    return make


def _prefixes(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(rep, component, n, h, rest): of each text's set of n shingles those in its prefix that texts of another component
    hold too, with the number of shingles from there on.

    One order holds for all sets: shingles that a single component holds, then the others, the rarest first. Of two
    similar sets of different components, the first common shingle is of the second kind, and all they share is among the
    rest from there on. A set of n that shares at least its least part, similarity * n, has that shingle in its prefix.
    """
    least = Fraction(str(similarity))
    names = [("rep", T.LongType()), ("component", T.LongType()), ("n", T.LongType()), ("h", T.LongType())]
    by_hash = Window.partitionBy("h")
    found = flat_map(texts, _members(size), ["doc_id", "component", "text"], names)
    found = found.withColumns({"held": F.count("*").over(by_hash), "lo": F.min("component").over(by_hash), "hi": F.max("component").over(by_hash)}).where("lo < hi")
    rest = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("held"), "h")).cast("long")
    return found.withColumn("rest", rest).where(F.col("rest") * least.denominator >= F.col("n") * least.numerator).select("rep", "component", "n", "h", "rest")


def _candidates(prefixes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components with a common shingle from which on both sets are large enough to share what the
    similarity asks of their sizes."""
    least = Fraction(str(similarity))
    x, y = prefixes.toDF("a", "c", "n", "h", "i"), prefixes.toDF("b", "d", "m", "h", "j")
    enough = F.least("i", "j") * (least.numerator + least.denominator) >= (F.col("n") + F.col("m")) * least.numerator
    return x.join(y, "h").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & enough).select("a", "b").distinct()


def _turned(name: str) -> Column:
    """An id with some bits turned over, and back: the least by this order is a bucket's pivot, whatever its rank by id."""
    return F.col(name).bitwiseXOR(F.lit(0x2545F4914F6CDD1D))


def _within(x: Column, y: Column, words: int, tables: Tables) -> Column:
    return reduce(lambda s, i: s + F.bit_count(x[i].bitwiseXOR(y[i])), range(words), F.lit(0)) <= tables.most(words)


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, tables: Tables, shingle: int) -> DataFrame:
    """The pairs (a, b) that are similar: sizes and the distance of two words of the codes, then the complete distance, which
    is left to few, then the sets themselves."""
    x, y = F.col("x"), F.col("y")
    some = classes.select("rep", "n", F.slice("code", 1, 2).alias("code"))
    close = pairs.join(some.toDF("a", "n", "x"), "a").join(some.toDF("b", "m", "y"), "b")
    close = close.where(F.greatest("n", "m") * tables.similarity <= F.least("n", "m") + 1e-6).where(_within(x, y, 2, tables)).select("a", "b")
    whole = classes.select("rep", "code")
    first = materialise(close, "close")
    close = first.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b").where(_within(x, y, tables.words, tables))
    close = materialise(close.select("a", "b"), "close")
    release(first)
    ends = close.select(F.col("a").alias("doc_id")).unionByName(close.select(F.col("b").alias("doc_id"))).distinct()
    ends = small(materialise(ends, "ends"))
    near = materialise(texts.join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    sides = close.join(near.toDF("a", "left"), "a").join(near.toDF("b", "right"), "b")
    return map_columns(sides, _alike(shingle, tables.similarity), ["left", "right"], ["a", "b"], [("alike", T.BooleanType())]).where("alike").select("a", "b")
