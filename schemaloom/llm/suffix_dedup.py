"""Suffix dedup: bytes covered by long strings that start elsewhere too, by merging shards' sparse suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_map, map_columns, materialise, release, small, to_bytes

#: Odd multiplier of the rolling hash, and a random value per byte.
_R = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that a kernel handles at a time (a longer document is one piece), and bytes hashed for sampling.
_PIECE, _GRAM = 1 << 20, 24


def layout(length: int) -> tuple[int, int]:
    """(window, core): a string of `length` bytes is sampled at one of `window` offsets, and holds the `core` bytes from there."""
    window = max(1, length * 21 // 50)
    return window, length - window + 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n + 1, _R, np.uint64))
        down = np.cumprod(np.full(n + 1, pow(_R, -1, 1 << 64), np.uint64))
    return up, down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding_min(c: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(c)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([c, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Sampled suffixes of texts: arrays (text, anchor, first, last, core hash) for each piece.

    Each string of `length` bytes is assigned to the position, among its first `window`, of the least hashed gram
    (the first of equals). That depends on the string's bytes alone, so equal strings meet at equal offsets. An anchor
    serves the strings that start at first..last; all of them hold the core that starts at it.
    """
    window, core = layout(length)
    gram = min(core, _GRAM)
    group: list[int] = []
    size = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size + len(texts[i]) > _PIECE:
            if group:
                yield _anchors([texts[j] for j in group], np.array(group), length, window, core, gram)
            group, size = [], 0
        if i < len(texts) and len(texts[i]) >= length:
            group.append(i)
            size += len(texts[i])


def _anchors(texts, ids, length, window, core, gram):
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    up, down = _powers(max(_PIECE, 1 << (n - 1).bit_length()))
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * up[:n])])
        h = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        bits = np.uint64(max(20, n.bit_length()))
        c = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min(c, window)[: n - length + 1] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        for e in ends[:-1]:
            at[max(0, e - length + 1) : e] = -1  # strings don't cross documents
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        ok = at[first] >= 0
        first, last = first[ok], last[ok]
        a = at[first]
        hashes = _mix((sums[a + core] - sums[a]) * down[a])
    doc = np.searchsorted(ends, a, side="right")
    base = starts[doc]
    return ids[doc], a - base, first - base, last - base, hashes.view(np.int64)


def _cores(length: int):
    """Pass 1: each text's distinct cores, and whether one comes twice in it."""

    def make():
        def kernel(tk, texts):
            texts, tk = to_bytes(texts), tk.to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for doc, _, _, _, h in anchors(texts, length):
                order = np.lexsort((h, doc))
                d, x = doc[order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])]))
                out.append((x[new], tk[d[new]], np.diff(np.concatenate([new, [len(x)]])) > 1))
            if not out:
                return None
            return [pa.array(np.concatenate([o[k] for o in out])) for k in range(3)]

        return kernel

    return make


_MEMBER = [(n, T.LongType()) for n in ("c1", "c2", "u1", "u2", "id", "tk", "a")] + [("dmin", T.IntegerType()), ("dmax", T.IntegerType()), ("left", T.BinaryType()), ("right", T.BinaryType())]


def _members(length: int):
    """Pass 2: the anchors whose core may be repeated, with what their strings hold on both sides of it."""
    _, core = layout(length)

    def make():
        def kernel(ids, tks, texts, hots):
            texts, ids, tks = to_bytes(texts), ids.to_pylist(), tks.to_pylist()
            hots = [np.array(x or [], np.int64) for x in hots.to_pylist()]
            digests, rows, left, right = [], [], [], []
            for doc, a, first, last, h in anchors(texts, length):
                for i in np.unique(doc).tolist():
                    lo, hi = np.searchsorted(doc, [i, i + 1])
                    t = texts[i]
                    for k in (np.flatnonzero(np.isin(h[lo:hi], hots[i])) + lo).tolist():
                        p, f, g = int(a[k]), int(first[k]), int(last[k])
                        x, y = t[f:p][::-1], t[p + core : g + length]
                        c = xxhash.xxh3_128_digest(t[p : p + core])
                        digests.append(c + xxhash.xxh3_128_digest(b"%d,%d," % (p - g, p - f) + c + x + y))
                        rows.append((ids[i], tks[i], p, p - g, p - f))
                        left.append(x)
                        right.append(y)
            if not rows:
                return None
            d, r = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 4), np.array(rows, np.int64)
            return [*(pa.array(d[:, k].copy()) for k in range(4)), *(pa.array(r[:, k].copy()) for k in range(3)), *(pa.array(r[:, k].astype(np.int32)) for k in (3, 4)), pa.array(left, pa.binary()), pa.array(right, pa.binary())]

        return kernel

    return make


def refine(group: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Interleave refinement: intervals of rows that share a group and their first 0, 1, 2, ... bytes.

    group gives the first interleaving. Each round reads one more byte and parts each interval that is still repeated,
    in place; rows alone in theirs (and rows that end) leave, so their longest common prefix is the round before. No
    suffix is sorted anew. Returns, per depth, each row's interval, or -1 for rows that have left.
    """
    m, out = len(group), []
    _, inverse, counts = np.unique(group, return_inverse=True, return_counts=True)
    act = np.flatnonzero(counts[inverse] > 1)
    rank = inverse[act].astype(np.int64)
    for depth in range(text.shape[1] + 1):
        if depth:
            here = sizes[act] >= depth
            act, rank = act[here], rank[here]
            _, inverse, counts = np.unique(rank << 8 | text[act, depth - 1], return_inverse=True, return_counts=True)
            here = counts[inverse] > 1 if len(act) else np.zeros(0, bool)
            act, rank = act[here], inverse[here].astype(np.int64)
        row = np.full(m, -1, np.int64)
        row[act] = rank
        out.append(row)
    return out


def repeated(group, left, right, dmin, dmax, many, reach: int) -> np.ndarray:
    """For each class of equal contexts: at which offsets d its string is repeated, in another class or (many) its own.

    left holds the bytes before the core, nearest first; right those after it. The string at d has d bytes of the one
    and reach - d of the other, so it is repeated where the left interval at depth d and the right one at reach - d
    have another class in common.
    """
    m = len(group)

    def matrix(parts):
        x = np.zeros((m, reach), np.uint8)
        for i, b in enumerate(parts):
            x[i, : len(b)] = np.frombuffer(b, np.uint8)
        return x, np.fromiter(map(len, parts), np.int64, m)

    ls, rs = refine(group, *matrix(left)), refine(group, *matrix(right))
    out = np.zeros((m, reach + 1), bool)
    for d in range(reach + 1):
        x, y = ls[d], rs[reach - d]
        act = np.flatnonzero((x >= 0) & (y >= 0) & (dmin <= d) & (d <= dmax))
        if len(act):
            _, inverse, counts = np.unique(x[act] << 32 | y[act], return_inverse=True, return_counts=True)
            out[act[counts[inverse] > 1], d] = True
    d = np.arange(reach + 1)
    return out | (many[:, None] & (dmin[:, None] <= d) & (d <= dmax[:, None]))


def _spans(rep: np.ndarray, of: np.ndarray, a: np.ndarray, length: int):
    """Byte ranges of rows (their class `of`, their anchor): (row, start, end)."""
    edge = np.diff(np.pad(rep.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    cls, d1 = np.nonzero(edge == 1)
    _, d2 = np.nonzero(edge == -1)
    n = np.bincount(cls, minlength=len(rep))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    row = np.repeat(np.arange(len(of)), n[of])
    run = np.repeat(first[of] - np.concatenate([[0], np.cumsum(n[of])])[:-1], n[of]) + np.arange(len(row))
    return row, a[row] - (d2[run] - 1), a[row] - d1[run] + length


def _solve(length: int, at_once: int = 20_000):
    """Over rows sorted by core and context: whole groups at a time, the last open one carried on."""
    reach = layout(length)[0] - 1

    def work(t: pa.Table) -> pa.RecordBatch | None:
        c = np.stack([t.column(k).to_numpy() for k in ("c1", "c2", "u1", "u2")])
        new_core = np.concatenate([[True], (c[:2, 1:] != c[:2, :-1]).any(0)])
        new = new_core | np.concatenate([[True], (c[2:, 1:] != c[2:, :-1]).any(0)])
        of, first = np.cumsum(new) - 1, np.flatnonzero(new)
        group, counts = np.cumsum(new_core)[first], np.bincount(of)
        head = t.take(pa.array(first))
        rep = repeated(group, head["left"].to_pylist(), head["right"].to_pylist(), head["dmin"].to_numpy(), head["dmax"].to_numpy(), counts > 1, reach)
        row, s, e = _spans(rep, of, t.column("a").to_numpy(), length)
        ids = t.select(["id", "tk"]).take(pa.array(row)).combine_chunks()
        if not len(row):
            return None
        return pa.RecordBatch.from_arrays([ids["id"].combine_chunks(), ids["tk"].combine_chunks(), pa.array(s), pa.array(e)], names=["id", "tk", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < at_once:
                continue
            t = pa.Table.from_batches(held)
            c1, c2 = t.column("c1").to_numpy(), t.column("c2").to_numpy()
            cut = int(np.flatnonzero((c1 == c1[-1]) & (c2 == c2[-1]))[0])  # equal cores are neighbours
            if cut:
                if (out := work(t.slice(0, cut).combine_chunks())) is not None:
                    yield out
                held = t.slice(cut).combine_chunks().to_batches()
        if held and (out := work(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return run


def _strings(length: int):
    """Hot cores: a key for each string of a class."""
    reach = layout(length)[0] - 1

    def make():
        def kernel(c1, c2, u1, u2, n, dmin, dmax, left, right):
            keys, back = [], []
            for i, (p, q, lo, hi, x, y) in enumerate(zip(c1.to_pylist(), c2.to_pylist(), dmin.to_pylist(), dmax.to_pylist(), left.to_pylist(), right.to_pylist(), strict=True)):
                head = b"%d,%d," % (p, q)
                for d in range(lo, hi + 1):
                    keys.append(xxhash.xxh3_128_digest(b"%s%d," % (head, d) + x[:d] + y[: reach - d]))
                    back.append((i, d))
            if not keys:
                return None
            k, b = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2), np.array(back, np.int64)
            take = pa.array(b[:, 0])
            return [pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), u1.take(take), u2.take(take), n.take(take), pa.array(b[:, 1].astype(np.int32))]

        return kernel

    return make


def _runs(offsets: Column) -> Column:
    """Runs (lo, hi) of neighbouring offsets in an array of distinct ones."""
    at = F.array_sort(offsets)
    first = F.filter(at, lambda d: ~F.array_contains(at, d - 1))
    last = F.filter(at, lambda d: ~F.array_contains(at, d + 1))
    return F.zip_with(first, last, lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))


def _cut():
    def kernel(texts, spans):
        removed, runs, kept = [], [], []
        for t, s in zip(to_bytes(texts), spans.to_pylist(), strict=True):
            merged: list[list[int]] = []
            for x in sorted((x["s"], x["e"]) for x in s or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append([*x])
            at, out = 0, []
            for a, b in merged:
                out.append(t[at:a])
                at = b
            out.append(t[at:])
            kept.append(b"".join(out))
            removed.append(merged)
            runs.append(len(merged))
        gone = [sum(b - a for a, b in m) for m in removed]
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        return [pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]

    return kernel


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot_rows: int = 20_000, with_texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, removed (byte ranges) and kept (binary).

    Removed is each byte covered by a string of `length` bytes that starts anywhere else too: in another row, or at
    another place of the same one, overlaps included. Strings are judged on the input. Null is empty; shorter texts
    lose nothing; rows that repeat an id are documents of their own, and so are rows without one. What is left is bytes,
    as a cut may split a character. Result names replace input columns; other columns aren't returned.

    1. Equal texts are found by digest: with `length` bytes or more they are removed whole, and one of them stands for
       all below. 2. Of all suffixes, those at anchors are kept (see anchors()), about one in window / 2 bytes; cores that
       occur once are dropped after a count. 3. What is left of all shards is brought together by core, and intervals of
       equal cores are refined byte by byte to the right (common prefixes) and to the left (the characters before each
       suffix, as in a Burrows-Wheeler transform); equal strings are those in a common interval on both sides.
    Groups of over hot_rows anchors with one core aren't gathered: their distinct contexts, combined map-side, give a
    key per string, and the keys are counted; the rows themselves stay in place where the hot cores and contexts are
    counted to be few enough to be sent to all tasks. Digests of 128 bits stand for cores and contexts.
    """
    no_id = F.lit(-(1 << 63)).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("md", F.md5(F.col("text").cast("binary"))).withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), no_id), "tk": F.conv(F.substring("md", 1, 15), 16, 10).cast("long")})
    slim = base.where(F.octet_length("text") >= length).select("id", "tk", "md", F.octet_length("text").cast("long").alias("n"))
    texts = materialise(slim.groupBy("md").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.min("tk").alias("tk"), F.min("n").alias("n")), "texts")
    cores = materialise(flat_map(base.select("tk", "text"), _cores(length), ["tk", "text"], [("h", T.LongType()), ("tk", T.LongType()), ("twice", T.BooleanType())]), "cores")
    again = cores.groupBy("h").agg(F.min("tk").alias("t1"), F.max("tk").alias("t2"), F.max("twice").alias("twice")).where("t1 <> t2 or twice").select("h")
    hot = cores.join(again, "h").groupBy("tk").agg(F.collect_set("h").alias("hot"))
    hot = hot.join(texts.select("tk", "id"), "tk").select(F.col("tk").alias("tk2"), F.col("id").alias("id2"), "hot")
    picked = base.select("id", "tk", "text").join(hot, (F.col("id") == F.col("id2")) & (F.col("tk") == F.col("tk2"))).select("id", "tk", "text", "hot")
    members = materialise(flat_map(picked, _members(length), ["id", "tk", "text", "hot"], _MEMBER), "members")
    release(cores)
    big = materialise(members.groupBy("c1", "c2").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("c1", "c2"), "big")
    n_big = big.count()
    out_type = "id long, tk long, s long, e long"
    cold, hot_cores = members, small(big, 100_000)
    if n_big:
        cold = members.join(hot_cores, ["c1", "c2"], "left_anti").select(members.columns)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = cold.repartition(parts, "c1", "c2").sortWithinPartitions("c1", "c2", "u1", "u2").select("c1", "c2", "u1", "u2", "id", "tk", "a", "dmin", "dmax", "left", "right").mapInArrow(_solve(length), out_type)
    if n_big:
        rows = members.join(hot_cores, ["c1", "c2"], "left_semi")
        classes = rows.groupBy("u1", "u2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("c1", "c2", "dmin", "dmax", "left", "right")])
        keys = [("k1", T.LongType()), ("k2", T.LongType()), ("u1", T.LongType()), ("u2", T.LongType()), ("n", T.LongType()), ("d", T.IntegerType())]
        strings = materialise(flat_map(classes, _strings(length), ["c1", "c2", "u1", "u2", "n", "dmin", "dmax", "left", "right"], keys), "strings")
        twice = strings.groupBy("k1", "k2").agg(F.sum("n").alias("all")).where("all > 1").select("k1", "k2")
        found = strings.join(twice, ["k1", "k2"], "left_semi").groupBy("u1", "u2").agg(_runs(F.collect_set("d")).alias("runs"))
        found = small(materialise(found, "found"))
        hit = rows.select("u1", "u2", "id", "tk", "a").join(found, ["u1", "u2"]).select("id", "tk", "a", F.explode("runs").alias("r"))
        spans = spans.unionByName(hit.select("id", "tk", (F.col("a") - F.col("r.hi")).alias("s"), (F.col("a") - F.col("r.lo") + length).alias("e")))
    several = small(materialise(texts.where("copies > 1").select("md"), "several"))
    copies = slim.join(several, "md").select("id", "tk", F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))
    gone = spans.unionByName(copies).groupBy("id", "tk").agg(F.collect_set(F.struct("s", "e")).alias("spans")).select(F.col("id").alias("id2"), F.col("tk").alias("tk2"), "spans")
    joined = base.join(gone, (F.col("id") == F.col("id2")) & (F.col("tk") == F.col("tk2")), "left").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text", "spans")
    fields = [("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("removed", T.ArrayType(T.ArrayType(T.LongType()))), ("kept", T.BinaryType())]
    if with_texts:
        return map_columns(joined, _cut, ["text", "spans"], ["doc_id", "n_bytes"], fields)
    return map_columns(joined, lambda: (lambda k: lambda t, s: k(t, s)[:3])(_cut()), ["text", "spans"], ["doc_id", "n_bytes"], fields[:3])
