"""Benchmark decontamination: prefix-filtered set join of item windows against documents, exact verification."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, flat_map, map_columns, materialise, to_bytes

#: Bytes outside words become spaces, A-Z become a-z: words are digits, letters and all beyond ASCII.
_WORD_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class WindowIndex:
    """Windows of items under their rarest word.

    A document contains a window only if it contains all its words, so the prefix that a containment join must
    index is one word: the first in the global order by rarity. A hit of that word at position i allows a window
    whose rare word sits at offset k only where 0 <= i - k and i - k + length <= n_words (positional and length
    bounds). What is left is compared word for word over the window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], rarity: dict[bytes, int], size: int):
        self.size = size
        self.items: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for name, words in items:
            for i in range(max(1, len(words) - size + 1) if words else 0):
                self.items[tuple(words[i : i + size])].add(name)
        places: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for w in self.items:
            k = min(range(len(w)), key=lambda j: (rarity.get(w[j], 0), w[j], j))
            places[w[k]].add((k, len(w)))
        self.places = {w: sorted(p) for w, p in places.items()}
        self.rare = frozenset(places)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges, in order and disjoint, and the names of the items found."""
        if self.rare.isdisjoint(words):
            return [], set()
        found, names, n, places = [], set(), len(words), self.places
        for i, w in enumerate(words):
            if w in places:
                for k, size in places[w]:
                    a = i - k
                    if a >= 0 and a + size <= n and (got := self.items.get(tuple(words[a : a + size]))):
                        found.append((a, a + size))
                        names |= got
        return merge_ranges(found), names


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _frequency(vocabulary: frozenset[bytes]):
    def make():
        def kernel(texts):
            c = Counter()
            for t in to_bytes(texts):
                c.update(vocabulary.intersection(words_of(t)))
            return [pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())]

        return kernel

    return make


def _search(index: WindowIndex):
    def make():
        def kernel(texts):
            n_words, ranges, names = [], [], []
            for t in to_bytes(texts):
                words = words_of(t)
                r, got = index.search(words)
                n_words.append(len(words))
                ranges.append([x for ab in r for x in ab])
                names.append(sorted(got))
            return [pa.array(n_words, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]

        return kernel

    return make


def _digest(share: int):
    def make():
        def kernel(n_words, ranges, names):
            hit, n_items, sha, bad = [], [], [], []
            for n, r, got in zip(n_words.to_pylist(), ranges.to_pylist(), names.to_pylist(), strict=True):
                h = sum(b - a for a, b in merge_ranges(list(zip(r[::2], r[1::2], strict=True))))
                got = sorted(set(got))
                hit.append(h)
                n_items.append(len(got))
                sha.append(hashlib.sha256(",".join(got).encode()).hexdigest())
                bad.append(h > 0 and share * h >= n)
            return [pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_())]

        return kernel

    return make


def _blocks(items: DataFrame, bound: int) -> list[DataFrame]:
    """The items in as many blocks as keep the text of each under the bound (a single item may exceed it)."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // bound))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", size: int = 13, share: int = 20, bound: int = BROADCAST_BYTES // 8,
) -> DataFrame:
    """All columns of docs and n_words, n_hit, n_items, items (sorted array), items_sha256, contaminated.

    A document is contaminated if n_hit > 0 and share * n_hit >= n_words. Null and wordless texts have no words and
    no hits. Items with null or wordless texts match nothing; rows that repeat an item count once; an item with a null
    id is named "null". An empty benchmark gives zeros. Result names replace input columns of the same name.

    Plan: document frequencies of the benchmark's words (one scan, map-side counters), then one scan per block of
    items whose text is under `bound` bytes, which is what makes shipping a block's index to the tasks safe; one block
    is the rule and needs no shuffle. With more blocks, the documents' ranges and names are united per block in turn.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = _blocks(items, bound)
    out, keep = docs, list(docs.columns)
    for b, block in enumerate(blocks):
        rows = [(r.item_id, words_of(r.text.encode())) for r in block.distinct().collect()]
        vocabulary = frozenset(w for _, ws in rows for w in ws)
        seen = flat_map(docs.select(F.col(text_col).alias("text")), _frequency(vocabulary), ["text"], [("w", T.BinaryType()), ("n", T.LongType())])
        rarity = {bytes(r.w): r.n for r in seen.groupBy("w").agg(F.sum("n").alias("n")).collect()} if vocabulary else {}
        found = [("n_words", T.LongType()), ("__ranges", T.ArrayType(T.LongType())), ("__names", T.ArrayType(T.StringType()))]
        part = map_columns(out, _search(WindowIndex(rows, rarity, size)), [text_col], out.columns, found)
        if b:
            part = part.withColumn("__ranges", F.concat("__ranges", "__r0")).withColumn("__names", F.array_union("__names", "__n0")).drop("__r0", "__n0")
        if b + 1 < len(blocks):
            part = materialise(part.withColumnsRenamed({"__ranges": "__r0", "__names": "__n0"}), "block")
        out = part
    made = [("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]
    out = map_columns(out, _digest(share), ["n_words", "__ranges", "__names"], [*out.columns], made)
    return out.withColumn("items", F.array_sort("__names")).drop("__ranges", "__names").select(*[f"`{c}`" for c in keep if c not in ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")], "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")
