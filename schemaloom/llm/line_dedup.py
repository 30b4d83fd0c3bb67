"""Line dedup: explode normalised lines, hash them, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_map, map_columns, materialise, small, to_bytes

#: What a line's key loses at both ends; str.strip() of bytes takes the same set.
_BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line: stripped, A-Z lower-cased; None if it has under min_chars code points."""
    key = line.strip(_BLANK).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _explode(min_chars: int):
    def make():
        def kernel(ids, texts):
            doc, out = [], []
            for i, t in zip(ids.to_pylist(), to_bytes(texts), strict=True):
                if i is None:
                    continue
                keys = {k for k in (line_key(x, min_chars) for x in t.split(b"\n")) if k is not None}
                out += [xxhash.xxh3_128_digest(k) for k in keys]
                doc += [i] * len(keys)
            if not doc:
                return None
            h = np.frombuffer(b"".join(out), dtype=np.int64).reshape(-1, 2)
            return [pa.array(doc, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]

        return kernel

    return make


def _keep(min_chars: int):
    def make():
        def kernel(texts, drops):
            kept, n_lines, n_dropped = [], [], []
            for t, d in zip(to_bytes(texts), drops.to_pylist(), strict=True):
                lines = t.split(b"\n")
                n_lines.append(len(lines))
                if d:
                    gone = {struct.pack("<qq", x["h1"], x["h2"]) for x in d}
                    left = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                else:
                    left = lines
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]

        return kernel

    return make


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of docs, the text without its frequent lines, and n_lines and n_dropped.

    A line whose key has min_chars code points or more and occurs in min_docs documents or more stays only in the
    largest id that holds it (all its copies there). Null and empty texts are one empty line, and come back as
    empty. Rows that repeat an id are one document for the count and are each cut alike. Rows without an id don't
    count and keep all lines. Input columns called n_lines or n_dropped are replaced.

    Column names that begin with __line are taken here and must not be docs' own.

    Plan: 24-byte hash rows are shuffled (never lines); a hot line is counted after map-side combination. The frequent
    lines are sent to all tasks if they are counted to be few, so that a hot line's rows stay where they are; else both
    sides of that join are shuffled as they are, which lets adaptive execution split a hot key. The text is shuffled
    once, by id, to meet the hashes it loses.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = flat_map(ids, _explode(min_chars), ["doc_id", "text"], [("doc", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType())])
    lines = materialise(lines, "lines")
    by_doc = lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    often = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", "last")
    often = small(materialise(often, "often"))
    gone = lines.join(often, ["h1", "h2"]).where("doc <> last").groupBy(F.col("doc").alias("__line_doc")).agg(F.collect_set(F.struct("h1", "h2")).alias("__line_gone"))
    joined = docs.join(gone, F.col(id_col).cast("long") == F.col("__line_doc"), "left").drop("__line_doc")
    return map_columns(joined, _keep(min_chars), [text_col, "__line_gone"], docs.columns, [(text_col, T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())]).select(*[f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
