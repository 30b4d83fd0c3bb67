"""WARC archives: deduplicating writer, and a splittable reader that verifies the chain of record boundaries."""

from __future__ import annotations

import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialise, release, shared_dir

#: The version line that starts a record; the blank lines that end its head, and the record.
MAGIC = b"WARC/1.1\r\n"
HEAD_END = b"\r\n\r\n"
#: Bytes that a row of the tables sent to all tasks takes, at most: file name or digest, and a few numbers.
_ROW = 512
#: Fixed point in time that archives carry, so that equal input gives equal files.
DATE = "2020-01-01T00:00:00Z"


def _head(kind: str, fields: list[tuple[str, Column]]) -> Column:
    parts = [F.lit(MAGIC.decode()), F.lit(f"WARC-Type: {kind}\r\n")]
    for name, value in fields:
        parts.append(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    return F.concat(*parts, F.lit("\r\n"))


def _line(c: Column) -> Column:
    """A header value: never null, no line ends."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\r\n]", " ")


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> str:
    """Write a record per row under path (default: a new folder in the shared one) and return it.

    Of records with equal payloads of `least` bytes or more, the one with the largest id is the response and the
    others are revisits of it, without a payload. A null payload is empty, a null url an empty header; rows without an
    id come with an empty id, are responses and are nobody's response. Rows that repeat an id and payload are alike.
    Digests, not payloads, are grouped: a hot payload is counted after map-side combination. The revisits' ids are sent to
    all tasks where their counted size is under the broadcast bound; beyond it, payloads are shuffled once, by id.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    long = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", F.sha1(F.col("payload").cast("binary")).alias("digest"))
    groups = long.groupBy("digest").agg(F.max("page_id").alias("ref"), F.min("page_id").alias("least")).where("ref > least").select("digest", "ref")
    again = long.join(groups, "digest").where("page_id < ref").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again"), "ref").distinct()
    again = materialise(again, "again")
    if again.count() * _ROW <= BROADCAST_BYTES:
        again = F.broadcast(again)
    joined = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).join(again, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again")), "left")
    rid = lambda c: F.concat(F.lit("<urn:page:"), _line(c), F.lit(">"))
    common = [("WARC-Record-ID", rid(F.col("page_id"))), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", _line(F.col("url"))), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Payload-Length", F.octet_length("payload").cast("string"))]
    response = F.concat(_head("response", [*common, ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.octet_length("payload").cast("string"))]), F.col("payload"))
    revisit = _head("revisit", [*common, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", rid(F.col("ref"))), ("Content-Length", F.lit("0"))])
    joined.select(F.when(F.col("ref").isNull(), response).otherwise(revisit).alias("value")).write.option("lineSep", HEAD_END.decode()).text(path)
    return path


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def _head_of(raw: bytes) -> tuple[int, int]:
    """Size of a record's head after its version line, and the length it claims; -1 for both if it isn't one."""
    end = raw.find(HEAD_END)
    m = _LENGTH.search(raw, 0, end + 2) if end >= 0 else None
    return (end + 4, int(m[1])) if m else (-1, -1)


def _candidates(batches):
    """Pieces between version lines -> candidates: where they are in their split, and what their head claims."""
    at, rel = None, 0
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        for f, k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (f, k) != at:
                at, rel = (f, k), 0
            raw = raw or b""
            for c, v in zip(out, (f, k, rel, len(raw), *_head_of(raw)), strict=True):
                c.append(v)
            rel += len(raw) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.string(), *[pa.int64()] * 5], strict=True)], names=["file", "block", "rel", "size", "head", "length"])


def _pieces(batches):
    """Pieces in order, with what is known of their split -> pieces of records: each with its record's start and end.

    A piece starts a record if chains enter the split there or the record before it ends there; it goes on with that
    record if it starts before its end; else nothing reaches it.
    """
    names = ["file", "record", "until", "file_end", "start", "alone", "raw"]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.binary()]
    at, now, rel, enter = None, None, 0, frozenset()
    for b in batches:
        out: list[list] = [[] for _ in names]
        cols = [b.column(n).to_pylist() for n in ("file", "block", "value", "base", "file_end", "entries", "c_start", "c_until")]
        for f, k, raw, base, end, entries, c_start, c_until in zip(*cols, strict=True):
            if (f, k) != at:
                at, rel, enter = (f, k), 0, frozenset(entries or ())
                now = (c_start, c_until) if c_start is not None else None
            raw = raw or b""
            start = base + rel - len(MAGIC)
            rel += len(raw) + len(MAGIC)
            if start >= 0 and (start in enter or now is not None and start == now[1]):
                head, length = _head_of(raw)
                now = (start, start + len(MAGIC) + head + length + len(HEAD_END) if head >= 0 else -1)
            elif now is None or start >= now[1]:
                continue
            alone = start == now[0] and start + len(MAGIC) + len(raw) >= min(now[1], end)
            for c, v in zip(out, (f, *now, end, start, alone, raw), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


def _exits(part):
    """Within a split: where each candidate's chain leaves it (the first offset that isn't a candidate here)."""
    part = part.sort_values("start")
    to = dict(zip(part["start"].tolist(), part["next"].tolist(), strict=True))
    out: dict[int, int] = {}
    for s in sorted(to, reverse=True):
        n = to[s]
        out[s] = out.get(n, n) if n > s else -1
    part["exit"] = [out[s] for s in part["start"].tolist()]
    return part[["file", "block", "start", "next", "exit"]]


def _last(part):
    """Within a split: its reached entries, and the last candidate on the chains from them."""
    to = dict(zip(part["start"].tolist(), part["next"].tolist(), strict=True))
    entries = part.loc[part["entry"], "start"].tolist()
    seen = set()
    for s in entries:
        while s in to and s not in seen:
            seen.add(s)
            s = to[s] if to[s] > s else -1
    last = max(seen, default=None)
    out = {"file": part["file"].iloc[0], "block": part["block"].iloc[0], "entries": entries, "last": None if last is None else (last, to[last])}
    return pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in out.items()})


def read_warc(spark: SparkSession, path: str, max_rounds: int = 40) -> DataFrame:
    """Records of the archives under path: file, offset, head (string), payload (binary), complete (boolean).

    Files are split anywhere. A task cuts its split at version lines, and each piece is a candidate for a record with
    the successor that its Content-Length claims. Payloads may hold version lines, so candidates prove nothing: only
    those are kept that the chain of successors reaches from the start of their file. Within a split the chain is
    followed in place; between splits, by pointer jumping over the entries, in rounds that double the distance. A
    record whose successor is neither a candidate nor the end of its file ends its chain and is marked incomplete, as
    is one whose file ends early; what follows is unreachable. A file that doesn't begin with a version line has no
    records. Offsets come from the pieces' sizes, so no task reads more than its split and no file is gathered. Chains that
    still grow after max_rounds (2 ** max_rounds splits) are an error.
    """
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    slim = materialise(pieces.mapInArrow(_candidates, "file string, block long, rel long, size long, head long, length long"), "candidates")
    # where splits begin: sums of the sizes before them; a row per split
    m = len(MAGIC)
    totals = slim.groupBy("file", "block").agg(F.sum(F.col("size") + m).alias("bytes"))
    base = totals.select("file", "block", F.coalesce(F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), (F.sum("bytes").over(W.partitionBy("file")) - m).alias("file_end"))
    placed = slim.join(base, ["file", "block"]).withColumn("start", F.col("base") + F.col("rel") - m)
    # the piece before a file's first version line is no candidate
    edges = placed.where("start >= 0").select("file", "block", "start", F.when(F.col("head") >= 0, F.col("start") + m + F.col("head") + F.col("length") + len(HEAD_END)).otherwise(-1).alias("next"))
    edges = materialise(edges, "edges")
    kinds = "file string, block long, start long, next long"
    exits = materialise(edges.select("file", "block", "start", "next").groupBy("file", "block").applyInPandas(_exits, kinds + ", exit long"), "exits")
    # entries: file starts, and where chains leave a split to; a candidate can be one only if some chain ends there
    outs = exits.select("file", F.col("exit").alias("start")).where("start > 0").distinct()
    starts = exits.where("start = 0").select("file", "start")
    hops = materialise(exits.join(outs.unionByName(starts).distinct(), ["file", "start"], "left_semi").select("file", "start", "exit"), "hops")
    reached = materialise(starts, "reached")
    n = reached.count()
    jump = hops
    for _ in range(max_rounds):
        more = reached.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start"))
        step = materialise(reached.unionByName(more.join(hops, ["file", "start"], "left_semi")).distinct(), "reached")
        release(reached)
        reached, now = step, step.count()
        if now == n:
            break
        n = now
        farther = materialise(jump.alias("x").join(jump.alias("y"), (F.col("x.file") == F.col("y.file")) & (F.col("x.exit") == F.col("y.start"))).select("x.file", "x.start", "y.exit"), "jump")
        if jump is not hops:
            release(jump)
        jump = farther
    else:
        raise RuntimeError(f"chains of records still grow after {max_rounds} rounds")
    if jump is not hops:
        release(jump)
    entries = reached.withColumn("entry", F.lit(True))
    on = exits.select("file", "block", "start", "next").join(entries, ["file", "start"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    last = on.groupBy("file", "block").applyInPandas(_last, "file string, block long, entries array<long>, last struct<start:long,next:long>")
    before = F.last("last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    splits = base.join(last, ["file", "block"], "left").select("file", "block", "base", "file_end", "entries", before.alias("open"))
    splits = materialise(splits.select("file", "block", "base", "file_end", "entries", F.col("open.start").alias("c_start"), F.col("open.next").alias("c_until")), "splits")
    release(slim, edges, hops, reached)
    if splits.count() * _ROW <= BROADCAST_BYTES:  # pieces stay in the order in which their task reads them
        known = pieces.join(F.broadcast(splits), ["file", "block"])
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        known = pieces.withColumn("__at", F.monotonically_increasing_id()).join(splits, ["file", "block"]).repartition(parts, "file", "block").sortWithinPartitions("file", "block", "__at").drop("__at")
    cut = known.mapInArrow(_pieces, "file string, record long, until long, file_end long, start long, alone boolean, raw binary")
    one = cut.where("alone").select("file", "record", "until", "file_end", "raw")
    many = cut.where("not alone").groupBy("file", "record").agg(F.min("until").alias("until"), F.min("file_end").alias("file_end"), F.sort_array(F.collect_list(F.struct("start", "raw"))).alias("p"))
    glued = F.aggregate(F.slice("p", 2, F.size("p") - 1), F.element_at("p", 1)["raw"], lambda acc, x: F.concat(acc, F.lit(MAGIC), x["raw"]))
    raw = one.unionByName(many.select("file", "record", "until", "file_end", glued.alias("raw")))
    return raw.mapInArrow(_record, "file string, offset long, head string, payload binary, complete boolean")


def _record(batches):
    for b in batches:
        out: list[list] = [[], [], []]
        for raw, start, until, end in zip(b.column("raw").to_pylist(), b.column("record").to_pylist(), b.column("until").to_pylist(), b.column("file_end").to_pylist(), strict=True):
            k = raw.find(HEAD_END)
            head, body = (raw[:k], raw[k + 4 :]) if k >= 0 else (raw, b"")
            size = until - start - len(MAGIC) - len(head) - 2 * len(HEAD_END)
            out[0].append(head.decode("utf-8", "replace"))
            out[1].append(body[: max(0, size)])
            out[2].append(until >= 0 and until <= end and body[size:].startswith(HEAD_END))
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("record"), pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.bool_())], names=["file", "offset", "head", "payload", "complete"])


def header(head: Column, name: str) -> Column:
    """A header's value, null if it isn't there."""
    got = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(got != "", got)


def warc_index(records: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's payload figures
    are those its head carries, a response's are taken from the payload read."""
    page = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    kind = header(F.col("head"), "WARC-Type")
    full = kind == "response"
    return records.where("complete").select(
        page(header(F.col("head"), "WARC-Record-ID")).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(header(F.col("head"), "WARC-Payload-Length").cast("long")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.substring_index(header(F.col("head"), "WARC-Payload-Digest"), ":", -1)).alias("payload_digest"),
        kind.alias("record_type"), page(header(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
    )
