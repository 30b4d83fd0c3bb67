"""Quality: co-training of a text-content view and a page-metadata view, calibrated and combined."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import fit_isotonic, fit_trees
from .common import map_columns, materialise, release, to_bytes
from .labelled import held_out, training_labels

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_BLANK = b" \t\n\x0b\x0c\r"
_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) for b in range(256))
_TAIL = re.compile(rb"[^\sA-Za-z0-9\x80-\xff.,;:?!'\")]{2,}")

CONTENT = [
    "log_words", "caps", "digits", "symbols", "blanks", "word_length", "kinds", "top_word", "repeats", "lower_twins",
    "double_marks", "symbol_tails", "lone_symbols", "commas", "stops",
]
METADATA = ["log_chars", "log_lines", "line_length", "line_spread", "short_lines", "twin_lines", "open_lines", "longest_line", "blank_lines", "source", "lang"]


def content_view(text: bytes) -> list[float]:
    """What the words say: shares of characters and words of the whole text."""
    words = text.translate(_LOWER).split()
    n, size = len(words), max(1, len(text))
    counts = Counter(words)
    letters = max(1, len(text) - len(text.translate(None, _LETTERS)))
    blanks = len(text) - len(text.translate(None, _BLANK))
    digits = len(text) - len(text.translate(None, _DIGITS))
    return [
        math.log1p(n), (len(text) - len(text.translate(None, _UPPER))) / letters, digits / size, max(0, len(text) - letters - blanks - digits) / size,
        blanks / size, len(text) / max(1, n), len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n),
        sum(map(bytes.__eq__, words, words[1:])) / max(1, n), sum(v - 1 for v in counts.values()) / max(1, n),
        text.count(b"!!") / max(1, n), len(_TAIL.findall(text)) / max(1, n), (counts[b"|"] + counts[b"-"] + counts[b"*"]) / max(1, n), text.count(b",") / max(1, n), text.count(b".") / max(1, n),
    ]


def metadata_view(text: bytes, source: float, lang: float) -> list[float]:
    """How the page is laid out and where it is from; source and lang come as shrunk rates of the training rows."""
    lines = text.split(b"\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return [
        math.log1p(len(text)), math.log1p(len(lines)), float(sizes.mean()), float(sizes.std()), float((sizes < 30).mean()),
        1 - len(set(lines)) / len(lines), sum(bool(x) and x[-1:] not in b".!?" for x in lines) / len(lines), float(sizes.max()), float((sizes == 0).mean()), source, lang,
    ]


def _views(rates: tuple[dict, dict, float]):
    """rates: of sources, of languages, and for all others."""

    def both(texts, sources, langs):
        a, b = [], []
        for t, s, g in zip(to_bytes(texts), sources.to_pylist(), langs.to_pylist(), strict=True):
            a.append(content_view(t))
            b.append(metadata_view(t, rates[0].get(s, rates[2]), rates[1].get(g, rates[2])))
        return np.array(a).reshape(-1, len(CONTENT)), np.array(b).reshape(-1, len(METADATA))

    return both


def _featurise(rates):
    def make():
        both = _views(rates)

        def kernel(texts, sources, langs):
            a, b = both(texts, sources, langs)
            return [pa.array(a.tolist(), pa.list_(pa.float64())), pa.array(b.tolist(), pa.list_(pa.float64()))]

        return kernel

    return make


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, ua: np.ndarray, ub: np.ndarray, rounds: int, take: int):
    """Models of both views. In each round, each view labels its `take` surest unlabelled rows of either class, by the
    classes' shares, and hands them to the other view."""
    models, given = [None, None], [dict(), dict()]
    views, pools = (a, b), (ua, ub)
    share = float(y.mean()) if len(y) else 0.5
    for r in range(rounds + 1):
        for v in (0, 1):
            more = sorted(given[v])
            x = np.vstack([views[v], pools[v][more]]) if more else views[v]
            labels = np.concatenate([y, [given[v][i] for i in more]])
            weight = np.concatenate([np.ones(len(y)), np.full(len(more), 0.5)])
            models[v] = fit_trees(x, labels, weight, rounds=60)
        if r == rounds or not len(ua) or share in (0.0, 1.0):
            break
        for v in (0, 1):
            p = models[v].predict(pools[v])
            order = np.argsort(p, kind="stable")
            low, high = max(1, round(take * (1 - share))), max(1, round(take * share))
            sure = [(i, 0.0) for i in order[:low].tolist() if p[i] < 0.1] + [(i, 1.0) for i in order[::-1][:high].tolist() if p[i] > 0.9]
            for i, label in sure:
                given[1 - v].setdefault(i, label)
    return models


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.005, 0.995)
    return np.log(p / (1 - p))


def _stack(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of (1, logits of both calibrated views) by a ridge logistic regression; plain mean without two classes."""
    w = np.array([0.0, 0.5, 0.5])
    if len(y) == 0 or y.min() == y.max():
        return w
    start = w.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(3)
        w = w + np.linalg.solve(h, z.T @ (y - p) - (w - start))
    return w


def _combined(models, isotonics, weights, a, b):
    p = [np.clip(isotonics[v](models[v].predict(x)), 0, 1) for v, x in ((0, a), (1, b))]
    z = np.stack([np.ones(len(a)), _logit(p[0]), _logit(p[1])], 1)
    return p[0], p[1], 1 / (1 + np.exp(-z @ weights))


def _score(rates, models, isotonics, weights, threshold):
    def make():
        both = _views(rates)

        def kernel(texts, sources, langs):
            a, b = both(texts, sources, langs)
            p = _combined(models, isotonics, weights, a, b)
            return [*(pa.array(x, pa.float64()) for x in p), pa.array(p[2] >= threshold, pa.bool_())]

        return kernel

    return make


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    label: str = "quality", bound: int = 16_000, pool: int = 8_000, rounds: int = 4, take: int = 400, threshold: float = 0.5,
) -> DataFrame:
    """All columns of docs and held_out, content_score, metadata_score, score (0 to 1, higher: better) and keep.

    Fitted on at most about `bound` labelled rows that aren't held out and a pool of about `pool` unlabelled rows (both
    documented samples, by a hash of the id); every document is scored from its whole text. Three quarters of the
    labelled rows train the views, the rest calibrates and combines them. Null and empty texts are scored like any
    other, null or unseen sources and languages at the overall rate. Without labels of both classes, scores are the
    smoothed base rate. Rows that repeat an id are scored each; for the fit an id counts once. Result names replace input
    columns of the same name, and a column called __id must not be docs' own.
    The joins send bounded samples of ids to the documents; documents aren't shuffled.
    """
    sample = training_labels(labels, label, bound)
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"))
    known = slim.join(F.broadcast(sample.withColumnRenamed("doc_id", "__id")), "__id")
    # an id counts once, with its least row, so that what is fitted stays bounded however often an id repeats
    one = lambda df: df.groupBy("__id", "y").agg(F.min(F.struct("text", "source", "lang")).alias("r")).select("__id", "y", "r.*")
    known = one(known).withColumn("part", F.pmod(F.xxhash64("__id", F.lit("quality")), F.lit(4)).cast("int"))
    n_docs = max(1, slim.count())
    chosen = F.pmod(F.xxhash64("__id", F.lit("pool")), F.lit(1 << 30)) < int(min(1.0, pool / n_docs) * (1 << 30))
    free = one(slim.where(chosen & ~held_out(F.col("__id"))).withColumn("y", F.lit(-1))).withColumn("part", F.lit(0))
    known = materialise(known, "labelled")
    rate_rows = known.where("part > 0").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum((F.col("y") > 0).cast("int")).alias("k")).collect()  # no more groups than sampled rows
    rates = _rates(rate_rows)
    fields = [("a", T.ArrayType(T.DoubleType())), ("b", T.ArrayType(T.DoubleType()))]
    got = map_columns(known.unionByName(free.select(known.columns)), _featurise(rates), ["text", "source", "lang"], ["__id", "y", "part"], fields).toPandas()
    got = got.sort_values(["__id", "y"], kind="stable")
    a, b = np.array(got["a"].tolist(), float).reshape(-1, len(CONTENT)), np.array(got["b"].tolist(), float).reshape(-1, len(METADATA))
    y, part = got["y"].to_numpy(), got["part"].to_numpy()
    release(known)
    labelled = y >= 0
    unlabelled = ~labelled & ~np.isin(got["__id"].to_numpy(), got["__id"].to_numpy()[labelled])
    fit, held = labelled & (part > 0), labelled & (part == 0)
    target = (y > 0).astype(float)
    models = co_train(a[fit], b[fit], target[fit], a[unlabelled], b[unlabelled], rounds, take)
    isotonics = [fit_isotonic(models[v].predict(x[held]), target[held]) for v, x in ((0, a), (1, b))]
    p = [np.clip(isotonics[v](models[v].predict(x[held])), 0, 1) for v, x in ((0, a), (1, b))]
    weights = _stack(np.stack([np.ones(int(held.sum())), _logit(p[0]), _logit(p[1])], 1), target[held])
    marked = docs.withColumn("held_out", held_out(F.col(id_col)))
    fields = [("content_score", T.DoubleType()), ("metadata_score", T.DoubleType()), ("score", T.DoubleType()), ("keep", T.BooleanType())]
    return map_columns(marked, _score(rates, models, isotonics, weights, threshold), [text_col, source_col, lang_col], marked.columns, fields)


def _rates(rows) -> tuple[dict, dict, float]:
    """Rates of y = 1 by source and by language, each shrunk by 20 rows at the overall rate."""
    n, k = sum(r.n for r in rows), sum(r.k for r in rows)
    overall = (k + 0.5) / (n + 1)
    out: list[dict] = []
    for name in ("source", "lang"):
        total: dict = {}
        for r in rows:
            m, j = total.get(r[name], (0, 0))
            total[r[name]] = (m + r.n, j + r.k)
        out.append({key: (j + 20 * overall) / (m + 20) for key, (m, j) in total.items()})
    return out[0], out[1], overall
