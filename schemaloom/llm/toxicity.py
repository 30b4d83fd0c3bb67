"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import fit_isotonic, fit_trees
from .common import flat_map, map_columns, materialise, release, to_bytes
from .decontaminate import words_of
from .labelled import held_out, training_labels

#: Second-person words in English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te vous votre vos du dich dir dein deine ihr euch tú ti usted ustedes vosotros tus vuestro".encode().split())
#: Characters that stand for letters in disguised words.
_PLAIN = bytes.maketrans(b"013457@$!", b"oieastasi")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_DISGUISED = re.compile(rb"[A-Za-z]+(?:[0-9@$*!.\-_]+[A-Za-z]+)+")
_STRETCHED = re.compile(rb"([A-Za-z])\1\1")
_CAPS = re.compile(rb"\b[A-Z]{3,}\b")
#: Words around a lexicon hit that count as near, and the lengths of stems in the lexicon.
NEAR, STEMS = 5, (4, 5, 6)
#: Folds of the labelled rows over which the lexicon is cross-fitted.
FOLDS = 5

FEATURES = [
    "log_words", "hits", "density", "kinds", "strength", "near_you", "near_share", "you_share",
    "caps", "caps_words", "marks", "exclaims", "disguised", "disguised_hits", "stretched",
]


def entries_of(words: set[bytes]) -> set[bytes]:
    """The lexicon entries that words could match: the words, and their stems marked by a final '*'."""
    return words | {w[:k] + b"*" for w in words for k in STEMS if len(w) > k}


def features(text: bytes, lexicon: dict[bytes, float]) -> list[float]:
    """Dense features of a whole text; zeros for an empty one. lexicon: word or stem -> log odds."""
    words = words_of(text)
    n, size = len(words), max(1, len(text))
    hits, kinds, strength = [], set(), 0.0
    if lexicon:
        stems = [k for k in STEMS if any(e.endswith(b"*") and len(e) == k + 1 for e in lexicon)]
        known: dict[bytes, bytes] = {}
        for w in set(words):
            e = w if w in lexicon else next((s for k in stems if len(w) > k and (s := w[:k] + b"*") in lexicon), None)
            if e is not None:
                known[w] = e
        if known:
            for i, w in enumerate(words):
                if w in known:
                    hits.append(i)
                    kinds.add(known[w])
            strength = sum(lexicon[known[words[i]]] for i in hits)
    you = SECOND_PERSON.intersection(words)
    you_at = np.array([i for i, w in enumerate(words) if w in you]) if you else np.zeros(0)
    near = 0
    if hits and len(you_at):
        h = np.array(hits)
        j = np.searchsorted(you_at, h)
        gap = np.minimum(np.abs(h - you_at[np.minimum(j, len(you_at) - 1)]), np.abs(h - you_at[np.maximum(j - 1, 0)]))
        near = int((gap <= NEAR).sum())
    hidden = _DISGUISED.findall(text)
    hidden_hits = sum(any(x in lexicon for x in (m.translate(_PLAIN).lower(), re.sub(rb"[^A-Za-z]", b"", m).lower())) for m in hidden)
    letters = max(1, size - len(text.translate(None, _LETTERS)))
    return [
        math.log1p(n), len(hits), len(hits) / max(1, n), len(kinds), strength / max(1, n), near, near / max(1, len(hits)), len(you_at) / max(1, n),
        (len(text) - len(text.translate(None, _UPPER))) / letters, len(_CAPS.findall(text)) / max(1, n), (len(text) - len(text.translate(None, _PUNCTUATION))) / size,
        text.count(b"!") / size, len(hidden) / max(1, n), hidden_hits, len(_STRETCHED.findall(text)) / max(1, n),
    ]


def _count_entries():
    def kernel(texts, ys, folds):
        c: Counter = Counter()
        for t, y, f in zip(to_bytes(texts), ys.to_pylist(), folds.to_pylist(), strict=True):
            c.update((e, f, y > 0) for e in entries_of(set(words_of(t))))
        keys = list(c)
        return [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([c[k] for k in keys], pa.int64())]

    return kernel


def learn_lexicons(rows: DataFrame, folds: int, least: int = 8, odds: float = 3.0, most: int = 5000) -> list[dict[bytes, float]]:
    """Words and stems of rows(text, y, fold) that mark y = 1: in at least `least` such rows, at log odds of `odds` or more.

    One lexicon per fold, of the rows outside it, and a last one of all rows. Counted over all given rows in the cluster;
    the `most` entries of the largest odds come to the driver.
    """
    sizes = {(r.fold, r.t): r.n for r in rows.groupBy("fold", (F.col("y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    counts = flat_map(rows, _count_entries, ["text", "y", "fold"], [("e", T.BinaryType()), ("fold", T.IntegerType()), ("t", T.BooleanType()), ("n", T.LongType())])
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("t") == bool(t)), F.col("n")).otherwise(0)).alias(f"c{t}_{f}") for t in (0, 1) for f in range(folds)]
    total = [reduce(Column.__add__, [F.col(f"c{t}_{f}") for f in range(folds)]) for t in (0, 1)]
    n_all = [sum(n for (_, t), n in sizes.items() if t == bool(k)) for k in (0, 1)]
    got = counts.groupBy("e").agg(*sums).where(total[1] >= least)
    got = got.withColumn("odds", F.log((total[1] + 0.5) / (n_all[1] + 1)) - F.log((total[0] + 0.5) / (n_all[0] + 1)))
    # leaving out a fold moves the odds a little, so entries somewhat below the bound come along
    got = got.where(F.col("odds") >= odds - 1).orderBy(F.desc("odds"), "e").limit(most).collect()
    out = []
    for left in range(folds + 1):
        n = [sum(m for (f, t), m in sizes.items() if t == bool(k) and f != left) for k in (0, 1)]
        lexicon = {}
        for r in got:
            c = [sum(r[f"c{k}_{f}"] for f in range(folds) if f != left) for k in (0, 1)]
            value = math.log((c[1] + 0.5) / (n[1] + 1)) - math.log((c[0] + 0.5) / (n[0] + 1))
            if c[1] >= least and value >= odds:
                lexicon[bytes(r.e)] = value
        out.append(lexicon)
    return out


def _featurise(lexicons: list[dict[bytes, float]]):
    def make():
        def kernel(texts, folds):
            return [pa.array([features(t, lexicons[f]) for t, f in zip(to_bytes(texts), folds.to_pylist(), strict=True)], pa.list_(pa.float64()))]

        return kernel

    return make


def _score(lexicon, trees, isotonic):
    def make():
        def kernel(texts):
            x = np.array([features(t, lexicon) for t in to_bytes(texts)]).reshape(-1, len(FEATURES))
            score = np.clip(isotonic(trees.predict(x)), 0, 1)
            return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]

        return kernel

    return make


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", bound: int = 24_000) -> DataFrame:
    """All columns of docs and held_out, score (0 to 1), predicted. Only the text is an input of the score.

    Fitted on at most about `bound` labelled rows that aren't held out (a documented sample; every document is
    scored). The lexicon is cross-fitted: a training row's features come from a lexicon of the other FOLDS - 1 folds, so
    that no label is in its own row's features and all labels serve; documents are scored with that of all folds. Five
    sixths of the rows fit the trees, the rest calibrates. Null and empty texts are scored like any other. Without labels
    of both classes the score is the smoothed base rate, 0.5 without any. Rows that repeat an id are scored each; for the
    fit an id counts once, with its least text. Result names replace input columns of the same name, and a column called
    __id must not be docs' own. The one join sends the bounded label sample to the documents; documents aren't shuffled.
    """
    sample = F.broadcast(training_labels(labels, label, bound).withColumnRenamed("doc_id", "__id"))
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    rows = slim.join(sample, "__id").groupBy("__id", "y").agg(F.min("text").alias("text"))
    spread = lambda name, n: F.pmod(F.xxhash64("__id", F.lit(name)), F.lit(n)).cast("int")
    rows = rows.withColumns({"part": spread("part", 6), "fold": spread("fold", FOLDS)})
    rows = materialise(rows.select("text", "y", "part", "fold"), "labelled")
    lexicons = learn_lexicons(rows.select("text", "y", "fold"), FOLDS)
    got = map_columns(rows, _featurise(lexicons), ["text", "fold"], ["y", "part"], [("x", T.ArrayType(T.DoubleType()))]).toPandas()
    release(rows)
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y, fit = (got["y"].to_numpy(dtype=float) > 0).astype(float), (got["part"] < 5).to_numpy()
    order = np.lexsort(np.vstack([x.T, y, fit]))  # the order in which rows arrive doesn't count
    x, y, fit = x[order], y[order], fit[order]
    trees = fit_trees(x[fit], y[fit])
    isotonic = fit_isotonic(trees.predict(x[~fit]), y[~fit])
    marked = docs.withColumn("held_out", held_out(F.col(id_col)))
    return map_columns(marked, _score(lexicons[-1], trees, isotonic), [text_col], marked.columns, [("score", T.DoubleType()), ("predicted", T.IntegerType())])
