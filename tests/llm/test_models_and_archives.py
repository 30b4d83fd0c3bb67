"""Nearest neighbours, classifiers, WARC archives and the pipeline."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from schemaloom.llm import queries as Q
from schemaloom.llm.ann import Tables, nearest
from schemaloom.llm.boosting import fit_isotonic, fit_trees
from schemaloom.llm.quality import quality
from schemaloom.llm.toxicity import features, toxicity
from schemaloom.llm.warc import read_warc, warc_index, write_warc

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, rank string"


# nearest neighbours


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (3000, 4), dtype=np.uint16)
    codes[:500] = codes[0] ^ (rng.random((500, 4, 16)) < 0.1).dot(1 << np.arange(16)).astype(np.uint16)
    t = Tables(codes)
    for radius in (0, 3, 11, 20):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[7]).sum(axis=1) <= radius)
        assert np.array_equal(t.within(codes[7], radius), want)


def brute_nearest(rows, k, every):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % every == 0:
            out[q] = sorted((-float(np.dot(v, w)), i) for i, w in good.items() if i != q and len(w) == len(v))[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(16) * rng.uniform(0.5, 2)]) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)]  # one common vector
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [1.0, None] * 8), (3005, [float("inf")] * 16), (None, rows[1][1]), (3020, [1.0, 2.0]), (3021, [2.0, 1.0])]
    got = nearest(spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS), query_rows=50, shard_rows=500).toPandas()
    want = brute_nearest(rows, 20, 20)
    assert set(got.query_id) == {q for q, w in want.items() if w}
    recall = []
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        ids = g.vec_id.tolist()
        assert g["rank"].tolist() == list(range(1, len(ids) + 1)) and q not in ids
        assert len(ids) == len(want[q])
        exact = {i: -s for s, i in brute_nearest([r for r in rows if r[0] in {q, *ids}], 99, 1)[q]}
        assert np.allclose(g.score, [exact[i] for i in ids])
        assert [(-s, i) for s, i in zip(g.score, ids)] == sorted((-s, i) for s, i in zip(g.score, ids))
        recall.append(len(set(ids) & {i for _, i in want[q]}) / len(ids))
    assert np.mean(recall) >= 0.9


def test_few_and_no_vectors(spark):
    got = nearest(spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.5, 0.0], ""), (2, [0.5, 0.0], "")], VECTORS)).orderBy("rank").collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_on_the_table(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    want = brute_nearest([(int(i), [float(y) for y in v]) for i, v in zip(e.vec_id, e.embedding)], 20, 20)
    got = Q.op4_nearest(spark, SF).toPandas().groupby("query_id").vec_id.apply(set)
    assert np.mean([len(got[q] & {i for _, i in w}) / 20 for q, w in want.items()]) >= 0.9


# models


def auc(y, s):
    r, n1 = pd.Series(s).rank().to_numpy(), y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = fit_trees(x[:2000], y[:2000], rounds=60)
    assert auc(y[2000:], m.predict(x[2000:])) > 0.97
    iso = fit_isotonic(m.predict(x[:2000]), y[:2000])
    assert (np.diff(iso(np.linspace(0, 1, 100))) >= 0).all()
    assert fit_trees(x[:0], y[:0]).predict(x[:3]).tolist() == [0.5] * 3
    assert (fit_trees(x[:50], np.ones(50)).predict(x[:3]) > 0.9).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op7_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    h = got[got.held_out]
    assert h.score.between(0, 1).all() and ((h.score >= 0.5).astype(int) == h.predicted).all()
    hit = ((h.predicted == 1) & (h.toxic == 1)).sum()
    assert auc(h.toxic.to_numpy(), h.score.to_numpy()) > 0.8 and hit / max(1, (h.predicted == 1).sum()) > 0.9


def test_quality_held_out(spark):
    got = Q.op5_quality(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    h = got[got.held_out]
    assert auc(h.quality.to_numpy(), h.score.to_numpy()) > 0.95
    assert h[h.quality == 1].keep.mean() > 0.97 and h[h.quality == 0].keep.mean() < 0.2


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, None), (None, 1, 1)]])
def test_models_without_labels(spark, labels):
    docs = spark.createDataFrame([(1, None, None, None, "x", "y"), (1, "", "en", "s", "x", "y"), (None, "word " * 50_000, "en", "s", "x", "y")], "doc_id long, text string, lang string, source string, score string, keep string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for out in (quality(docs, lab), toxicity(docs, lab)):
        assert out.where("score between 0 and 1").count() == 3
    assert quality(docs.limit(0), lab).count() == 0 and toxicity(docs.limit(0), lab).count() == 0


def test_features_of_disguised_words():
    lex = {b"idiot": 5.0, b"mor*": 4.0}
    at = lambda t: dict(zip(__import__("schemaloom.llm.toxicity", fromlist=["FEATURES"]).FEATURES, features(t, lex)))
    assert at(b"you idiot")["near_you"] == 1 and at(b"an idiot")["near_you"] == 0
    assert at(b"an 1d1ot")["hits"] == 0 and at(b"what an i.d.i.o.t here")["disguised_hits"] == 1
    assert at(b"")["hits"] == 0


# WARC

PAGES = "page_id long, url string, html string, digest string"
MAGIC = "WARC/1.1\r\n"


def pages(spark, r, n=60):
    rows = []
    for i in range(n):
        body = "".join(r.choice(["<p>", "é", MAGIC, "\r\n\r\n", "Content-Length: 7\r\n", "text ", "WARC/1.1", MAGIC + "Content-Length: 3\r\n\r\nabc\r\n\r\n"]) for _ in range(r.randint(0, 60)))
        rows.append((i, f"http://x/{i}\r\nEvil: {MAGIC}", body, "clash"))
    big = "same " * 300
    rows += [(i, "u", big, "") for i in (100, 101, 102)] + [(103, None, None, ""), (104, "u", "s" * 999, ""), (105, "u", "s" * 999, ""), (106, "u", MAGIC * 400, ""), (107, "u", "x" * 300_000, "")]
    return rows


@pytest.mark.parametrize(("split", "bound"), [(None, None), ("4k", None), ("700", 0)])
def test_archives_come_back(spark, monkeypatch, split, bound):
    """Whole, split, and split with nothing sent to all tasks."""
    if bound is not None:
        monkeypatch.setattr("schemaloom.llm.warc.BROADCAST_BYTES", bound)
    rows = pages(spark, random.Random(6))
    path = write_warc(spark.createDataFrame(rows, PAGES).coalesce(2))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        records = read_warc(spark, path).cache()
        got = {x.page_id: x for x in warc_index(records).collect()}
        raw = {x.head.split("<urn:page:")[1].split(">")[0]: x for x in records.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert len(raw) == len(rows) == len(got) and all(x.complete for x in raw.values())
    for i, _, html, _ in rows:
        data = (html or "").encode()
        back = i in (100, 101)
        assert bytes(raw[str(i)].payload) == (b"" if back else data)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if back else "response", 102 if back else None)


def test_broken_chains(spark, tmp_path):
    one = MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    lie = MAGIC + "WARC-Type: response\r\nContent-Length: 2\r\n\r\nhello\r\n\r\n"
    cases = {"good": (one * 3, 3, 3), "lie": (one + lie + one, 2, 1), "short": (one + one[:-6], 2, 1), "junk": ("junk" + one, 0, 0), "empty": ("", 0, 0), "headless": (one + MAGIC + "no end", 2, 1)}
    for name, (text, n, whole) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(text.encode())
        got = read_warc(spark, str(tmp_path / name)).collect()
        assert (len(got), sum(x.complete for x in got)) == (n, whole), name


def test_no_pages_and_odd_ids(spark):
    path = write_warc(spark.createDataFrame([(None, "u", "z" * 2000, ""), (7, "u", "z" * 2000, ""), (7, "u", "z" * 2000, "")], PAGES))
    got = sorted((x.page_id or -1, x.record_type) for x in warc_index(read_warc(spark, path)).collect())
    assert got == [(-1, "response"), (7, "response"), (7, "response")]
    assert read_warc(spark, write_warc(spark.createDataFrame([], PAGES))).count() == 0


def test_labels_of_a_repeated_id_are_collected_once(spark):
    rows = [(i, f"text number {i} of the lot", "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(300)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    often = once.unionByName(once.where("doc_id < 3").select("doc_id", "text", "lang", "source", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("col"))
    for make in (quality, toxicity):
        want = {x.doc_id: x.score for x in make(once, labels).collect()}
        got = make(often, labels).collect()
        assert len(got) == 300 + 3 * 400
        assert make is quality or all(abs(x.score - want[x.doc_id]) < 1e-12 for x in got)


def test_views_hand_each_other_labels():
    """The second view sees nothing in the labelled rows that tells them apart; what it learns comes from the first."""
    from schemaloom.llm.quality import co_train

    r = np.random.default_rng(4)
    y = np.repeat([0.0, 1.0], 100)
    a, b = (y * 4 + r.normal(0, 0.3, 200))[:, None], np.zeros((200, 1))
    truth = r.integers(0, 2, 2000).astype(float)
    ua, ub = (truth * 4 + r.normal(0, 0.3, 2000))[:, None], (truth * 2 + r.normal(0, 0.5, 2000))[:, None]
    alone, taught = (co_train(a, b, y, ua, ub, rounds, 200)[1].predict(ub) for rounds in (0, 3))
    assert np.ptp(alone) == 0 and auc(truth, taught) > 0.95


def test_a_repeated_id_offers_all_its_vectors(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [0.1, 0.0], ""), (1, [0.9, 0.5], ""), (2, [0.5, 0.0], ""), (20, [0.0, 1.0], ""), (20, [1.0, 1.0], "")]
    got = nearest(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in got] == [(0, 1, 20, 1.0), (0, 2, 1, 0.9), (0, 3, 2, 0.5), (20, 1, 1, 1.4), (20, 2, 0, 1.0), (20, 3, 2, 0.5)]


# pipeline


def test_pipeline_equals_its_stages(spark):
    """Each stage's decisions, recomputed plainly from what the stage before kept."""
    from test_near_dup import brute_similar
    from test_text_operators import brute_hits

    def line_cut(texts):
        key = lambda x: (k if len((k := x.encode().strip().lower()).decode()) >= 20 else None)
        at = {}
        for i, t in texts.items():
            for x in (t or "").split("\n"):
                if key(x):
                    at.setdefault(key(x), set()).add(i)
        return {i: "\n".join(x for x in (t or "").split("\n") if not key(x) or len(at[key(x)]) < 3 or max(at[key(x)]) == i) for i, t in texts.items()}

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    q = quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("keep").select(docs.columns).toPandas()
    kept = line_cut(dict(zip(q.doc_id, q.text)))
    comp = brute_similar(kept)
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    b = pd.read_parquet(f"{sf}/benchmark.parquet")
    items = list(zip(b.item_id, b.text))
    kept = {i: t for i, t in kept.items() if not brute_hits(t, items)[1]}
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert dict(zip(out.doc_id, out.text)) == kept
    assert (out.text.str.len() == out.n_chars).all()
    assert [hashlib.sha256(t.encode()).hexdigest() for t in out.text] == out.decoded_sha256.tolist()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontaminate", "bpe"]


def test_pipeline_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (None, "some text", "en", "s", 9), (1, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if k < 4:
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        docs = out
    assert docs.where(F.col("n_tokens").isNull()).count() == 0
