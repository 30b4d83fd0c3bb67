"""Near-dup components of the pipeline's stage against all pairs of shingle sets."""

import itertools
import random
from fractions import Fraction

import corpus_pipeline
from test_text_operators import brute_fingerprint, docs_frame, words

from schemaloom.llm.near_dup import near_dup_components


def brute_similar(texts):
    """Smallest id reachable over pairs of five-word Jaccard similarity 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    part = {i: i for i in texts}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in itertools.combinations(sorted(texts), 2):
        x, y = sets[i], sets[j]
        if x == y or (x and y and Fraction(len(x & y), len(x | y)) >= Fraction(4, 5)):
            a, b = sorted((find(i), find(j)))
            part[b] = a
    return {i: find(i) for i in texts}


def sample():
    r = random.Random(12)
    base = [words(r, 200) for _ in range(5)]
    texts = [None, "", " \t", "one", "one two three", "ONE two three", "a b c d e", "a b c d e f"]
    for _ in range(150):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            w[r.randrange(len(w))] = words(r, 1)
        texts.append(" ".join(w))
    return dict(enumerate(texts))


def test_components_equal_all_pairs(spark):
    texts = sample()
    got = {x.doc_id: x.component_id for x in near_dup_components(docs_frame(spark, list(texts.items()))).collect()}
    assert got == brute_similar(texts)


def test_stage_drops_near_copies_beyond_two_bits(spark):
    r = random.Random(3)
    w = words(r, 100).split(" ")
    near, far = list(w), list(w)
    near[30:34] = ["changed"] * 4  # 88 of 104 shingles are shared
    for k in range(5, 100, 20):
        far[k] = "changed"
    texts = {1: " ".join(w), 2: " ".join(near), 3: " ".join(far)}
    assert (brute_fingerprint(texts[1]) ^ brute_fingerprint(texts[2])).bit_count() > 2
    assert sorted(x.doc_id for x in corpus_pipeline.near_dup_stage(spark, docs_frame(spark, [*texts.items(), (None, texts[1])]), "").collect() if x.doc_id) == [1, 3]


def test_pairs_at_the_bound_meet_in_a_table():
    """Codes of correlated sums: of pairs at a similarity of 0.8, about MISS share no key, and few are farther than the bound."""
    import numpy as np

    from schemaloom.llm.near_dup import MISS, Tables, bit_sums

    r = np.random.default_rng(8)
    t = Tables.of_size(5000, 0.8)
    apart = far = 0
    for _ in range(400):
        both = r.integers(0, 1 << 63, 800, dtype=np.uint64)
        sets = [np.concatenate([both, r.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(2)]
        over = [2 * bit_sums(s, t.words) - len(s) for s in sets]
        differ = (over[0] > 0) != (over[1] > 0)
        far += differ.sum() > t.most(t.words)
        free = np.zeros((t.count, t.width), bool)
        for o in over:
            weak = np.argsort(np.abs(o[: t.count * t.width]).reshape(t.count, t.width), axis=1, kind="stable")[:, : t.flips]
            np.put_along_axis(free, weak, True, axis=1)
        apart += (differ[: t.count * t.width].reshape(t.count, t.width) & ~free).any(axis=1).all()
    assert apart <= 400 * MISS * 4 and far <= 2


def test_large_group_of_near_copies(spark):
    """Copies of one text that are nearer to it than to each other come to one component, loners stay apart."""
    r = random.Random(9)
    base = words(r, 150).split(" ")
    texts = {0: " ".join(base)}
    for i in range(1, 120):
        w = list(base)
        for _ in range(1 + i % 12):
            w[r.randrange(len(w))] = words(r, 1)
        texts[i] = " ".join(w)
    got = {x.doc_id: x.component_id for x in near_dup_components(docs_frame(spark, list(texts.items()))).collect()}
    assert got == brute_similar(texts)


def test_texts_apart_in_a_dense_group_are_not_paired_with_all(spark, monkeypatch):
    """Copies of one text, most of them just too far from each other: few pairs are compared, and every link is found."""
    from schemaloom.llm import near_dup

    r = random.Random(21)
    base = words(r, 150).split(" ")
    texts = {}
    for i in range(240):
        w = list(base)
        for k in r.sample(range(0, 150, 6), 3 + i % 3):
            w[k] = f"x{r.randrange(10**9)}"
        texts[i] = " ".join(w)
    for i in range(240, 260):  # near copies of members far from the middle
        w = texts[5 * (i - 240) + 2].split(" ")
        w[r.randrange(150)] = "also"
        texts[i] = " ".join(w)
    pairs, write = [], near_dup.materialise

    def counted(df, label):
        out = write(df, label)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "materialise", counted)
    got = {x.doc_id: x.component_id for x in near_dup_components(docs_frame(spark, list(texts.items()))).collect()}
    assert got == brute_similar(texts) and len(set(got.values())) > 100
    assert sum(pairs[1:]) < 6000, pairs  # of 33,670 between 260 texts
