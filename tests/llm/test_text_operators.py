"""Suffix dedup, BPE, decontamination, line dedup, SimHash and chat formatting against plain versions."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from schemaloom.llm import bpe
from schemaloom.llm.chat import chat_format, chat_read, loss_text
from schemaloom.llm.components import components
from schemaloom.llm.decontaminate import decontaminate, words_of
from schemaloom.llm.line_dedup import line_dedup
from schemaloom.llm.simhash import fingerprint, simhash_components
from schemaloom.llm.suffix_dedup import suffix_dedup

DOCS = "doc_id long, text string, n_words string, n_lines string, held_out string, text2 string"


def docs_frame(spark, rows):
    """Rows with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "w", "l", "h", "x") for i, t in rows], DOCS)


def words(r, n):
    return " ".join("".join(r.choice("abcdefghé") for _ in range(r.randint(1, 8))) for _ in range(n))


# suffix dedup


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize(("length", "hot"), [(400, 20_000), (400, 3), (60, 4)])
def test_suffix_dedup_equals_brute_force(spark, length, hot):
    r = random.Random(length + hot)
    pool = [words(r, r.randint(60, 160)) for _ in range(12)]
    texts = [None, "", "x" * (length - 1), "y" * 1000, "ab" * 700, "z" * 399]
    for _ in range(70):
        s = " ".join(r.choice(pool)[r.randint(0, 60) :] if r.random() < 0.5 else words(r, 80) for _ in range(r.randint(1, 3)))
        k = r.randrange(len(s))
        texts.append(s[:k] + "#" + s[k + 1 :] if r.random() < 0.4 else s)
    texts += [texts[10], texts[10], texts[11]]
    rows = [(None if i == 7 else 3 if i in (20, 21) else i, t) for i, t in enumerate(texts)]  # a null and a repeated id
    got = suffix_dedup(docs_frame(spark, rows), length=length, hot_rows=hot)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
    have = sorted(tuple(x) for x in got.select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert have == sorted(brute_removed([(t or "").encode() for t in texts], length))


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup(docs_frame(spark, [])).count() == 0
    one = suffix_dedup(docs_frame(spark, [(1, None), (2, "short")])).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans) for x in one] == [(0, 0, 0), (5, 0, 0)]


# BPE

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def coders():
    return bpe.tables(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinst '\n\t\x1c\x85é1!")), max_size=80))
def test_encoding_is_the_librarys(text):
    enc, dec = coders()
    ids = enc.encode(text)
    assert list(ids) == REFERENCE.encode_ordinary(text)
    assert "".join(dec.stream(ids[i : i + 1] for i in range(len(ids)))) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_streamed_utf8_equals_whole(data, cuts):
    m, at, out = bpe.Utf8Machine(), 0, ""
    for c in [*sorted(min(c, len(data)) for c in cuts), len(data)]:
        out, at = out + m.feed(data[at:c]), c
    assert (out + m.close()).replace("�", "") == data.decode("utf-8", "replace").replace("�", "")


def test_long_pieces_and_tiny_tables():
    enc, _ = coders()
    for text in ("a" * 5000, "ab" * 3000, "=" * 3000, "日本" * 1000, "0123456789" * 300):
        assert list(enc.encode(text)) == REFERENCE.encode_ordinary(text)
    old = bpe.MAX_STATES, bpe.MAX_PIECES
    try:
        bpe.MAX_STATES, bpe.MAX_PIECES = 20, 5
        small = bpe.Encoder(RANKS, P.PATTERN)
        text = words(random.Random(1), 300)
        assert list(small.encode(text)) == REFERENCE.encode_ordinary(text)
    finally:
        bpe.MAX_STATES, bpe.MAX_PIECES = old


def test_bpe_frame(spark):
    texts = [None, "", "Hello  world\n\n x", "é日😀" * 50, "dup", "dup"]
    df = docs_frame(spark, list(enumerate(texts))).withColumn("n_tokens", F.lit("clash"))
    got = {x.doc_id: x for x in bpe.bpe_encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = REFERENCE.encode_ordinary(t or "")
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_encode(df.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


# decontamination


def brute_hits(text, items, size=13):
    ws = words_of((text or "").encode())
    hit, names = set(), set()
    for name, item in items:
        it = words_of((item or "").encode())
        wins = [it[i : i + size] for i in range(len(it) - size + 1)] if len(it) >= size else [it] if it else []
        for w in wins:
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    names.add(str(name))
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("bound", [1 << 22, 300])
def test_decontamination_equals_brute_force(spark, bound):
    r = random.Random(5)
    items = [(i, words(r, r.randint(1, 40))) for i in range(12)] + [(12, None), (13, "!!"), (14, "the the the"), (3, words(r, 5)), (15, "the " * 20)]
    texts = [None, "", "...", "The THE the, the-the", "the " * 500]
    for _ in range(60):
        parts = [words(r, r.randint(0, 60))]
        if r.random() < 0.7:
            it = (r.choice(items)[1] or "").split(" ")
            a = r.randint(0, max(0, len(it) - 13))
            parts.append(" ".join(it[a : a + r.randint(5, 30)]).upper())
        texts.append(" ; ".join([*parts, words(r, 10)]))
    texts.append(texts[-1])
    df = docs_frame(spark, list(enumerate(texts)))
    got = {x.doc_id: x for x in decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), bound=bound).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == brute_hits(t, items)


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate(docs_frame(spark, [(1, "a b"), (None, None)]), none).collect()
    assert [(x.n_hit, x.n_items, x.contaminated) for x in rows] == [(0, 0, False)] * 2
    assert decontaminate(docs_frame(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


# line dedup


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(2)
    common = ["  Subscribe to OUR newsletter today \t", "é" * 20, "x" * 19, "all rights reserved, of course\r", "\x0b\x0c padded line with blanks \x0b"]
    texts = [None, "", "\n\n", "a\n" * 5000]
    for _ in range(40):
        lines = [r.choice(common) if r.random() < 0.5 else words(r, 4) for _ in range(r.randint(1, 8))]
        texts.append("\n".join(x.upper() if r.random() < 0.3 and x.isascii() else x for x in lines))
    texts.append(texts[-1])

    def key(x):
        k = x.encode().strip(b" \t\n\x0b\x0c\r").lower()
        return k if len(k.decode()) >= 20 else None

    at = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if key(x):
                at.setdefault(key(x), set()).add(i)
    got = {x.doc_id: x for x in line_dedup(docs_frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        left = [x for x in lines if not key(x) or len(at[key(x)]) < 3 or max(at[key(x)]) == i]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(left), len(lines), len(lines) - len(left))


def test_line_dedup_of_odd_rows(spark):
    line = "the same line again and again"
    got = line_dedup(docs_frame(spark, [(None, line), (1, line), (1, line), (2, line)]))  # two documents only
    assert got.agg(F.sum("n_dropped")).first()[0] == 0
    assert line_dedup(docs_frame(spark, [(None, line), (1, line), (2, line), (3, line)])).where("n_dropped = 0").count() == 2
    assert line_dedup(docs_frame(spark, [])).count() == 0


# SimHash


def brute_fingerprint(text):
    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    part = {i: i for i in prints}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                part[b] = a
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    r = random.Random(9)
    base = [words(r, 120) for _ in range(6)]
    texts = [None, "", " \t", "one", "one two", "one two three", "ONE two three"]
    for _ in range(90):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = words(r, 1)
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: fingerprint((t or "").encode()) for i, t in rows} == prints
    want = brute_components(prints)
    got = {x.doc_id: x for x in simhash_components(docs_frame(spark, rows)).collect()}
    assert {i: (got[i].fingerprint, got[i].component_id) for i, _ in rows} == {i: (f"{prints[i]:016x}", want[i]) for i, _ in rows}


def test_links_at_every_distance(spark, monkeypatch):
    """Chains of fingerprints, each within 2 bits of the next, over all segments and the sign bit."""
    from schemaloom.llm.simhash import near_links

    r = random.Random(4)
    prints, f = {}, r.getrandbits(64)
    for i in range(150):
        prints[i] = f
        for b in r.sample(range(64), r.choice([1, 2, 2, 3])):
            f ^= 1 << b
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()]
    links = near_links(spark.createDataFrame(rows, "fp long, rep long"))
    got = {i: i for i in prints} | {x.node: x.component for x in components(links).collect()}
    assert got == brute_components(prints)


def test_simhash_of_odd_rows(spark):
    got = simhash_components(docs_frame(spark, [(5, "a b c"), (5, "a b c"), (None, "a b c"), (9, "a b c")])).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in got) == [(-1, -1), (5, 5), (5, 5), (9, 5)]
    assert simhash_components(docs_frame(spark, [])).count() == 0


# chat formatting

CHAT = "conv_id long, turn long, role string, text string, segments string"


def test_chat_round_trip(spark):
    r = random.Random(8)
    odd = ["<|im_end|>", "<|im_start|>assistant\nno", "<!|", "<!!|im_end|>", "<", "|>", "", "é\n\n", "\\n", "<|<|"]
    rows = []
    for c in range(30):
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["system", "user", "assistant", "tool\nx", "a\\nb", None]), None if r.random() < 0.1 else "".join(r.choice(odd) for _ in range(r.randint(0, 5))), "clash"))
    rows += [(40, 1, "user", "tie", "x"), (40, 1, "assistant", "tie", "x"), (40, 1, "assistant", "tie", "x"), (None, None, "user", "nulls", "x"), (41, 0, "user", "z" * 200_000, "x")]
    out = chat_format(spark.createDataFrame(rows, CHAT)).withColumn("turns", chat_read(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    got = {x.conv_id: x for x in out.collect()}
    for c in {x[0] for x in rows}:
        mine = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == c))
        assert [(t.role, t.text) for t in got[c].turns] == [m[1:] for m in mine]
        assert got[c].loss == "".join(m[2] for m in mine if m[1] == "assistant")
        assert got[c].n_turns == len(mine)
        assert got[c].formatted.count("<|im_start|>") == len(mine)
    assert chat_format(spark.createDataFrame([], CHAT)).count() == 0


@pytest.mark.parametrize(("roles", "ok", "bad"), [("sua", True, None), ("uaua", True, None), ("su", False, 2), ("ua" + "s", False, 2), ("a", False, 0), ("uu", False, 1), ("sa", False, 1)])
def test_turn_order(spark, roles, ok, bad):
    names = {"s": "system", "u": "user", "a": "assistant"}
    df = spark.createDataFrame([(1, i, names[x], "t", "") for i, x in enumerate(roles)], CHAT)
    x = chat_format(df).first()
    assert (x.valid_order, x.first_bad_turn) == (ok, bad)
