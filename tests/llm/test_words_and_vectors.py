"""Collocations, whitening and byte-level BPE against brute force and the tokenizer library."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from proxyscope.llm import byte_bpe, collocations, whitening

RANKS = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.TOKENIZER))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


# ---------------------------------------------------------------- byte-level BPE


def expected(text):
    ids = TIKTOKEN.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def hard_texts():
    rng = random.Random(1)
    letters = "aabbeeennrst  \n\t'éßЖ中\U0001f642 0123.,!=  drvlm"
    out = ["", None, "a", "'s", "a's b're c'llx 'tis  's\n's ''s", "=" * 3000, "a" * 5000, " " * 2000, "ab" * 1500, "na" * 200 + "中" * 300]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(100)]
    out += ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(60, 400))) for _ in range(20)]
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 60, 0])
def test_bpe_equals_the_library(spark, frequent):
    texts = hard_texts()
    docs = spark.createDataFrame([(i if i % 3 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, word int")
    rows = byte_bpe.encode_documents(docs, RANKS, frequent).collect()
    assert [c for c in rows[0].__fields__] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(i if i % 3 else None, *expected(t)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_bpe_of_driver_documents(spark, plain):
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.encode_documents(plain, RANKS, 500).collect()}
    assert got == {r.doc_id: expected(r.text) for r in plain.collect()}


def test_bpe_takes_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "some words, and some words again"), (2, "rare")], "doc_id long, text string")
    out = byte_bpe.encode_documents(docs, RANKS, 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow ") == 1
    # rare words first, last, next to each other, alone and repeated
    texts = ["a a a a xylo", "xylo a a", "xylo marimba a marimba xylo", "xylo", " xylo xylo", "", "a a", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frequent in (1, 2):
        got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.encode_documents(docs, RANKS, frequent).collect()}
        assert got == {i: expected(t) for i, t in enumerate(texts)}


def test_bpe_without_rows(no_documents):
    assert byte_bpe.encode_documents(no_documents, RANKS).collect() == []


def test_bpe_folds_numbers(spark):
    """Spark copies the state of a fold at each step: arrays of strings there take longer than the merge."""
    texts = ["".join(random.Random(n).choices(kind, k=n)) for n in (1, 2, 3, 62, 63, 64, 65, 66) for kind in ("abcinst", "=", "aé")]
    words = spark.createDataFrame([(t,) for t in texts], "word string")
    out = words.select("word", byte_bpe.encode_words(F.col("word"), RANKS).alias("ids"))
    assert out.schema["ids"].dataType.simpleString() == "array<int>"  # they go through the driver
    assert {r.word: r.ids for r in out.collect()} == {t: TIKTOKEN.encode_ordinary(t) for t in texts}
    states = []

    def walk(node):
        if node.getClass().getSimpleName() == "ArrayAggregate" and not node.argument().foldable():
            states.append(node.zero().dataType().simpleString())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(out._jdf.queryExecution().analyzed().expressions().last())
    assert "array<bigint>" in states and not [s for s in states if "array<string>" in s]


def test_words_follow_the_pattern():
    classes = np.frombuffer(byte_bpe.character_classes(), np.uint8)
    texts = [t or "" for t in hard_texts()]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    words, first = byte_bpe.words_of(np.frombuffer(b"".join(raw), np.uint8), offsets, classes)
    listed = words.dictionary_decode().to_pylist()
    assert [listed[a:b] for a, b in zip(first[:-1], first[1:])] == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


# ---------------------------------------------------------------- collocations


def brute_force(rows, top, least):
    words, counts = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in regex.split("[.,;:!?\x0a-\x0d]", lower):
            ws = regex.findall("[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in (1, 2, 3):
                counts.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    inside = {}
    for (lang, p), a in counts.items():
        if len(p) == 3 and a >= least:
            for q in {p[:2], p[1:]}:
                inside[lang, q] = max(inside.get((lang, q), 0), a)
    out = []
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least and not 100 * inside.get((lang, p), 0) >= 50 * a:
            cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], words[lang], score))
    ranked = []
    for lang in words:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(own[:top], 1)]
    return sorted(ranked)


@pytest.mark.parametrize("top, frontier, held", [(2000, 8000, 1 << 20), (30, 5, 1 << 20), (30, 5, 3), (7, 1, 0)])
def test_collocations_equal_brute_force(spark, plain, top, frontier, held):
    rows = [(r.lang if r.doc_id % 5 else None, r.text) for r in plain.collect()] + [("en", None), (None, ""), ("xx", "one two"), ("xx", " . ,")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, a int, score int")
    got = collocations.collocations(docs, top, 5, frontier, held)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, top, 5)


def test_collocations_ties_repeats_and_empty(spark, no_documents):
    assert collocations.collocations(no_documents).collect() == []
    rows = [("en", "É x, É x; a b c\ta b c"), ("en", None), ("en", "")] * 6 + [("en", "w" * 100_000 + " " + "v" * 1000)] * 10
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == brute_force(rows, 2000, 10)


# ---------------------------------------------------------------- whitening


def checked_against_numpy(rows, found):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in good)
    x = np.floor(256 * np.array([list(v) + [0.0] * (dims - len(v)) for _, v in good], dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    k = min(4, dims)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    want = (x - total / n) @ vectors / np.sqrt(values)
    by_row = {}
    for r in found:
        by_row.setdefault(r.vec_id, []).append(r)
    assert len(found) == k * len(good)
    got = np.array([[r.whitened for r in sorted(by_row[i], key=lambda r: r.component)] for i, _ in good])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    for (i, _), row in zip(good, x.tolist()):
        assert {(r.n, r.deviation) for r in by_row[i]} == {(n, sum((n * c - int(t)) ** 2 for c, t in zip(row, total)))}
    share = values / np.linalg.eigvalsh(centred.T @ centred / n).sum()
    assert np.allclose([r.explained for r in sorted(by_row[good[0][0]], key=lambda r: r.component)], share, rtol=1e-9)
    assert max(r.identity_error for r in found) < 1e-9


def test_whitening_of_driver_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    checked_against_numpy([(r.vec_id, r.embedding) for r in table.collect()], whitening.whiten(table).collect())


def test_whitening_awkward_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 6)) * [5, 4, 3, 2, 1, 1] + [1e5, 0, -3e4, 0, 0, 7]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, base[0].tolist()) for i in range(30)]  # copies count once
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, [99_000.0, 1.0]), (205, [])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n int, component int")
    checked_against_numpy(rows, whitening.whiten(table).collect())


def test_whitening_without_variance_or_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], kind)).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.identity_error) for r in one} == {(1, 0, None, None)}
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}


def test_large_entries_are_exact(spark):
    y = np.array([[2**40 + 3, -(2**33)], [-7, 2**21], [2**45, 5]], dtype=np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(2)] for i in range(2)]
    assert whitening.products(y).tolist() == want
    table = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(y / 256)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(table).collect()} == {None}  # beyond a long


@pytest.mark.parametrize("kind", range(4))
def test_spectral_division(kind):
    rng = np.random.default_rng(kind)
    n = 48
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    e = [rng.uniform(0, 1, n), np.r_[np.ones(n // 2), np.zeros(n // 2)], 10.0 ** -rng.uniform(0, 12, n), np.full(n, 2.0)][kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.eigen(a)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13


def test_summed_parts_are_exact():
    for v in (0, 1, -1, 10**30, -(10**30) + 7, (1 << 119) - 1):
        assert sum(p[0] << (whitening.PART * k) for k, p in enumerate(whitening._parts([v]))) == v
