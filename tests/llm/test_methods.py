"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proxyscope.llm import chat, common, ctw_kernel, embedding_dedup, fingerprint, graph, jaccard, langid, lines, lm_score, mixing, packing, toxicity

SF = "/root/testdata/sf0.001"


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# common


def test_words_match_plain_python():
    texts = ["Hello  World\nfoo", "", "  x ", "Ä b\tC", "end"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    w = common.Words(data, offsets)
    split = [t.encode().lower().split() for t in texts]
    assert w.row.tolist() == [i for i, ws in enumerate(split) for _ in ws]
    assert [data.tobytes()[a:b].lower() for a, b in zip(w.start, w.end, strict=True)] == [x for ws in split for x in ws]
    again = common.Words(np.frombuffer(b"foo hello", np.uint8), np.array([0, 9])).hash
    assert w.hash[2] == again[0] and w.hash[0] == again[1] and len(set(w.hash.tolist())) == len({x for ws in split for x in ws})


# 1


def shingle_set(text):
    w = text.encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_equals_brute_force(plain):
    docs = texts_of(plain)
    sets = {i: shingle_set(t) for i, t in docs.items()}
    links = defaultdict(set)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i].add(j)
                links[j].add(i)
    first = {}
    for i in sorted(docs):
        if i in first:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in first:
                first[k] = i
                todo.extend(links[k])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_classes(plain).collect()}
    assert got == {i: (first[i], len(links[i])) for i in docs}
    assert any(n for _, n in got.values())


def test_one_row_of_each_class_goes_by_row(spark):
    """Null and repeated ids: only the copies go, one of each class stays."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    near = lambda name: text(name) + " end"
    rows = [(1, text("a")), (None, near("a")), (None, text("b")), (None, text("c")), (2, text("d")), (2, near("a")), (3, text("e")), (3, near("d")),
            (None, text("f")), (None, near("f")), (None, text("g")), (None, text("g")), (4, text("h")), (4, text("h")), (None, None), (None, ""), (5, " ")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, node int")
    got = Counter((r.doc_id, r.text) for r in jaccard.keep_one_of_each(df).collect())
    assert sum(got.pop((None, t), 0) for t in (text("f"), near("f"))) == 1
    want = [(1, "a"), (None, "b"), (None, "c"), (2, "d"), (3, "e"), (None, "g"), (4, "h")]
    assert got == Counter([*((i, text(n)) for i, n in want), (None, None), (None, ""), (5, " ")])


def test_large_group_is_split_into_blocks(spark, monkeypatch):
    """A group of near copies larger than a block: every link is counted once."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], f"other{i}", *base[i + 1 :]])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.jaccard_classes(df).collect()
    sets = {i: shingle_set(t) for i, t in rows}
    want = {i: sum(5 * len(a & b) >= 4 * len(a | b) for j, b in sets.items() if j != i) for i, a in sets.items()}
    assert {r.doc_id: r.n_links for r in out} == want and {r.class_id for r in out} == {0}


def test_bayesian_bounds_keep_true_pairs():
    """The fewest matches allowed are far below what a pair at the threshold has."""
    rng = np.random.default_rng(5)
    least = jaccard.least_matches()
    lost = 0
    for _ in range(2000):
        equal = rng.random(jaccard.HASHES) < 0.8
        lost += any(equal[:n].sum() < m for n, m in least.items())
    assert lost == 0
    other = (rng.random((2000, jaccard.HASHES)) < 0.3).astype(np.uint8)
    assert jaccard.may_reach(np.ones(jaccard.HASHES, np.uint8), other, least).mean() < 0.01


def test_shared_sizes():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(9)]
    got = jaccard.shared_sizes(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(set(a.tolist()) & set(b.tolist()))
    assert jaccard.shared_sizes(sets[:2])[0, 1] == got[0, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 120, (70, 2))] + [(200, i) for i in range(201, 240)] + [(300 + i, 301 + i) for i in range(25)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# 2


def test_scores_equal_brute_force(plain, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 40_000)
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", 5_000)
    monkeypatch.setattr(lm_score, "COUNTS_HELD", 20_000)
    monkeypatch.setattr(lm_score, "CHUNKS_PER_GROUP", 3)
    docs = {i: t.encode() for i, t in texts_of(plain).items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter()
    for i, t in docs.items():
        if not held[i]:
            counts.update([*t.lower().split(), None])
    total = sum(counts.values())
    base = math.log10(total + len(counts) + 1)
    grams, _ = ctw_kernel.text_grams([t for i, t in docs.items() if not held[i]], lm_score.DEPTH)
    tree = ctw_kernel.Tree(*np.unique(grams, return_counts=True), lm_score.DEPTH, 0)
    rows = lm_score.score_documents(plain).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = [*docs[r.doc_id].lower().split(), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert math.isclose(r.base_score, sum(math.log10(counts[w] + 1) - base for w in words), rel_tol=1e-9)
        own, _ = ctw_kernel.text_grams([docs[r.doc_id]], lm_score.DEPTH)
        want = sum(np.log10(tree.bit_probability(own, lm_score.DEPTH, k)).sum() for k in range(8))
        assert math.isclose(r.score, want, rel_tol=1e-6)


def test_tree_equals_textbook_recursion():
    """Weighted and predicted probabilities from the definition, node by node."""
    depth, train, probe = 2, [b"abracadabra", b"abba"], b"abrab"
    grams, _ = ctw_kernel.text_grams(train, depth)
    seen = [(int(g) & 255, [(int(g) >> 8 * (depth - d)) & 255 for d in range(depth)]) for g in grams]

    def kt(zeros, ones):
        p = 1.0
        for i in range(zeros):
            p *= (i + 0.5) / (i + 1)
        for i in range(ones):
            p *= (i + 0.5) / (zeros + i + 1)
        return p

    def weighted(context, prefix, more=()):
        bits = [(b >> 7 - len(prefix)) & 1 for b, c in [*seen, *more] if c[: len(context)] == context and [(b >> 7 - i) & 1 for i in range(len(prefix))] == prefix]
        pe = kt(bits.count(0), bits.count(1))
        if len(context) == depth:
            return pe
        deeper = 1.0
        for x in {c[len(context)] for _, c in [*seen, *more] if c[: len(context)] == context}:
            deeper *= weighted([*context, x], prefix, more)
        return 0.5 * pe + 0.5 * deeper

    u, n = np.unique(grams, return_counts=True)
    tree = ctw_kernel.Tree(u, n, depth, 0)
    own, _ = ctw_kernel.text_grams([probe], depth)
    for g in own:
        byte, context = int(g) & 255, [(int(g) >> 8 * (depth - d)) & 255 for d in range(depth)]
        for k in range(8):
            prefix = [(byte >> 7 - i) & 1 for i in range(k)]
            want = weighted([], prefix, [(byte, context)]) / weighted([], prefix)
            got = tree.bit_probability(np.array([g]), depth, k)[0]
            assert math.isclose(got, want, rel_tol=1e-9)


def test_probabilities_of_all_bytes_sum_to_one():
    grams, _ = ctw_kernel.text_grams([b"the cat sat on the mat", b"a cat"], 3)
    tree = ctw_kernel.Tree(*np.unique(grams, return_counts=True), 3, 0)
    for context in (0x746163, 0x7A7A7A):
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        total = np.prod([tree.bit_probability(every, 3, k) for k in range(8)], axis=0).sum()
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_each_run_of_grams_is_sorted_once():
    rng = np.random.default_rng(2)
    for depth, n in ((5, 200_000), (2, 1000), (7, 1000), (5, 1), (5, 1 << 16)):
        grams = ctw_kernel.grams_of(rng.choice(np.array([32, 97, 98, 0xC3, 255], np.uint8), n + depth), depth)
        back = np.empty(n, np.uint64)
        at = 0
        for keys, counts, order in lm_score.ranked(grams, depth):
            assert (np.diff(keys.astype(object)) > 0).all()
            back[at : at + len(order)][order] = np.repeat(keys, counts)
            at += len(order)
        assert at == n and (back == grams).all()


def test_words_of_texts_equal_split():
    texts = [b"", b" A b\x0bB\n", "ÉA\u00a0x é".encode(), b"", b"b", b"\t", b"a"]
    found, index, first = lm_score.words_of(texts)
    assert len(set(found)) == len(found)
    words = [found[i] for i in index]
    assert [words[a:b] for a, b in zip(first[:-1], first[1:])] == [t.lower().split() for t in texts]
    assert lm_score.words_of([b""])[0] == []


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (lm_score.unpack_sorted(lm_score.pack_sorted(x)) == x).all()
    y = rng.random(77).astype("<f4")
    assert (lm_score.unpack_numbers(lm_score.pack_numbers(y, "<f4"), "<f4") == y).all()


# 3


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    wide = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score_toxicity(wide, labels.where("doc_id % 2 = 0")).where("doc_id % 2 = 1").collect()
    rows = [r for r in rows if r.doc_id in known]
    hit = sum(r.toxic and known[r.doc_id] for r in rows)
    assert hit / sum(known[r.doc_id] for r in rows) > 0.75
    assert sum(r.toxic and not known[r.doc_id] for r in rows) <= 0.01 * len(rows)
    assert docs.count() == len(toxicity.score_toxicity(docs, labels).collect())


def test_chain_reads_earlier_categories():
    """The second category is the first one's, which the words tell: its model uses that."""
    rng = np.random.default_rng(4)
    first = np.arange(0, 4001, 10)
    ids = rng.integers(0, 300, 4000)
    y = (rng.random(400) < 0.5).astype(float)
    ids[::10] = np.where(y == 1, 500, 501)
    chain = toxicity.fit_chain(ids, first, np.zeros((400, toxicity.N_FORM)), np.stack([y, y], axis=1), np.arange(400) % 5)
    assert len(chain[1].numbers) == toxicity.N_FORM + 1 and chain[1].numbers[-1] > 0.5


# 5


def test_fingerprints_are_homomorphic(spark):
    rows = [(0, "One.\nTwo.\nThree."), (1, "Three.\nOne.\nTwo."), (2, "One.\nTwo."), (3, "Three."), (4, "One.\nTwo.\nThree.\nOne.")]
    df = spark.createDataFrame(rows, "k long, t string")
    f = {r.k: r for r in fingerprint.fingerprints(df, ["k"], "t").collect()}
    assert (f[0].wide, f[0].signs) == (f[1].wide, f[1].signs) != (f[4].wide, f[4].signs)
    pair = spark.createDataFrame([(f[2].wide, f[3].wide, f[0].wide)], "a array<long>, b array<long>, c array<long>")
    got = pair.select(fingerprint.combine(F.col("a"), F.col("b")).alias("plus"), fingerprint.combine(F.col("c"), F.col("b"), -1).alias("minus")).first()
    assert got.plus == f[0].wide and got.minus == f[2].wide


def test_likeness_orders_edits(plain):
    rows = fingerprint.edited_fingerprints(plain).where("n_chars > 1500").collect()
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.2


# 6


def test_tokens_equal_the_whole_tokenizer(plain):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    whole = Tokenizer.from_file(path)
    words = packing.WordTokenizer(path, kept=200)
    odd = ["", "b\x1cc d\x1fe", "İstanbul É é ... 12３ ﬁ ß ẞ Σας don't I'M we'LL x_y __ ''s", "日本語 🙂🙂 a\xa0b c d\x85e", "x²³ ½ º ª µ × ÷ ¿¡", "A\tB\nC\x0bD\x0cE", "<|endoftext|>a", "a <|endoftext|> b", "é<|startoftext|>日本", "<|ENDOFTEXT|> x"]
    for text in [*odd, *texts_of(plain).values()]:
        want = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert words.ids(text) == want


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_keeps_every_limit(rule):
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 100, 500)
    for capacity in [(100, 500, 10_000), (100, 4, 10_000), (100, 500, 3_000_0), (200, 6, 12_000)]:
        where = packing.best_fit(tokens, capacity, rule=rule)
        for b in range(where.max() + 1):
            t = tokens[where == b]
            assert t.sum() <= capacity[0] and len(t) <= capacity[1] and (t * t).sum() <= capacity[2] + 1e-6
    assert packing.best_fit(tokens, (100, 500, 10_000), rule=rule).max() + 1 <= math.ceil(tokens.sum() / 100) * 1.04


def test_packing_is_close_to_full(plain):
    rows = packing.pack_documents(plain).collect()
    tokens = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= math.ceil(tokens / packing.CAPACITY * 1.03) + 1
    for r in rows[:50]:
        assert 0 < r.length <= packing.CAPACITY and r.start % packing.CAPACITY == 0


# 7


def test_rotations_keep_lengths_and_vertices_are_nearest():
    x = np.random.default_rng(1).normal(size=(50, 24))
    y = embedding_dedup.rotate(x, 3)
    assert y.shape == (50, 32) and np.allclose((y * y).sum(1), (x * x).sum(1))
    axis, size = embedding_dedup.vertices(y, 2)
    assert (size[:, 0] == np.abs(y).max(1)).all() and (np.sign(y[np.arange(50), axis[:, 0] // 2]) == np.where(axis[:, 0] % 2, -1, 1)).all()


def test_near_pairs_share_a_bucket():
    """Pairs just above the threshold meet in some bucket."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.93
    near = c * a + math.sqrt(1 - c * c) * b
    x, y = (embedding_dedup.bucket_numbers(v) for v in (a, near))
    met = np.array([bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist(), strict=True)])
    assert met.mean() > 0.995


# 8


def test_repeated_passage_is_removed_wherever_it_stands(spark):
    rng = np.random.default_rng(6)
    word = lambda n: " ".join("".join(rng.choice(list("aeioustnr"), rng.integers(2, 9))) for _ in range(n))
    passage = word(55)
    rows = [(i, f"{word(40)} {passage if i in (2, 5, 8) else word(55)} {word(30)}") for i in range(10)]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i: r.n_removed for i, r in out.items() if r.n_removed}
    assert set(gone) == {5, 8} and all(n == len(passage) for n in gone.values())
    for i in (5, 8):
        (span,) = out[i].spans
        text = dict(rows)[i].encode()
        assert text[span.start : span.end].decode() == passage
        assert (text[: span.start] + text[span.end :]).decode() == out[i].text


def test_runs_reach_to_the_ends_of_passages_and_no_further(spark):
    """Passages of 51 to 400 words among unique words: what goes stood earlier, word for word,
    and at least 95% of each later passage goes. Words beside them differ in case only, or in all."""
    rng = np.random.default_rng(16)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 9))
    passages = [" ".join(word() if rng.random() < 0.7 else "the" for _ in range(n)) for n in (51, 51, 60, 80, 120, 400)] + [" ".join(["same"] * 60 + [word() for _ in range(60)])]
    rows, planted = [], {}
    for i in range(40):
        parts = []
        for k in rng.permutation(len(passages))[: rng.integers(1, 4)]:
            parts += [" ".join(word() for _ in range(rng.integers(1, 30))), passages[k].upper() if i % 5 == 0 else passages[k]]
            planted.setdefault(int(k), []).append(i)
        rows.append((i, " ".join([*parts, word()])))
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    before = ""
    for i, text in rows:
        raw, at = text.encode(), 0
        for span in out[i].spans:
            cut = " ".join(raw[span.start : span.end].decode().lower().split())
            here = " ".join(raw[: span.start].decode().lower().split())
            assert f" {cut} " in f"{before} | {here} ", cut
            at += span.end - span.start
        assert at == out[i].n_removed
        before += " | " + " ".join(text.lower().split())
    left = {i: f" {' '.join(r.text.lower().split())} " for i, r in out.items()}
    for k, where in planted.items():
        ws = passages[k].lower().split()
        assert f" {' '.join(ws)} " in left[where[0]]
        for i in where[1:]:
            run = max((n for n in range(len(ws)) for a in range(len(ws) - n + 1) if f" {' '.join(ws[a : a + n])} " in left[i] and len(set(ws[a : a + n]) - {"the", "same"}) > 1), default=0) if len(ws) < 130 else 0
            assert run <= 0.05 * len(ws) + 1, (k, i, run)


def test_long_equal_stretches_are_compared_to_their_ends(spark):
    """Hundreds of equal words without a cut beside a repeated run, and a text of one word."""
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("klmnop"), 9))
    shared = " ".join(["x"] * 700 + [word() for _ in range(40)] + ["y"] * 900)
    rows = [(1, f"{word()} {shared} {word()}"), (2, f"{word()} {shared} {word()}"), (3, " ".join(["z"] * 500)), (4, None), (None, shared)]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[None].text == shared  # a null id ranks first
    for i in (1, 2):
        assert out[i].n_removed == len(shared) and len(out[i].text.split()) == 2
    assert out[3].n_removed == 0 and out[4].text is None


def test_lines_equal_brute_force(spark):
    """Whole lines of enough words: first occurrence by (doc_id, position) stays."""
    rng = np.random.default_rng(7)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 15)) for _ in range(30)]
    rows = [(int(i), "\n".join(pool[j] for j in rng.integers(0, 30, 8))) for i in range(20)]
    seen, want = set(), {}
    for i, t in rows:
        keep = []
        for line in t.split("\n"):
            if line not in seen:
                keep.append(line)
            seen.add(line)
        want[i] = keep
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: [x for x in t.split("\n") if x] for i, t in out.items()} == want


def test_lines_of_all_lengths_equal_brute_force(spark):
    """Every line with a word is a unit, however short; case and white space do not matter."""
    rng = np.random.default_rng(9)
    pool = [" ".join(f"W{j}x{k}" for k in range(1 + j % 15)) for j in range(60)]
    rows = [(int(i), "\n".join([f"only{i}", *(pool[j] for j in rng.integers(0, 60, 12))])) for i in range(20)]
    rows[7] = (7, rows[7][1].lower().replace(" ", " \t ").replace("\n", " \r\n\n"))
    seen, want = set(), {}
    for i, t in rows:
        want[i] = []
        for line in (" ".join(x.lower().split()) for x in t.split("\n")):
            if line and line not in seen:
                want[i].append(line)
            seen.add(line)
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: [y for x in r.text.split("\n") if (y := " ".join(x.lower().split()))] for r in out}
    assert got == want


def test_spans_stay_with_their_row(spark):
    """Rows under one id or none are cut at their own spans only, and are repeats of each other."""
    line = lambda name: " ".join(f"{name}{k}" for k in range(14))
    own = [(None if i % 2 else 5, f"{line(f'own{i}q')}\n{line(f'more{i}q')}") for i in range(8)]
    twice = [(None, line("twice"))] * 3
    rows = [*own, *twice, (1, line("one")), (5, f"{line('five')}\n{line('one')}"), (None, "x"), (5, "yy"), (None, None), (5, "")]
    want = Counter([*own, (None, line("twice")), (None, ""), (None, ""), (1, line("one")), (5, line("five") + "\n"), (None, "x"), (5, "yy"), (None, None), (5, "")])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in lines.dedup_lines(df).collect()) == want
    assert Counter((r.doc_id, r.text) for r in lines.remove_repeats(df).collect()) == want


# 9


def test_language_accuracy_on_held_out(plain, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in langid.identify(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.97


def test_texts_in_no_learnt_language_go_and_others_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(4)
    alphabets = ("的一是不了人我在有他", "abcdefghijklmnopqrstuvwxyz", "!?;:-_()[]{}<>a")
    junk = [(-1 - i, "".join(rng.choice(list(alphabets[i % 3]), 3000))) for i in range(30)]
    rows = docs.unionByName(spark.createDataFrame(junk, "doc_id bigint, text string"), allowMissingColumns=True)
    lettered = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    kept = {r.doc_id for r in langid.keep_identified(rows).collect()}
    assert not {i for i, _ in junk} & kept and kept <= lettered
    assert len(kept) >= 0.99 * len(lettered)


def test_lowest_score_follows_the_number_of_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for languages in (["de"], ["de", "en"]):
        some = docs.where(F.col("lang").isin(languages))
        network = langid.fit(some, ~langid.held_out())
        least = langid.lowest_score(some, network)
        held = some.where(langid.held_out() & F.col("text").rlike(r"\p{L}")).select("lang", "text").collect()
        best, score = langid._score(network, pa.array([r.text for r in held]))
        right = np.sort(score[np.array(network.labels)[best] == np.array([r.lang for r in held])])
        weakest = right[int(np.ceil(langid.WEAKEST * len(right))) - 1]
        chance = 1 / len(languages)
        expected = 0.0 if len(languages) == 1 else chance + langid.LEEWAY * (weakest - chance)
        assert expected - 0.001 <= least <= expected + 1e-9
    assert langid.lowest_score(docs.where("false"), network) == 0.0


def test_tables_give_the_plain_convolution():
    rng = np.random.default_rng(1)
    net = langid.ByteNetwork(["a", "b"], rng)
    text = bytes(rng.integers(32, 200, 700).astype(np.uint8))
    data = np.frombuffer(text, np.uint8)
    got = langid.predict(net, net.tables(), data, np.array([0, len(text)]))[0]
    padded = np.concatenate([common._LOWER[data], np.zeros(3 * langid.STRIDE, np.uint8)])
    shares, weights = [], []
    for at in range(0, len(text) + langid._PAD, langid.STRIDE):
        pooled = []
        for w in langid.WIDTHS:
            r = [sum(net.kernel[w][k][padded[p + k]] for k in range(w)) for p in range(at, at + langid.STRIDE)]
            pooled.append(np.max(r, axis=0))
        shares.append(net.classify(np.concatenate(pooled)[None])[0])
        weights.append(min(max(len(text) - at, 0), langid.STRIDE))
    assert np.allclose(got, np.average(shares, axis=0, weights=weights), atol=1e-5)


# 10


def test_quotas_equal_highest_quotients(spark):
    rng = np.random.default_rng(9)
    parties = [(g, int(p), float(rng.integers(1, 500)), int(rng.integers(0, 40))) for g in range(3) for p in range(12)]
    seats = {0: 50, 1: 7, 2: 400}
    df = spark.createDataFrame([(*p, seats[p[0]]) for p in parties], "g long, p long, share double, cap long, seats long")
    got = {(r.g, r.tie0): r.quota for r in mixing.sainte_lague(df, ["g"], [F.col("p")]).collect()}
    for g in seats:
        quotients = sorted((-share / (2 * k + 1), p, k) for gg, p, share, cap in parties if gg == g for k in range(cap))
        want = Counter(p for _, p, _ in quotients[: seats[g]])
        assert {p: got[g, p] for gg, p, _, _ in parties if gg == g} == {p: want[p] for gg, p, _, _ in parties if gg == g}


def test_mixed_documents_hold_the_taken_words(plain):
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(plain).collect()}
    got = Counter()
    for r in mixing.mixed_documents(plain).collect():
        got[r.doc_id] += len(r.text.encode().split())
    assert {i: n for i, n in taken.items() if n} == dict(got)


def test_code_runs_where_the_repository_is_not_on_the_path():
    """Tasks get this subpackage's code by value."""
    from pyspark import cloudpickle

    assert b"proxyscope.llm.langid" not in cloudpickle.dumps(langid.predict)[:40] and cloudpickle.loads(cloudpickle.dumps(chat.op4_chat_format))
    assert pa.__version__
