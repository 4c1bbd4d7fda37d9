"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proxyscope.llm import chat, embedding_dedup, fingerprint, jaccard, langid, lines, lm_score, mixing, packing, toxicity

from .conftest import PROSE, awkward_rows, long_text

ROWS = len(awkward_rows())
LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (8, None, 1), (None, 0, 1), (99, 0, 0), (7, 0, None)]
    return spark.createDataFrame(rows, LABELS)


OPERATORS = {
    "jaccard": jaccard.jaccard_classes,
    "lm": lm_score.score_documents,
    "toxicity": lambda d: toxicity.score_toxicity(d, labels(d.sparkSession)),
    "fingerprint": fingerprint.edited_fingerprints,
    "lines": lines.dedup_lines,
    "langid": langid.identify,
    "mixing": mixing.mix_sources,
}


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(awkward, name):
    rows = OPERATORS[name](awkward).collect()
    assert len(rows) == ROWS
    assert ids(rows) == ids(awkward.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(no_documents, name):
    assert OPERATORS[name](no_documents).collect() == []


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_jaccard_cases(awkward):
    r = by_id(jaccard.jaccard_classes(awkward).collect())
    assert r[1].class_id == r[6].class_id == r[10].class_id == 1
    assert r[1].n_links == 3 and r[6].n_links == 3 and r[10].n_links == 3 and r[1].n_copies == 3
    for i in (2, 3, 4, 5, 7, 8, 9, 11, 12):
        assert (r[i].class_id, r[i].n_links) == (i, 0)


def test_language_cases(awkward):
    r = by_id(langid.identify(awkward).collect())
    assert {i: r[i].lang_pred for i in (2, 3, 4, 9)} == dict.fromkeys((2, 3, 4, 9), "und")
    assert all(0 <= x.score <= 1 for x in r.values())


def test_language_without_labels(awkward):
    rows = langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_score_cases(awkward):
    r = by_id(lm_score.score_documents(awkward).collect())
    assert r[2].score == r[3].score and r[2].n_tokens == 1 and r[2].n_bytes == 0
    assert r[5].n_tokens == len(long_text().split()) + 1
    assert all(x.score < 0 and x.base_score < 0 for x in r.values())


def test_score_without_training_rows(awkward):
    rows = lm_score.score_documents(awkward, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known) for r in rows} == {(0, 0)}
    assert all(abs(r.bits_per_byte - 8) < 1e-9 for r in rows)


def test_mixing_cases(awkward):
    rows = mixing.mix_sources(awkward).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    r = by_id(rows)
    assert r[2].size == r[3].size == r[4].size == 0 and r[2].taken == 0
    german = awkward.where("doc_id = 8").first().text
    assert r[7].source_size == 1 + len(german.split())


def test_lines_cases(awkward):
    rows = lines.dedup_lines(awkward).collect()
    r = by_id(rows)
    assert r[1].spans == [] or all(s.start > 0 for s in r[1].spans)
    assert PROSE.strip() not in r[10].text and "One more line." in r[10].text
    assert r[2].text is None and r[3].text == "" and r[5].text == long_text()
    source = {x.doc_id: x.text for x in awkward.select("doc_id", "text").collect()}
    for x in rows:
        if x.doc_id is None or not x.spans:
            continue
        raw = source[x.doc_id].encode()
        assert sum(s.end - s.start for s in x.spans) == x.n_removed == len(raw) - len(x.text.encode())


def test_packing_cases(awkward, no_documents):
    rows = packing.pack_documents(awkward).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert [(r.length, r.start) for r in by_doc[2]] == [(1, 0)] == [(r.length, r.start) for r in by_doc[3]]
    assert len(by_doc[6]) == 2 and len(by_doc[5]) > 10
    assert packing.pack_documents(no_documents).collect() == []


def test_fingerprint_cases(awkward):
    r = by_id(fingerprint.edited_fingerprints(awkward).collect())
    assert r[1].fingerprint == r[6].fingerprint != r[10].fingerprint
    assert r[2].fingerprint == r[3].fingerprint and r[2].n_chars == 0
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in r.values())


def test_toxicity_without_labels(awkward, spark):
    rows = toxicity.score_toxicity(awkward, spark.createDataFrame([], LABELS)).collect()
    assert {(r.p_toxic, r.toxic) for r in rows} == {(0.5, False)}


CONVERSATIONS = "conv_id long, turn long, role string, text string, size int, position int"


def test_chat_cases(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 0, "user", "hi"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (5, 0, None, None), (6, 0, "user", None), (None, 0, "user", "lost"),
        (7, 0, "user", "hi"), (7, 1, "assistant", "hello"), (7, 2, "user", "bye"), (8, 1, "user", "b"), (8, 1, "user", "a"), (8, None, "system", "s"),
    ]
    df = spark.createDataFrame([(*t, 0, 0) for t in turns], CONVERSATIONS)
    r = {x.conv_id: x for x in chat.render(df).collect()}
    assert set(r) == {5, 7, 8}
    assert (r[7].n_turns, r[7].copies, r[7].snapshots) == (3, 1, 2)
    assert r[5].copies == 2 and r[5].rendered == "<|im_start|>user\n<|im_end|>\n"
    assert [p.split("<|im_end|>")[0] for p in r[8].rendered.split("<|im_start|>")[1:]] == ["system\ns", "user\na", "user\nb"]
    assert chat.render(spark.createDataFrame([], CONVERSATIONS)).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, node string, bucket int"


def test_embedding_cases(spark):
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, [0.0, 0.0, 0.0], 1), (5, None, 1),
        (6, [1.0, None, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, [1.0, 0.0, 0.0], None), (9, [2.0, 0.0, 0.0], 1),
        (9, [2.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 1), (11, [], 1), (None, [0.0, 1.0, 0.0], 1), (12, [float("inf"), 1.0, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    out = embedding_dedup.near_vectors(df).collect()
    assert len(out) == len(rows)
    r = {x.vec_id: x for x in out}
    assert (r[1].component_id, r[2].component_id, r[9].component_id) == (1, 1, 1)
    assert (r[1].n_links, r[2].n_links, r[9].n_links) == (3, 3, 3)
    for i in (3, 4, 5, 6, 7, 8, 10, 11, 12):
        assert (r[i].n_links, r[i].component_id, r[i].kept) == (0, i, True)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_stages(spark, awkward, no_documents, name, step):
    out = step(spark, awkward, "/root/testdata/sf0.001")
    if name != "pack":
        assert out.schema.names == awkward.schema.names
        assert [f.dataType for f in out.schema] == [f.dataType for f in awkward.schema]
    rows = out.collect()
    assert rows and len([r for r in rows if r.doc_id == 5]) >= 1
    assert step(spark, no_documents, "/root/testdata/sf0.001").collect() == []
    if name == "language_id":
        assert {1, 5, 6, 7, 8, 10}.issubset({r.doc_id for r in rows}) and not {2, 3, 4, 9} & {r.doc_id for r in rows}
    if name == "jaccard_join":
        got = sorted(r.doc_id for r in rows if r.doc_id)
        assert got == [1, 2, 3, 4, 5, 7, 8, 9, 11, 12]
    if name == "substring_dedup":
        assert len(rows) == ROWS and all(r.text is None or r.n_chars == len(r.text) for r in rows)
    if name == "mix":
        assert all(r.n_chars == len(r.text) for r in rows) and 2 not in {r.doc_id for r in rows}


def test_stages_are_the_agreed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "mix", "pack"]
