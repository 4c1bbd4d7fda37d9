"""Many rows under one key, many equal rows, and values that look alike."""

import zlib

import numpy as np
import pytest
from proxyscope.llm import chat, embedding_dedup, fingerprint, graph, mixing, packing, toxicity
from proxyscope.llm.common import numbered


def test_null_texts_fill_one_sequence(spark):
    docs = spark.createDataFrame([(i if i % 3 else None, None) for i in range(1500)], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows) == list(range(1500))


def test_equal_rows_are_dealt_to_several_groups(spark):
    docs = spark.createDataFrame([(7, "one two three")] * 6000, "doc_id long, text string")
    rows = packing.pack_documents(docs, group_items=500).collect()
    groups = {}
    for r in rows:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(rows) == 6000 and len(groups) >= 10 and max(groups.values()) < 1000


def test_pieces_against_the_tokenizer(spark, plain):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = {r.doc_id: r.text or "" for r in plain.select("doc_id", "text").collect()} | {-1: "a <|endoftext|> b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {}
    for i, t in texts.items():
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = packing.pack_documents(docs).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(v[1] for v in want.values())
    assert len(places) <= -(-total // 2048) * 1.02 + 1


def test_separators_do_not_join_conversations(spark):
    turns = [(1, 1, "a\x1fb", "c"), (2, 1, "a", "b\x1fc"), (3, 1, "a", "b\x1fc"), (4, 1, "2", "x"), (5, 1, "", "2x")]
    rows = chat.render(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    assert {r.conv_id: r.copies for r in rows} == {1: 1, 2: 2, 4: 1, 5: 1}


def test_snapshots_of_a_common_first_turn(spark):
    turns = [(c, t, "user", "hello" if t == 1 else f"{c % 5} {t}") for c in range(60) for t in range(1, 2 + c % 4)]
    rows = chat.render(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    convs = {}
    for c, t, _, text in turns:
        convs.setdefault(c, []).append(text)
    kinds = {}
    for c in sorted(convs):
        kinds.setdefault(tuple(convs[c]), []).append(c)
    whole = {k: v for k, v in kinds.items() if not any(len(o) > len(k) and o[: len(k)] == k for o in kinds)}
    want = {v[0]: (len(v), sum(len(o) < len(k) and k[: len(o)] == o for o in kinds)) for k, v in whole.items()}
    assert {r.conv_id: (r.copies, r.snapshots) for r in rows} == want


def test_one_row_stands_for_a_labelled_id(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(3000)] + [(2, "b"), (None, "c")] + [(2, "b")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled_sample(docs, labels).num_rows == 2


def test_a_third_of_the_vectors_without_id(spark):
    rows = [(None if i % 3 == 0 else i, [1.0, float(i)] if i % 2 else None, 1) for i in range(300)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert found.count() == 300
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "array_repeat" not in plan


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (201, 200), (202, 201), (200, 202)]
    pairs += [tuple(map(int, rng.integers(300, 500, 2))) for _ in range(120)]
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    alone = {a for a, b in pairs if a == b} - {n for a, b in pairs if a != b for n in (a, b)}
    rows = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {n: c for n, c in label.items() if n not in alone}
    assert len(rows) == len({r.node for r in rows})
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_third_of_the_documents_without_id_are_mixed(spark):
    """They lie in many shards, and every pass of the mix holds the words it counts."""
    rows = [(i if i % 3 else None, f"w{i} " * (i % 50), "a" if i % 2 else "b") for i in range(3000)]
    docs = spark.createDataFrame([*rows, *[(None, None, "a")] * 500], "doc_id long, text string, source string")
    placed = mixing.placed_documents(numbered(docs)).where("size > 0").collect()
    assert len(placed) == sum(1 for _, t, _ in rows if t) and len({(r["_row_text"], r["_row_place"]) for r in placed}) == len(placed)
    first = {}
    for r in placed:  # a shard of one source ends where another begins, so places never overlap
        first.setdefault(r.source, []).append(sum((p["end"] - p["start"]) for p in r.parts))
    assert {s: sum(v) for s, v in first.items()} == {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    taken = sum(r.taken for r in mixing.mix_sources(docs).collect())
    assert sum(len(r.text.split()) for r in mixing.mixed_documents(docs).collect()) == taken
    same = sorted((r.source, r.text) for r in mixing.mixed_documents(docs).collect())
    assert same == sorted((r.source, r.text) for r in mixing.mixed_documents(docs.repartition(5)).collect())


def test_shards_grow_with_the_rows():
    for n, digits in ((0, 2), (256 * 4096, 2), (256 * 4096 + 1, 3), (4096 * 4096 + 1, 4)):
        assert mixing.shard_digits(n) == digits


ID_SETS = {
    "dense": list(range(4000)),
    "a third null": [i if i % 3 else None for i in range(6000)],
    "one outlier": [*range(4000), 1 << 60],
    "one id for a third": [i if i % 3 else 5000 for i in range(6000)],
    "extremes": [-(1 << 63), (1 << 63) - 1, 0, None, *range(-500, 500)],
    "all null": [None] * 1000, "one": [7], "none": [],
}


@pytest.mark.parametrize("case", ID_SETS)
def test_next_documents_make_one_ring_in_small_runs(spark, case):
    ids = ID_SETS[case]
    docs = numbered(spark.createDataFrame([(d, f"t{i}") for i, d in enumerate(ids)], "doc_id long, text string"))
    runs = [r["count"] for r in docs.select(fingerprint.run_of(docs, 64).alias("run")).groupBy("run").count().collect()]
    assert max(runs, default=0) <= 400
    rows = fingerprint.with_next(docs.select("doc_id", "text")).collect()
    assert len(rows) == len(ids)
    by_row = {r.row: r for r in rows}
    assert len(by_row) == len(ids) and {r.next_row for r in rows} == set(by_row)
    down = lambda d: (d is None, -(d or 0))
    breaks = 0
    for r in rows:
        after = by_row[r.next_row]
        assert r.next_text == after.text
        breaks += down(after.doc_id) < down(r.doc_id)
    assert breaks <= 1  # from the last row back to the first, and nowhere else
