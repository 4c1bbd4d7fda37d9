"""Language-model scores by context-tree weighting, learnt from the whole corpus.

The model is a context tree over bytes (``ctw_kernel``): each byte is eight binary choices,
each predicted by a mix, over all context depths, of Krichevsky-Trofimov estimates. Its
counts are those of all byte n-grams of the training texts, so the model grows with the
corpus and never lies in one place: n-grams are dealt to buckets by their two nearest
context bytes, which keeps whole subtrees together.

1. Tasks cut their documents into chunks of about 16 MB and write, per chunk, the texts and,
   per bucket, the distinct n-grams and words (sorted, compressed); and per task the counts
   of the training texts, summed up before they leave it.
2. Counts of a bucket are merged; each bucket weighs its subtrees and gives the sums that the
   top of the tree (one context byte: a bounded table) needs.
3. A bucket gives the log-probability of each n-gram that a chunk asks for.
4. A chunk puts these back in place and sums them per document.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyscope.llm import ctw_kernel as ctw
from proxyscope.llm.common import _SPACE, doc_crc, read, slices, stage, text_or_empty, utf8

# Fixed values of the production model.
DEPTH = 5
CHUNK_BYTES = 1 << 24
SEGMENT_BYTES = 1 << 20
BUCKET_BYTES = 1 << 24  # of text per bucket
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
COUNTS_HELD = 1_500_000  # n-grams or words a task sums up before it writes them
CHUNKS_PER_GROUP = 128  # a bucket's model is sent to each group of so many chunks

TEXTS, ASKED, WORDS, COUNTS, WORD_COUNTS, MODEL = range(6)


def held_out() -> Column:
    return F.pmod(doc_crc(), F.lit(7)) == 2


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=np.uint64(0)) if len(values) else values
    return zstandard.compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(values: np.ndarray, kind: str) -> bytes:
    width = np.dtype(kind).itemsize
    return zstandard.compress(values.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpack_numbers(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(b"\n".join(words), 3)


def unpack_words(raw: bytes) -> list[bytes]:
    return zstandard.decompress(raw).split(b"\n")


def bucket_of(grams: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """By the two nearest context bytes: subtrees below them stay whole."""
    near = (grams >> np.uint64(8 * (depth - 1))).astype(np.uint64)
    return ((near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(number: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in order) of every bucket that occurs."""
    order = np.argsort(number, kind="stable")
    cut = np.searchsorted(number[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), order[cut[b] : cut[b + 1]]


def segments(texts: list[bytes], depth: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(text numbers, n-grams, n-grams of each) for runs of texts of about SEGMENT_BYTES; a
    longer text comes in several pieces, each with its context."""
    run: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) > SEGMENT_BYTES:
            data = np.frombuffer(bytes([ctw.END]) * depth + text + bytes([ctw.END]), dtype=np.uint8)
            for at in range(0, len(text) + 1, SEGMENT_BYTES):
                grams = ctw.grams_of(data[at : at + SEGMENT_BYTES + depth], depth)
                yield [i], grams, np.array([len(grams)])
            continue
        if run and size + len(text) > SEGMENT_BYTES:
            yield run, *ctw.text_grams([texts[j] for j in run], depth)
            run, size = [], 0
        run.append(i)
        size += len(text)
    if run:
        yield run, *ctw.text_grams([texts[j] for j in run], depth)


def distinct_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, grams, _ in segments(texts, depth):
        k, c = np.unique(grams, return_counts=True)
        keys.append(k)
        counts.append(c)
    return ctw.merged(keys, counts)


def joint(sorted_runs: list[np.ndarray]) -> np.ndarray:
    """The distinct numbers of all runs, in order."""
    keys = np.sort(np.concatenate(sorted_runs))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def ranked(grams: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of n-grams: the distinct ones in order, how often each occurs, and the place in
    the run of every n-gram, in that order. Sorts n-gram and place as one number if both fit."""
    free = 64 - 8 * (depth + 1)
    size = 1 << min(free, 16)
    if free < 12:
        order = np.argsort(grams, kind="stable")
        yield *np.unique(grams, return_counts=True), order
        return
    for at in range(0, len(grams), size):
        part = grams[at : at + size]
        both = np.sort(part << np.uint64(free) | np.arange(len(part), dtype=np.uint64))
        keys = both >> np.uint64(free)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield keys[first], np.diff(np.append(first, len(part))).astype(np.int32), (both & np.uint64(size - 1)).astype(np.uint16)


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words with A-Z in lower case, which of these each word is, and the first
    word of each text (and the end)."""
    data = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))  # begin and end of each word, in turn
    bounds = np.concatenate([[0], np.cumsum(edge[1::2] - edge[::2])]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
    first = np.searchsorted(edge[::2], np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    own, cuts = utf8(words.dictionary)
    raw, cuts = own.tobytes(), cuts.tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], words.indices.to_numpy(), first


def gather(docs: DataFrame, trainable: Column, depth: int, buckets: int) -> DataFrame:
    """Step 1: rows (kind, chunk, bucket, a, b, ids, held), see the module's head."""
    id_type = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_id = None
        sums: dict[str, object] = {"grams": (np.zeros(0, np.uint64), np.zeros(0, np.int64)), "words": Counter()}

        def rows(kind, chunk, entries, ids=None, held=None):
            if not entries:
                return
            n = len(entries)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array([e[0] for e in entries], pa.int32()),
                 pa.array([e[1] for e in entries], pa.binary()), pa.array([e[2] for e in entries], pa.binary()),
                 pa.array([ids] * n, pa.list_(arrow_id)), pa.array([held] * n, pa.list_(pa.bool_()))],
                names=["kind", "chunk", "bucket", "a", "b", "ids", "held"],
            )

        def flush_grams():
            keys, counts = sums["grams"]
            sums["grams"] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            entries = [(b, pack_sorted(keys[at]), pack_numbers(counts[at], "<i8")) for b, at in by_bucket(bucket_of(keys, depth, buckets), buckets)]
            yield from rows(COUNTS, 0, entries)

        def flush_words():
            yield from rows(WORD_COUNTS, 0, [(b, pack_words(w), pack_numbers(np.array([sums["words"][x] for x in w]), "<i8")) for b, w in dealt_words(sums["words"], buckets)])
            sums["words"] = Counter()

        def emit(texts, ids, held):
            chunk = uuid.uuid4().int >> 65
            learn = [t for t, h in zip(texts, held, strict=True) if not h]
            test = [t for t, h in zip(texts, held, strict=True) if h]
            keys, counts = distinct_grams(learn, depth)
            sums["grams"] = ctw.merged([sums["grams"][0], keys], [sums["grams"][1], counts])
            asked, _ = ctw.merged([keys, more := distinct_grams(test, depth)[0]], [counts, np.zeros(len(more), np.int64)])
            found, index, first = words_of(texts)
            n = np.bincount(index[np.repeat(~np.array(held), np.diff(first))], minlength=len(found)).tolist()
            sums["words"].update({w: c for w, c in zip(found, n, strict=True) if c})
            body = zstandard.compress(b"".join(texts), 1)
            yield from rows(TEXTS, chunk, [(-1, body, np.array([len(t) for t in texts], "<i8").tobytes())], ids, held)
            yield from rows(ASKED, chunk, [(b, pack_sorted(asked[at]), None) for b, at in by_bucket(bucket_of(asked, depth, buckets), buckets)])
            yield from rows(WORDS, chunk, [(b, pack_words(w), None) for b, w in dealt_words(found, buckets)])
            if len(sums["grams"][0]) > COUNTS_HELD:
                yield from flush_grams()
            if len(sums["words"]) > COUNTS_HELD:
                yield from flush_words()

        texts, ids, held, size = [], [], [], 0
        for batch in batches:
            arrow_id = batch.column("doc_id").type
            for a, b, data, offsets in slices(batch.column("text")):
                raw = data.tobytes()
                texts += [raw[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                ids += batch.column("doc_id").slice(a, b - a).to_pylist()
                held += batch.column("held").slice(a, b - a).to_pylist()
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield from emit(texts, ids, held)
                    texts, ids, held, size = [], [], [], 0
        if texts:
            yield from emit(texts, ids, held)
        if arrow_id is not None:
            yield from flush_grams()
            yield from flush_words()

    rows = docs.select("doc_id", F.coalesce(~trainable, F.lit(True)).alias("held"), text_or_empty().alias("text"))
    fields = f"kind int, chunk long, bucket int, a binary, b binary, ids array<{id_type.simpleString()}>, held array<boolean>"
    return rows.mapInArrow(work, fields)


def dealt_words(words, buckets: int) -> list[tuple[int, list[bytes]]]:
    """Sorted words by bucket."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(words):
        out.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return sorted(out.items())


def _streamed(rows: DataFrame, keys: list[str], order: list[str], work, schema: str) -> DataFrame:
    """Rows of each key, in order, through ``work`` (an iterator of dicts to one of batches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}

        yield from work(each())

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def merge_counts(rows: DataFrame) -> DataFrame:
    """Step 2: (bucket, a, b), one row per bucket with its n-grams and their counts. A task
    holds the distinct n-grams of one bucket."""

    def work(each):
        bucket, keys, counts, held = None, [], [], 0

        def done():
            k, c = ctw.merged(keys, counts)
            yield _batch(bucket=pa.array([bucket], pa.int32()), a=pa.array([pack_sorted(k)], pa.binary()), b=pa.array([pack_numbers(c, "<i8")], pa.binary()))

        for row in each:
            if row["bucket"] != bucket:
                if keys:
                    yield from done()
                bucket, keys, counts, held = row["bucket"], [], [], 0
            keys.append(unpack_sorted(row["a"]))
            counts.append(unpack_numbers(row["b"], "<i8"))
            held += len(keys[-1])
            if held > 4 * COUNTS_HELD:
                k, c = ctw.merged(keys, counts)
                keys, counts, held = [k], [c], 0
        if keys:
            yield from done()

    return _streamed(rows.select("bucket", "a", "b"), ["bucket"], [], work, "bucket int, a binary, b binary")


def merge_words(rows: DataFrame) -> DataFrame:
    """As ``merge_counts`` for words: (bucket, a, b, words, tokens)."""

    def work(each):
        bucket, sums = None, Counter()

        def done():
            w = sorted(sums)
            c = np.array([sums[x] for x in w], np.int64)
            yield _batch(bucket=pa.array([bucket], pa.int32()), a=pa.array([pack_words(w)], pa.binary()), b=pa.array([pack_numbers(c, "<i8")], pa.binary()), words=pa.array([len(w)], pa.int64()), tokens=pa.array([int(c.sum())], pa.int64()))

        for row in each:
            if row["bucket"] != bucket:
                if sums:
                    yield from done()
                bucket, sums = row["bucket"], Counter()
            counts = unpack_numbers(row["b"], "<i8").tolist()
            for w, c in zip(unpack_words(row["a"]), counts, strict=True):
                sums[w] += c
        if sums:
            yield from done()

    return _streamed(rows.select("bucket", "a", "b"), ["bucket"], [], work, "bucket int, a binary, b binary, words long, tokens long")


def top_of_tree(model: DataFrame, depth: int) -> ctw.Tree | None:
    """The tree above the buckets: at most 256 contexts, so at most about 131,000 sums reach
    the driver, at any size of the corpus."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                grams, counts = unpack_sorted(a), unpack_numbers(b, "<i8")
                tree = ctw.Tree(grams, counts, depth, ctw.TOP + 1)
                for k in range(8):
                    level = tree.levels[ctw.TOP + 1, k]
                    at, index = np.unique(ctw._parent(level.keys, ctw.TOP + 1, k), return_inverse=True)
                    yield _batch(bit=pa.array(np.full(len(at), k, np.int32)), node=pa.array(at.astype(np.int64)), value=pa.array(np.bincount(index, weights=level.log_pw)), n=pa.array(np.zeros(len(at), np.int64)))
                g, c = ctw.merged([ctw._context(grams, depth, ctw.TOP)], [counts])
                yield _batch(bit=pa.array(np.full(len(g), 8, np.int32)), node=pa.array(g.astype(np.int64)), value=pa.array(np.zeros(len(g))), n=pa.array(c))

    sums = model.select("a", "b").mapInArrow(work, "bit int, node long, value double, n long")
    table = sums.groupBy("bit", "node").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).toPandas().sort_values(["bit", "node"])
    grams = table[table.bit == 8]
    if not len(grams):
        return None
    children = [table[table.bit == k].value.to_numpy() for k in range(8)]
    return ctw.top_levels(grams.node.to_numpy().astype(np.uint64), grams.n.to_numpy(), children)


def answer_grams(asked: DataFrame, model: DataFrame, top: ctw.Tree, depth: int) -> DataFrame:
    """Step 3: (chunk, bucket, a) with the log10 probability of each n-gram asked for."""

    def work(each):
        bucket = grams = known = tree = None
        for row in each:
            if row["kind"] == MODEL:
                bucket, grams = row["bucket"], unpack_sorted(row["a"])
                tree = ctw.Tree(grams, unpack_numbers(row["b"], "<i8"), depth, ctw.TOP + 1)
                known = ctw.log10_probability(grams, depth, tree, top)
                continue
            if row["bucket"] != bucket:  # no training text has any of this bucket's n-grams
                bucket, grams, known = row["bucket"], np.zeros(0, np.uint64), np.zeros(0)
                tree = ctw.Tree(grams, np.zeros(0, np.int64), depth, ctw.TOP + 1)
            keys = unpack_sorted(row["a"])
            out = np.zeros(len(keys))
            new = np.ones(len(keys), dtype=bool)
            if len(grams):
                at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
                new = grams[at] != keys
                out = known[at]
            if new.any():
                out[new] = ctw.log10_probability(keys[new], depth, tree, top)
            yield _batch(kind=pa.array([ASKED], pa.int32()), chunk=pa.array([row["chunk"]], pa.int64()), bucket=pa.array([bucket], pa.int32()), a=pa.array([pack_numbers(out, "<f4")], pa.binary()))

    return _per_bucket(asked, model, work)


def answer_words(asked: DataFrame, model: DataFrame) -> DataFrame:
    """As ``answer_grams``: the training count of each word asked for."""

    def work(each):
        bucket, counts = None, {}
        for row in each:
            if row["kind"] == MODEL:
                bucket = row["bucket"]
                counts = dict(zip(unpack_words(row["a"]), unpack_numbers(row["b"], "<i8").tolist(), strict=True))
                continue
            if row["bucket"] != bucket:
                bucket, counts = row["bucket"], {}
            found = np.array([counts.get(w, 0) for w in unpack_words(row["a"])], np.int64)
            yield _batch(kind=pa.array([WORDS], pa.int32()), chunk=pa.array([row["chunk"]], pa.int64()), bucket=pa.array([bucket], pa.int32()), a=pa.array([pack_numbers(found, "<i8")], pa.binary()))

    return _per_bucket(asked, model, work)


def _per_bucket(asked: DataFrame, model: DataFrame, work) -> DataFrame:
    """Bring each bucket's model to the chunks that ask it, in groups of chunks, so that a
    bucket with many n-grams is not one task's work."""
    chunks = asked.select("chunk").distinct().count()
    groups = max(1, -(-chunks // CHUNKS_PER_GROUP))
    ask = asked.select("kind", "chunk", "bucket", F.pmod("chunk", F.lit(groups)).alias("part"), "a", F.lit(None).cast("binary").alias("b"))
    sent = model.select(F.lit(MODEL).alias("kind"), F.lit(-1).cast("long").alias("chunk"), "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), "a", "b")
    return _streamed(sent.unionByName(ask), ["part", "bucket"], ["chunk"], work, "kind int, chunk long, bucket int, a binary")


def score_chunks(texts: DataFrame, answers: DataFrame, depth: int, buckets: int, known: bool, total: int, distinct: int, ends: int, id_type: str) -> DataFrame:
    """Step 4: one row per document."""
    lowest = math.log10(1 / 256)

    def words_part(raw: list[bytes], parts: dict[int, bytes]):
        found, index, first = words_of(raw)
        counts: dict[bytes, int] = {}
        for b, ws in dealt_words(found, buckets):
            counts.update(zip(ws, unpack_numbers(parts[b], "<i8").tolist(), strict=True))
        base = math.log10(total + distinct + 1)
        count = [counts[w] for w in found]
        logs = np.array([math.log10(c + 1) - base for c in count])[index]
        end = math.log10(ends + 1) - base
        known_before = np.concatenate([[0], np.cumsum(np.array(count, dtype=np.int64)[index] > 0)])
        n_known = np.diff(known_before[first]) + (ends > 0)
        each = zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
        return np.diff(first) + 1, n_known, [math.fsum(logs[a:b].tolist()) + end for a, b in each]

    def grams_part(raw: list[bytes], parts: dict[int, bytes]) -> np.ndarray:
        score = np.zeros(len(raw))
        if not known:
            return np.array([(len(t) + 1) * lowest for t in raw])
        held, seen = [], []
        for rows, grams, sizes in segments(raw, depth):
            held.append((rows, sizes, list(ranked(grams, depth))))
            seen.append(joint([own for own, _, _ in held[-1][2]]))
        asked = joint(seen)
        value = np.zeros(len(asked))
        for b, at in by_bucket(bucket_of(asked, depth, buckets), buckets):
            value[at] = unpack_numbers(parts[b], "<f4")
        for rows, sizes, runs in held:
            each, at = np.empty(int(sizes.sum())), 0
            for own, n, order in runs:
                each[at : at + len(order)][order] = np.repeat(value[np.searchsorted(asked, own)], n)
                at += len(order)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            np.add.at(score, rows, np.add.reduceat(each, first))
        return score

    def finish(chunk_rows: list[dict]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, dict[int, bytes]] = {ASKED: {}, WORDS: {}}
        main = None
        for row in chunk_rows:
            if row["kind"] == TEXTS:
                main = row
            else:
                parts[row["kind"]][row["bucket"]] = row["a"]
        sizes = np.frombuffer(main["b"], "<i8")
        body = zstandard.decompress(main["a"]) if sizes.sum() else b""
        ends_at = np.cumsum(sizes)
        raw = [body[e - n : e] for e, n in zip(ends_at.tolist(), sizes.tolist(), strict=True)]
        n_tokens, n_known, base = words_part(raw, parts[WORDS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(main["ids"], arrow_id), pa.array(main["held"], pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
             pa.array([total] * len(raw), pa.int64()), pa.array(base, pa.float64()), pa.array(grams_part(raw, parts[ASKED])), pa.array(sizes.astype(np.int64))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
        )

    def work(each):
        held: list[dict] = []
        for row in each:
            if held and held[0]["chunk"] != row["chunk"]:
                yield from finish(held)
                held = []
            held.append(row)
        if held:
            yield from finish(held)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(texts.schema["ids"].dataType.elementType)
    nothing = answers.select("kind", "chunk", "bucket", "a")
    for name in ("b", "ids", "held"):
        nothing = nothing.withColumn(name, F.lit(None).cast(texts.schema[name].dataType))
    rows = texts.select("kind", "chunk", "bucket", "a", "b", "ids", "held").unionByName(nothing)
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return _streamed(rows, ["chunk"], ["kind", "bucket"], work, schema)


def score_documents(docs: DataFrame, trainable: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10 probability of the text and its end), n_bytes,
    bits_per_byte (code length over the text's bytes and its end).

    The model learns from the rows where ``trainable`` holds (default: not held out). Null
    text is empty: it scores its end alone. Rows that repeat are learnt and scored each.
    Without training rows every byte has probability 1/256. Other columns are ignored.
    """
    trainable = ~held_out() if trainable is None else trainable
    size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count_if(trainable).alias("ends")).first()
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, (size["n"] or 0) // BUCKET_BYTES))
    ends = int(size["ends"] or 0)
    gathered = stage(gather(docs, trainable, depth, buckets), by="kind")
    kind = lambda k: gathered.where(F.col("kind") == k)
    model = stage(merge_counts(kind(COUNTS)))
    words = stage(merge_words(kind(WORD_COUNTS)))
    seen = words.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    total = int(seen["tokens"] or 0) + ends
    distinct = int(seen["words"] or 0) + (ends > 0)
    top = top_of_tree(model, depth)
    answers = answer_words(kind(WORDS), words)
    if top is not None:
        answers = answers.unionByName(answer_grams(kind(ASKED), model, top, depth))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = score_chunks(kind(TEXTS), answers, depth, buckets, top is not None, total, distinct, ends, id_type)
    return out.withColumn("bits_per_byte", -F.col("score") * (math.log(10) / math.log(2)) / (F.col("n_bytes") + 1))


def op2_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the context tree learnt from the training rows; see ``score_documents``."""
    return score_documents(read(spark, sf_dir, "documents"))
