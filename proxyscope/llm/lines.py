"""Substring dedup by hashing lines, and pieces of long lines.

Units. Words have A-Z in lower case, and white space between them does not matter. A unit is
a line of at least one word. As a repeated passage may stand in the middle of
lines, the words of a text are also cut into pieces, before each word whose hash is the least
among its ``REACH`` neighbours on either side: such a cut depends on the words next to it
only, so a passage gives the same pieces wherever it stands. Pieces have about nine words.

Digests of units (96 bits) are grouped over all documents; the occurrence of least rank
(doc_id, then the row's text under a repeated id, then position) is kept. A repeated line is removed, and so is a run of neighbouring
pieces that all occur earlier, of at least ``MIN_WORDS`` words together: a shorter piece says
too little alone. A passage ends inside a piece, so a run also takes the words before and
after it that stand in the same order around the earliest occurrence of its outer pieces:
the 64-bit hashes of the words on both sides are compared until two differ or a text ends,
``STEPS`` words at a time. Removed spans keep their offsets (bytes of the original UTF-8 text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxyscope.llm.common import ROW_KEY, Words, mix64, numbered, read, slices, stage, text_or_empty

# Fixed values of the production run.
REACH = 4
MIN_WORDS = 12
STEPS = (16, 256)  # words compared beside a run: at first, and again as long as all are equal


LINE, PIECE = 0, 1


def line_starts(words: Words, data: np.ndarray) -> np.ndarray:
    """For each word, whether it is the first of its line."""
    starts = np.zeros(len(words.hash), dtype=bool)
    starts[words.first[:-1][np.diff(words.first) > 0]] = True
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    starts[1:] |= breaks[words.start[1:]] > breaks[words.end[:-1]]
    return starts


def piece_starts(words: Words, reach: int = REACH) -> np.ndarray:
    """For each word, whether a piece begins at it: the first word of a text, and each whose
    hash is less than those of ``reach`` words before and at most those of as many after."""
    h = words.hash
    least = np.ones(len(h), dtype=bool)
    for j in range(1, reach + 1):
        same = words.row[j:] == words.row[:-j]
        least[j:] &= ~same | (h[j:] < h[:-j])
        least[:-j] &= ~same | (h[:-j] <= h[j:])
    least[words.first[:-1][np.diff(words.first) > 0]] = True
    return least


def unit_table(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The units of a slice of texts, in few and narrow columns as all are shuffled: ``row``;
    ``digest``; ``mark``, 32 more bits of the digest and the unit's place in its text (from
    0); ``span``, its first byte and end within the text, 32 bits each; ``size``, twice its
    words and one more for a piece."""
    words = Words(data, offsets)
    if not len(words.hash):
        return {}
    lines = _units(words, offsets, line_starts(words, data), LINE)
    pieces = _units(words, offsets, piece_starts(words), PIECE)
    return {f: np.concatenate([lines[f], pieces[f]]) for f in pieces}


def _units(words: Words, offsets: np.ndarray, starts: np.ndarray, kind: int) -> dict[str, np.ndarray]:
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], len(words.hash))
    place_in = np.arange(len(words.hash)) - np.repeat(begin, end - begin)
    odd = place_in.astype(np.uint64) * np.uint64(2) + np.uint64(1)
    digest = mix64(np.add.reduceat(mix64(words.hash * odd), begin) + np.uint64(kind))
    check = mix64(np.add.reduceat(mix64((words.hash ^ np.uint64(0x5851F42D4C957F2D)) * odd), begin))
    row = words.row[begin]
    first = np.concatenate([[True], row[1:] != row[:-1]])
    place = np.arange(len(begin)) - np.maximum.accumulate(np.where(first, np.arange(len(begin)), 0))
    base = offsets[row]
    low = lambda high, part: (high << np.uint64(32)) | part.astype(np.uint64)
    return {
        "row": row, "digest": digest.view(np.int64), "mark": low(check >> np.uint64(33), place).view(np.int64),
        "span": low((words.start[begin] - base).astype(np.uint64), words.end[end - 1] - base).view(np.int64),
        "size": (2 * (end - begin) + kind).astype(np.int32),
    }


_FIELDS = ("digest", "mark", "span", "size")


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, ROW_KEY, digest, mark, span, size) of every unit of every text of
    numbered rows."""
    keys = ["doc_id", *ROW_KEY]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                t = unit_table(data, offsets)
                if t:
                    row = pa.array(t["row"])
                    ids = [batch.column(k).slice(a, b - a).take(row) for k in keys]
                    yield pa.RecordBatch.from_arrays([*ids, *(pa.array(t[f]) for f in _FIELDS)], names=[*keys, *_FIELDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where(F.col("text") != "").select(*keys, "text")
    return rows.mapInArrow(work, f"doc_id {kind}, {ROW_KEY[0]} long, {ROW_KEY[1]} long, digest long, mark long, span long, size int")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(ROW_KEY, start, end, before, after) of the spans to remove of numbered rows:
    bytes of the text, and how many words more on either side. Spans may overlap.

    Each row is a document of its own, also under a repeated or null doc_id, where the texts'
    hashes give the order. A null doc_id ranks before all others.
    """
    u = units(docs)
    rank = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    check = F.shiftright("mark", 32).alias("check")
    digest = ["digest", "check"]
    # The units are worked out twice, here without their places: cheaper than a table of them.
    first = u.select("digest", check, rank.alias("rank")).groupBy(*digest).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    # Both sides of the two joins are plain shuffles, so a passage of very many documents is
    # split over tasks; only its first document's own rows are aggregated.
    first = stage(first.where(F.col("n") > 1).select(F.col("digest").alias("d"), F.col("check").alias("c"), "first"))
    met = u.join(first, (F.col("digest") == F.col("d")) & (F.shiftright("mark", 32) == F.col("c")))
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    met = stage(met.select(
        *ROW_KEY, "digest", check, (rank == F.col("first")).alias("own"), low("mark").alias("place"),
        F.shiftright("span", 32).cast("int").alias("start"), low("span").alias("end"),
        (F.col("size") % 2).alias("kind"), F.shiftright("size", 1).alias("words"),
    ))
    source = met.where("own").groupBy(F.col("digest").alias("d"), F.col("check").alias("c")).agg(
        F.min(F.struct(*ROW_KEY, "place", "start", "end")).alias("source")
    )
    source = stage(source)
    again = met.join(source, (F.col("digest") == F.col("d")) & (F.col("check") == F.col("c")))
    kept = F.col("own") & (F.col("place") == F.col("source.place"))
    for k in ROW_KEY:
        kept &= F.col(k) == F.col(f"source.{k}")
    again = again.where(~kept).select(*ROW_KEY, "kind", "place", "words", "start", "end", "source")
    # neighbouring repeated units form runs: place less its number among the repeated ones
    order = Window.partitionBy(*ROW_KEY, "kind").orderBy("place")
    runs = again.withColumn("run", F.col("place") - F.row_number().over(order))
    spans = runs.groupBy(*ROW_KEY, "kind", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"),
        F.min_by("source", "place").alias("left"), F.max_by("source", "place").alias("right"),
    )
    spans = stage(spans.where((F.col("kind") == LINE) | (F.col("words") >= min_words)))
    lines = spans.where(F.col("kind") == LINE).select(*ROW_KEY, "start", "end", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("after"))
    return lines.unionByName(_extended(docs, spans.where(F.col("kind") == PIECE)))


_SIDE = ("_place", "_side")  # a place in a text, and whether it is looked at to the left (0) or right (1)


def _words_beside(docs: DataFrame, wanted: DataFrame, skip: int, count: int) -> DataFrame:
    """``wanted`` (ROW_KEY, place, side; distinct) and ``beside``, the hashes of up to ``count``
    words next to each place, the nearest first, after ``skip`` words left out."""
    of = wanted.groupBy(*(F.col(k).alias(f"w{k}") for k in ROW_KEY)).agg(F.collect_list(F.struct(*_SIDE)).alias("places"))
    same = docs[ROW_KEY[0]] == of[f"w{ROW_KEY[0]}"]
    rows = docs.join(of, same & (docs[ROW_KEY[1]] == of[f"w{ROW_KEY[1]}"])).select(*ROW_KEY, "text", "places")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                hashes = words.hash.view(np.int64)
                lists = batch.column("places").slice(a, b - a)
                row = np.repeat(np.arange(b - a), np.diff(np.asarray(lists.offsets)))
                flat = lists.flatten()
                place = flat.field(_SIDE[0]).to_numpy() + offsets[row]
                right = flat.field(_SIDE[1]).to_numpy() == 1
                # the words from the place on, or up to it, as far as the text goes
                begin = np.where(right, np.searchsorted(words.start, place) + skip, np.searchsorted(words.end, place, side="right") - 1 - skip)
                room = np.where(right, words.first[row + 1] - begin, begin + 1 - words.first[row])
                size = np.clip(room, 0, count)
                first = np.concatenate([[0], np.cumsum(size)])
                step = np.arange(first[-1]) - np.repeat(first[:-1], size)
                at = np.repeat(begin, size) + np.where(np.repeat(right, size), step, -step)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(pa.array(row)) for k in ROW_KEY), flat.field(_SIDE[0]), flat.field(_SIDE[1]), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes[at]))],
                    names=[*ROW_KEY, *_SIDE, "beside"],
                )

    return rows.mapInArrow(work, f"{ROW_KEY[0]} long, {ROW_KEY[1]} long, {_SIDE[0]} int, {_SIDE[1]} int, beside array<long>")


def _extended(docs: DataFrame, spans: DataFrame, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(ROW_KEY, start, end, before, after) of runs with the words around them that also stand
    around the earliest occurrence of their outer pieces."""
    texts = docs.select(*ROW_KEY, text_or_empty().alias("text"))
    names = [f"s{k}" for k in (*ROW_KEY, _SIDE[0])]

    def ends(side: int, own: str, source: str) -> DataFrame:
        there = [F.col(f"{source}.{k}").alias(n) for k, n in zip((*ROW_KEY, own), names, strict=True)]
        return spans.select(*ROW_KEY, "start", "end", F.col(own).alias(_SIDE[0]), F.lit(side).alias(_SIDE[1]), *there)

    left, skip, found = ends(0, "start", "left").unionAll(ends(1, "end", "right")), 0, []
    for turn in range(1 << 30):
        count = steps[min(turn, len(steps) - 1)]
        there = left.select(*(F.col(n).alias(k) for n, k in zip(names, (*ROW_KEY, _SIDE[0]), strict=True)), _SIDE[1])
        wanted = left.select(*ROW_KEY, *_SIDE).unionByName(there).distinct()
        beside = stage(_words_beside(texts, wanted, skip, count))
        source = beside.select(*(F.col(k).alias(n) for n, k in zip(names, (*ROW_KEY, _SIDE[0]), strict=True)), _SIDE[1], F.col("beside").alias("there"))
        met = left.join(beside, [*ROW_KEY, *_SIDE]).join(source, [*names, _SIDE[1]])
        pairs = F.zip_with("beside", "there", lambda x, y: x.eqNullSafe(y))  # the shorter one goes on with nulls
        differ = F.array_position(pairs, False).cast("long")
        same = F.when(differ > 0, differ - 1).otherwise(F.size("beside").cast("long"))
        columns = [*ROW_KEY, "start", "end", *_SIDE, *names, (same + skip).alias("more"), (same == count).alias("on")]
        met = stage(met.select(*columns))
        found.append(met.where(~F.col("on")))
        left = met.where("on").drop("more", "on")
        if not left.limit(1).count():
            break
        skip += count
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    more = [F.max(F.when(F.col(_SIDE[1]) == side, F.col("more"))).alias(name) for side, name in enumerate(("before", "after"))]
    return every.groupBy(*ROW_KEY, "start", "end").agg(*more)


def _cut(text: pa.Array, spans: pa.Array) -> tuple[list, list]:
    """Texts without their spans, and the spans as removed: with the words around them, and
    overlapping ones made one."""
    out, merged = [], []
    for value, cut in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        if value is None or not cut:
            out.append(value)
            merged.append([])
            continue
        raw = value.encode()
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        found = []
        for s in cut:
            a = max(int(np.searchsorted(words.start, s["start"])) - s["before"], 0)
            b = min(int(np.searchsorted(words.end, s["end"])) + s["after"], len(words.end) - 1)
            found.append((int(words.start[a]), int(words.end[b])))
        whole: list[list[int]] = []
        for start, end in sorted(found):
            if whole and start <= whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], end)
            else:
                whole.append([start, end])
        at, kept = 0, []
        for start, end in whole:
            kept.append(raw[at:start])
            at = end
        kept.append(raw[at:])
        out.append(b"".join(kept).decode())
        merged.append([{"start": a, "end": b} for a, b in whole])
    return out, merged


def spans_by_document(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Numbered rows with their spans, as ``_repeated_spans``."""
    spans = repeated_spans(docs, min_words).groupBy(*(F.col(k).alias(f"_span{k}") for k in ROW_KEY))
    spans = spans.agg(F.collect_list(F.struct("start", "end", "before", "after")).alias("_repeated_spans"))
    same = docs[ROW_KEY[0]] == spans[f"_span{ROW_KEY[0]}"]
    return docs.join(spans, same & (docs[ROW_KEY[1]] == spans[f"_span{ROW_KEY[1]}"]), "left")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated spans taken out of ``text`` (other columns as they are, but
    ``n_chars``, which follows the text). A text left without a word stays, as what is
    left of it; documents are not dropped here."""
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    joined = spans_by_document(numbered(docs), min_words).select(*docs.columns, "_repeated_spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            text, spans = _cut(columns[at], columns.pop())
            columns[at] = pa.array(text, columns[at].type)
            if length is not None:
                old = columns[length].to_pylist()
                new = [len(t) if s and t is not None else o for o, s, t in zip(old, spans, text, strict=True)]
                columns[length] = pa.array(new, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return joined.mapInArrow(work, docs.schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ``text`` without its repeated
    spans, ``spans`` (start, end, words; byte offsets in the original text), ``n_removed``
    bytes.

    Null text stays null and empty text empty, without spans. Every unit's occurrence of
    least (doc_id, position) is kept. Rows that repeat an id are documents of their own, in
    the order of their texts' hashes. Other columns are ignored.
    """
    rows = spans_by_document(numbered(docs), min_words).select("doc_id", "text", "_repeated_spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            text, spans = _cut(batch.column("text"), batch.column("_repeated_spans"))
            removed = [sum(s["end"] - s["start"] for s in cut) for cut in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(text, batch.column("text").type), pa.array(spans, kind), pa.array(removed, pa.int64())],
                names=["doc_id", "text", "spans", "n_removed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, spans array<struct<start:int,end:int>>, n_removed long"
    return rows.mapInArrow(work, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines and passages that occur earlier."""
    return dedup_lines(read(spark, sf_dir, "documents"))


