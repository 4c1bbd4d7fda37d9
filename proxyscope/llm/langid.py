"""Language identification by a convolutional network over bytes, trained in numpy.

A text's UTF-8 bytes (A-Z in lower case) are cut into fixed-length windows that overlap by
the widest filter less one, so no byte sequence is missed. Filters of several widths slide
over a window's one-hot bytes; the maximum of each over the window goes through a ReLU and
one dense layer to a softmax over languages. A text's probabilities are the mean over its
windows, weighted by the bytes in each; its score is the largest.

On one-hot bytes a filter is a sum of table look-ups. For scoring, the tables of
neighbouring bytes are added up beforehand, so that one look-up serves a pair of bytes:
exactly the same sums with fewer reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyscope.llm.common import _LOWER, doc_crc, read, slices, text_or_empty

# Fixed values of the production model.
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
STRIDE = 253  # positions of a window; it reads STRIDE + 3 bytes
SAMPLE_PER_LANGUAGE = 400  # labelled documents to learn from, at most
SNIPPETS = 4  # windows of each
STEPS, BATCH, RATE = 500, 96, 0.01
SEED = 9
UNKNOWN = "und"
WEAKEST = 0.01  # share of the rightly told held-out rows that sets the lowest score kept
LEEWAY = 0.5  # of their margin over chance
_BINS = 1000
_PAD = max(WIDTHS) - 1
_SLICE = 1 << 17


class ByteNetwork:
    """Filters ``kernel[w][k]`` (256 x FILTERS per offset k), their biases, the dense layer."""

    def __init__(self, labels: list[str], rng: np.random.Generator):
        self.labels = labels
        self.kernel = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.kernel.values(), self.bias, self.dense, self.offset]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Look-up tables for a byte pair (all widths), a third byte, and a second pair."""
        two, three, four = (self.kernel[w] for w in WIDTHS)
        pair = lambda k: (k[0][:, None, :] + k[1][None, :, :]).reshape(65536, FILTERS)
        return np.concatenate([pair(two), pair(three), pair(four)], axis=1), three[2], pair(four[2:])

    def classify(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows(texts: list[np.ndarray] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a slice (data, offsets) laid out in whole windows, each text padded with at
    least _PAD zero bytes, and the number of windows of each text."""
    data, offsets = texts
    size = np.diff(offsets)
    count = -(-(size + _PAD) // STRIDE)
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(begin[-1]) * STRIDE + _PAD, dtype=np.uint8)
    at = np.repeat(begin[:-1] * STRIDE - offsets[:-1], size) + np.arange(len(data))
    out[at] = _LOWER[data]
    return out, count


def predict(network: ByteNetwork, tables, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of each text of a slice."""
    flat, count = windows((data, offsets))
    n = int(count.sum()) * STRIDE
    pairs, third, second = tables
    wide = flat.astype(np.intp)
    pair = (wide[:-1] << 8) | wide[1:]
    response = pairs.take(pair[:n], axis=0)
    response[:, FILTERS : 2 * FILTERS] += third.take(wide[2 : n + 2], axis=0)
    response[:, 2 * FILTERS :] += second.take(pair[2 : n + 2], axis=0)
    pooled = response.reshape(-1, STRIDE, response.shape[1]).max(axis=1)
    shares = network.classify(pooled)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    size = np.diff(offsets)
    place = (np.arange(len(shares)) - np.repeat(first, count)) * STRIDE
    weight = np.clip(np.repeat(size, count) - place, 0, STRIDE).astype(np.float64)
    weight = np.where(np.repeat(size, count) == 0, 1.0, weight)
    total = np.add.reduceat(shares * weight[:, None], first, axis=0)
    return total / np.add.reduceat(weight, first)[:, None]


def train(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = SEED) -> ByteNetwork | None:
    """Fit by Adam on windows (label, bytes); None without samples. The gradient of a
    maximum goes to the bytes at its position."""
    labels = sorted({label for label, _ in samples})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    net = ByteNetwork(labels, rng)
    length = STRIDE + _PAD
    x = np.zeros((len(samples), length), dtype=np.uint8)
    for i, (_, raw) in enumerate(samples):
        cut = np.frombuffer(raw[:length], dtype=np.uint8)
        x[i, : len(cut)] = _LOWER[cut]
    index = {label: i for i, label in enumerate(labels)}
    y = np.array([index[label] for label, _ in samples])
    by_label = [np.flatnonzero(y == i) for i in range(len(labels))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        drawn = rng.integers(0, len(labels), BATCH)
        chosen = np.array([rng.choice(by_label[c]) for c in drawn])
        xb, yb = x[chosen].astype(np.intp), y[chosen]
        pooled, where = [], []
        for w in WIDTHS:
            r = sum(net.kernel[w][k].take(xb[:, k : k + STRIDE], axis=0) for k in range(w))
            top = r.argmax(axis=1)
            where.append(top)
            pooled.append(np.take_along_axis(r, top[:, None, :], axis=1)[:, 0])
        pooled = np.concatenate(pooled, axis=1)
        hidden = np.maximum(pooled + net.bias, 0)
        p = net.classify(pooled)
        p[np.arange(BATCH), yb] -= 1
        p /= BATCH
        back = (p @ net.dense.T) * (hidden > 0)
        grads = []
        for i, w in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            g = np.zeros_like(net.kernel[w])
            rows, cols = np.arange(BATCH)[:, None], np.broadcast_to(np.arange(FILTERS), part.shape)
            for k in range(w):
                np.add.at(g[k], (xb[rows, where[i] + k], cols), part)
            grads.append(g)
        grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
        for value, grad, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def labelled_windows(docs: DataFrame, trainable: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """Windows of at most ``per_language`` labelled documents of each language.

    Languages are counted first; each row then passes a seeded hash test that leaves about
    three times the bound of a frequent language, and the rows of least hash are taken, so
    the sample depends on the rows alone and little is shuffled at any size.
    """
    labelled = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30))
    bound = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, int(min(1.0, 3 * per_language / n) * (1 << 30)))])
    near = labelled.where(draw < bound[F.col("lang")])
    n = F.char_length("text")

    def snippet(i: int) -> Column:
        start = F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.greatest(F.lit(1), n - STRIDE)).cast("int")
        return F.substring(F.col("text"), start + 1, F.lit(STRIDE + _PAD))

    rows = near.select("lang", "doc_id", draw.alias("draw"), F.array(*[snippet(i) for i in range(SNIPPETS)]).alias("cuts"))
    ranked = F.row_number().over(_least("lang"))
    rows = rows.withColumn("place", ranked).where(F.col("place") <= per_language)
    found = sorted((r["lang"], r["doc_id"] or 0, tuple(r["cuts"])) for r in rows.collect())
    return [(lang, cut.encode()) for lang, _, cuts in found for cut in cuts]


def _least(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("draw", "doc_id")


def fit(docs: DataFrame, trainable: Column) -> ByteNetwork | None:
    return train(labelled_windows(docs, trainable))


def held_out() -> Column:
    return F.pmod(doc_crc(), F.lit(5)) == 0


def _score(network: ByteNetwork, column) -> tuple[np.ndarray, np.ndarray]:
    """Best label number and its probability for each text of an Arrow column."""
    tables = network.tables() if not hasattr(network, "_tables") else network._tables
    network._tables = tables
    best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
    for a, b, data, offsets in slices(column, _SLICE):
        shares = predict(network, tables, data, offsets)
        best[a:b], score[a:b] = shares.argmax(axis=1), shares.max(axis=1)
    return best, score


def identify(docs: DataFrame, trainable: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    The network learns from the rows where ``trainable`` holds (default: not held out) that
    have a language, and predicts from the text alone. Null text and text without a letter
    give "und" with score 0, as does every row if no row can be learnt from. Rows that repeat
    are predicted alike; other columns are ignored.
    """
    network = fit(docs, ~held_out() if trainable is None else trainable)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), text_or_empty().alias("text"))
    if network is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*network.labels, UNKNOWN], dtype=object)
        for batch in batches:
            best, score = _score(network, batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(letters, best, len(names) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def lowest_score(docs: DataFrame, network: ByteNetwork) -> float:
    """The score below which a text counts as in none of the learnt languages.

    All labelled rows held out of training are scored. Of those told rightly, the weakest
    hundredth reach a margin over chance (one in the number of languages); half of that margin
    is asked of every text. The scores are counted in thousandths, so the result is the same in
    any order and nothing but those counts comes to the driver. With one language, or no such
    row, it is 0: nothing can be told then.
    """
    chance = 1 / len(network.labels)
    held = docs.where(held_out() & F.col("lang").isin(network.labels) & F.col("text").rlike(r"\p{L}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(network.labels, dtype=object)
        for batch in batches:
            best, score = _score(network, batch.column("text"))
            right = names[best] == batch.column("lang").to_numpy(zero_copy_only=False)
            place = np.minimum(score[right] * _BINS, _BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place)], names=["place"])

    counts = held.select("lang", "text").mapInArrow(work, "place int").groupBy("place").count().collect()
    if not counts or chance == 1:
        return 0.0
    total, seen = sum(r["count"] for r in counts), 0
    for place, n in sorted((r["place"], r["count"]) for r in counts):
        seen += n
        if seen >= WEAKEST * total:
            break
    return chance + LEEWAY * max(place / _BINS - chance, 0.0)


def keep_identified(docs: DataFrame, min_score: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told with ``min_score`` or more (if
    None, ``lowest_score``); texts that are null or have no letter go. Without labelled rows
    every text with a letter stays."""
    network = fit(docs, ~held_out())
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    if network is None:
        return lettered
    least = lowest_score(docs, network) if min_score is None else min_score
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, score = _score(network, pc.fill_null(batch.column(at), ""))
            yield batch.filter(pa.array(score >= least))

    return lettered.mapInArrow(work, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; see ``identify``."""
    return identify(read(spark, sf_dir, "documents"))
