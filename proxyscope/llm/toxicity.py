"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another. Each is a logistic model on the words of the
whole text (hashed, present or not) and a few measures of its form; the models of later
categories also read the log-odds of the earlier ones. While training, these come from models that
have not seen the document (out-of-fold predictions of five folds), so a later model
learns how far an earlier one can be trusted on new text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyscope.llm.common import _LOWER, NOT_LETTER, Words, mix64, read, slices, text_or_empty

# Fixed values of the production model.
CHAIN = ("low_quality", "toxic")
BITS = 20  # hashed words
SAMPLE = 8000  # labelled documents to learn from, at most
LEAST_DOCS = 4  # a word must occur in so many of them
FOLDS = 5
LEAST_CHI2 = 12.0  # and its presence must depend on the category
STEPS, RATE, PENALTY = 200, 0.2, 0.3
SEED = 3
N_FORM = 6


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: distinct hashed words, sorted by row; first index of each row (and
    the end); measures of form (rows x N_FORM), each between 0 and about 1."""
    n = len(offsets) - 1
    words = Words(data, offsets, NOT_LETTER)
    key = (words.row.astype(np.uint64) << np.uint64(BITS)) | (words.hash & np.uint64((1 << BITS) - 1))
    key = np.sort(key)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key >> np.uint64(BITS), np.arange(n + 1, dtype=np.uint64))
    size = np.maximum(np.diff(offsets), 1)
    count = np.maximum(np.diff(words.first), 1)

    def share(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    letter = ~NOT_LETTER[data]
    form = np.stack([
        share(_LOWER[data] != data), share(letter), share((data >= 48) & (data < 58)), share(data == 10) * 10,
        np.diff(first) / count, np.minimum(np.log1p(count) / 10, 1.0),
    ], axis=1)
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int32), first, form


class Linear:
    """A logistic model: weights of hashed words, of other numbers, and a constant."""

    def __init__(self, words: np.ndarray, numbers: np.ndarray, constant: float):
        self.words, self.numbers, self.constant = words, numbers, constant

    def log_odds(self, ids: np.ndarray, first: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.words[ids], dtype=np.float64)])
        return total[first[1:]] - total[first[:-1]] + numbers @ self.numbers + self.constant


def fit_linear(ids: np.ndarray, row: np.ndarray, numbers: np.ndarray, y: np.ndarray, n_words: int) -> Linear:
    """Adam on the whole sample with an L2 penalty on words. ``ids`` are numbers below
    ``n_words``, one per (document, word), and ``row`` the document of each."""
    n = max(len(y), 1)
    w, v, c = np.zeros(n_words), np.zeros(numbers.shape[1]), 0.0
    prior = np.clip(y.mean() if len(y) else 0.5, 0.5 / n, 1 - 0.5 / n)
    c = float(np.log(prior / (1 - prior)))
    moments = [np.zeros(n_words + len(v) + 1) for _ in range(2)]
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[ids], minlength=len(y)) + numbers @ v + c
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(ids, weights=err[row], minlength=n_words) + PENALTY * w, numbers.T @ err + PENALTY * v, [err.sum()]]) / n
        moments[0] += 0.1 * (grad - moments[0])
        moments[1] += 0.01 * (grad * grad - moments[1])
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w -= move[:n_words]
        v -= move[n_words:-1]
        c -= float(move[-1])
    return Linear(w, v, c)


def dependent(word: np.ndarray, label: np.ndarray, y: np.ndarray, n_words: int) -> np.ndarray:
    """Words whose presence in documents depends on the category (chi-squared test of the
    two-by-two table): with few labelled documents the rest would only fit their noise."""
    n, positive = len(y), y.sum()
    both = np.bincount(word, weights=label, minlength=n_words)
    some = np.bincount(word, minlength=n_words).astype(np.float64)
    spread = some * (n - some) * positive * (n - positive)
    chi2 = np.where(spread > 0, (both * n - some * positive) ** 2 * n / np.maximum(spread, 1.0), 0.0)
    return np.flatnonzero(chi2 >= LEAST_CHI2)


def fit_chain(ids: np.ndarray, first: np.ndarray, form: np.ndarray, targets: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """One model per column of ``targets`` (0, 1, or NaN where unknown)."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    often = np.flatnonzero(np.bincount(ids, minlength=1 << BITS) >= LEAST_DOCS)
    compact = np.full(1 << BITS, -1)
    compact[often] = np.arange(len(often))
    use = compact[ids] >= 0
    word, row = compact[ids[use]], row[use]
    numbers = form
    chain = []

    def train(rows: np.ndarray, y: np.ndarray) -> Linear:
        take = rows[row]
        chosen = dependent(word[take], y[row[take]], y[rows], len(often))
        number = np.full(len(often), -1)
        number[chosen] = np.arange(len(chosen))
        take &= number[word] >= 0
        place = np.cumsum(rows) - 1
        small = fit_linear(number[word[take]], place[row[take]], numbers[rows], y[rows], len(chosen))
        words = np.zeros(len(often))
        words[chosen] = small.words
        return Linear(words, small.numbers, small.constant)

    for j in range(targets.shape[1]):
        y = targets[:, j]
        known = ~np.isnan(y)
        model = train(known, y)
        starts = np.searchsorted(row, np.arange(n + 1))
        outside = model.log_odds(word, starts, numbers)
        for fold in range(FOLDS):
            apart = folds == fold
            part = train(known & ~apart, y)
            outside[apart] = part.log_odds(word, starts, numbers)[apart]
        words = np.zeros(1 << BITS, dtype=np.float32)
        words[often] = model.words
        chain.append(Linear(words, model.numbers, model.constant))
        numbers = np.column_stack([numbers, np.clip(outside, -20, 20) / 10])
    return chain


def chain_log_odds(chain: Sequence[Linear], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log-odds (rows x categories) of a slice of texts."""
    ids, first, numbers = features(data, offsets)
    out = []
    for model in chain:
        z = model.log_odds(ids, first, numbers)
        out.append(z)
        numbers = np.column_stack([numbers, np.clip(z, -20, 20) / 10])
    return np.stack(out, axis=1)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> pa.Table:
    """(doc_id, words, form, targets) of at most ``most`` labelled documents, those of least
    seeded hash. Only their ids, a bounded number, are broadcast to the documents. Of rows under
    one id, that of the least text hash stands for all."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_of")).agg(
        F.max((F.col("quality") == 0).cast("double")).alias("low_quality"), F.max((F.col("toxic") == 1).cast("double")).alias("toxic")
    )
    chosen = known.orderBy(F.xxhash64(F.lit(SEED), "label_of"), "label_of").limit(most)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    met = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_of"))
    # hashes only: summed up in the tasks before they move, one row an id
    least = met.groupBy("label_of").agg(F.min(F.xxhash64("text")).alias("hash"))
    marked = chosen.join(least, "label_of")
    rows = texts.join(F.broadcast(marked), (F.col("doc_id") == F.col("label_of")) & (F.xxhash64("text") == F.col("hash")))
    rows = rows.groupBy("doc_id", *CHAIN).agg(F.first("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                ids, first, form = features(data, offsets)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)),
                     pa.FixedSizeListArray.from_arrays(pa.array(form.ravel()), N_FORM).cast(pa.list_(pa.float64())), *(part.column(c) for c in CHAIN)],
                    names=["doc_id", "words", "form", *CHAIN],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, words array<int>, form array<double>, " + ", ".join(f"{c} double" for c in CHAIN)
    return rows.mapInArrow(work, schema).toArrow().sort_by("doc_id")


def learn(docs: DataFrame, labels: DataFrame) -> list[Linear] | None:
    table = labelled_sample(docs, labels)
    if not table.num_rows:
        return None
    table = table.combine_chunks()
    words = table.column("words").combine_chunks()
    ids = words.flatten().to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
    form = table.column("form").combine_chunks().flatten().to_numpy().reshape(-1, N_FORM)
    targets = np.stack([table.column(c).to_numpy() for c in CHAIN], axis=1).astype(np.float64)
    ident = np.array([hash(i) & 0x7FFFFFFF for i in table.column("doc_id").to_pylist()], dtype=np.uint64)
    folds = (mix64(ident) % np.uint64(FOLDS)).astype(np.int64)
    return fit_chain(ids, first, form, targets, folds)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, p_low_quality, p_toxic, toxic.

    ``labels`` (doc_id, quality, toxic) may repeat documents (the worst label counts), lack
    some, and hold nulls (that category is then not learnt from the document). Null text is
    empty. Without labelled documents all probabilities are 0.5 and nothing is toxic. Whole
    texts are scored; other columns are ignored.
    """
    chain = learn(docs, labels)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    names = [f"p_{c}" for c in CHAIN]
    if chain is None:
        return rows.select("doc_id", *[F.lit(0.5).alias(c) for c in names], F.lit(False).alias("toxic"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                p = 1 / (1 + np.exp(-np.clip(chain_log_odds(chain, data, offsets), -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *(pa.array(p[:, j]) for j in range(len(CHAIN))), pa.array(p[:, -1] >= threshold)],
                    names=["doc_id", *names, "toxic"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in names) + ", toxic boolean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from ``labels``; see ``score_toxicity``."""
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
