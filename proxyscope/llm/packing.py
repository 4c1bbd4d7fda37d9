"""Best-fit packing of documents into training sequences, under several limits at once.

Every document is tokenised whole (ids and a closing id 0). Ids beyond one sequence are cut
into full pieces, each a sequence of its own; what is left of a document is one item. An item
has a demand vector (tokens, documents, attention cost = tokens squared) and a bin has as
many capacities. Items are dealt by hash to groups of bounded size and packed within them by
vector best-fit decreasing: of the open bins where the item fits in every dimension, the one
with the least dot product of the weighted demand and the residual shares afterwards, the
fullest fit ("dot"), or with the least weighted norm of the residual afterwards ("norm").
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyscope.llm.common import ROW_KEY, numbered, read, stage, text_or_empty

# Fixed values of the production packing.
CAPACITY = 2048
MAX_DOCS = CAPACITY  # a document has a token at least, so only tokens bind
MAX_COST = CAPACITY * CAPACITY
WEIGHTS = (1.0, 0.05, 0.05)
TOKENIZER = "word_bpe_49k.json"
CLOSING_ID = 0
GROUP_ITEMS = 4096
CACHE_PARTS = 600_000

# Fixed value: the tokenizer file's own split pattern, as it reads on plain text.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿ\u00df]+|[0-9]|[^a-z0-9à-öø-ÿ\s]+")
# Plain text: ASCII without control characters but white space, and Latin-1 letters. It is
# its own NFC form and each of its letters has one lower-case letter.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")


class WordTokenizer:
    """Token ids of whole texts, as little-endian 32-bit bytes, part by part.

    The tokenizer splits a text into parts (letters, one digit, other characters), drops
    white space and merges within parts only, so the ids of a text are those of its parts in
    turn, and these are kept for the parts met lately. Parts of plain texts go through the
    tokenizer's merge table; other texts go through the whole tokenizer word by word. Two
    generations of kept parts bound the memory; dropping one costs time only.
    """

    def __init__(self, path: str, kept: int = CACHE_PARTS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        marks = self.whole.get_added_tokens_decoder().values()
        self.hint = re.match(r"[^\w\s]*", os.path.commonprefix([m.content for m in marks]))[0]  # the same in any case
        self.marks = re.compile("|".join(re.escape(m.content) for m in marks) or "(?!)", re.IGNORECASE)
        self.merge = self.whole.model.tokenize
        self.kept = kept // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        byte = {b: chr(b) for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
        free = iter(range(256, 512))
        self.shown = [byte.get(b) or chr(next(free)) for b in range(256)]

    def _learn(self, key: str, make) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = np.array(make(key), dtype="<u4").tobytes()
        if len(self.young) >= self.kept:
            self.old, self.young = self.young, {}
        self.young[key] = ids
        return ids

    def _merge_part(self, part: str) -> list[int]:
        shown = part if part.isascii() else "".join(map(self.shown.__getitem__, part.encode()))
        return [t.id for t in self.merge(shown)]

    def _encode_word(self, word: str) -> list[int]:
        return self.whole.encode(word[1:], add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        if self.hint in text and self.marks.search(text):  # a mark may be one id, also across words
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _PLAIN.fullmatch(text):
            keys, make = _PARTS.findall(text.lower()), self._merge_part
        else:  # a space before a word tells it from a part; only ASCII white space is cut at
            keys, make = [" " + w for w in re.split("[\t-\r ]+", text) if w], self._encode_word
        out = list(map(self.young.get, keys))
        if None in out:
            get, learn = self.young.get, self._learn
            out = [learn(k, make) if (x := get(k)) is None else x for k in keys]
        return b"".join(out)


def piece_rows(texts, tokenizer: WordTokenizer, capacity: int, closing_id: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, piece, start, length, crc32 of the ids) of every piece of the texts."""
    end = int(closing_id).to_bytes(4, "little")
    for row, text in enumerate(texts):
        ids = tokenizer.ids(text) + end
        step = 4 * capacity
        for piece, at in enumerate(range(0, len(ids), step)):
            part = ids[at : at + step]
            yield row, piece, at // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, keys: list[str], tokenizer: str = TOKENIZER, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """One row per piece: ``keys``, piece, start, length, ids_crc32. ``tokenizer`` names a
    file of the installed public tokenizers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words = WordTokenizer(public_tokenizers.path(tokenizer))
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            found = list(piece_rows(texts, words, capacity, closing_id))
            row, piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
            columns = [batch.column(k).take(pa.array(row)) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*columns, *map(pa.array, (piece.astype(np.int32), start, length, crc))],
                names=[*keys, "piece", "start", "length", "ids_crc32"],
            )

    fields = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, piece int, start long, length long, ids_crc32 long"
    return docs.select(*keys, text_or_empty().alias("text")).mapInArrow(work, schema)


def best_fit(tokens: np.ndarray, capacity=(CAPACITY, MAX_DOCS, MAX_COST), weights=WEIGHTS, rule: str = "dot") -> np.ndarray:
    """Bin number of each item, items of most tokens first (then in the given order)."""
    demand = np.stack([tokens, np.ones_like(tokens), tokens * tokens], axis=1).astype(np.float64)
    full = np.array(capacity, dtype=np.float64)
    if len(tokens) and (demand > full).any():
        raise ValueError("an item exceeds the capacity of an empty bin")
    share, w = demand / full, np.array(weights)
    left = np.zeros((max(1, len(tokens)), len(full)))  # residual shares of the open bins
    space = np.zeros(max(1, len(tokens)))  # residual tokens, exact
    where = np.zeros(len(tokens), dtype=np.int64)
    bins, first = 0, 0
    for i in np.argsort(-tokens, kind="stable"):
        need = share[i]
        fits = np.flatnonzero((space[first:bins] >= tokens[i]) & (left[first:bins, 1:] >= need[1:] - 1e-12).all(axis=1)) + first
        if len(fits):
            rest = left[fits] - need
            if rule == "dot":
                # least dot product of the demand with what would stay open: the fullest fit
                score = (rest * (w * need)).sum(axis=1)
            else:
                score = (w * rest * rest).sum(axis=1)
            b = int(fits[np.argmin(score)])
        else:
            b = bins
            left[b], space[b] = 1.0, full[0]
            bins += 1
        left[b] -= need
        space[b] -= tokens[i]
        where[i] = b
        while first < bins and space[first] < 1:
            first += 1
    return where


def pack(cut: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int = MAX_COST,
         weights=WEIGHTS, rule: str = "dot", group_items: int = GROUP_ITEMS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32).
    Full pieces are sequences of their own and take no part in the search."""
    n = cut.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // group_items))
    # dealt by row, as very many rows may be equal; ``cut`` is a written table
    keys = [c for c in ROW_KEY if c in cut.columns]
    cut = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *keys), F.lit(groups))).drop(*keys)
    limits = (capacity, max_docs, max_cost)

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "ids_crc32", "length"], kind="stable", na_position="first", ignore_index=True)
        tokens = frame["length"].to_numpy(dtype=np.int64)
        whole = tokens == limits[0]
        where = np.zeros(len(frame), dtype=np.int64)
        where[~whole] = best_fit(tokens[~whole], limits, weights, rule)
        bins = int(where[~whole].max()) + 1 if (~whole).any() else 0
        where[whole] = bins + np.arange(int(whole.sum()))
        order = np.argsort(where, kind="stable")
        before = np.cumsum(tokens[order]) - tokens[order]
        first = np.concatenate([[True], where[order][1:] != where[order][:-1]]) if len(order) else np.zeros(0, bool)
        offset = np.zeros(len(frame), dtype=np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        frame["sequence_id"] = (frame["group"].to_numpy(dtype=np.int64) << 32) + where
        frame["offset"] = offset
        return frame[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return cut.groupBy("group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, **limits) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty (one piece, the closing id alone). Rows that repeat are documents of
    their own. No rows give no rows. Other columns are ignored. Sequence ids depend on the
    rows alone, not on how they are partitioned.
    """
    cut = stage(pieces(numbered(docs), ["doc_id", *ROW_KEY], tokenizer, limits.get("capacity", CAPACITY)))
    return pack(cut, **limits)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences; see ``pack_documents`` for nulls, repeats and empty tables."""
    return pack_documents(read(spark, sf_dir, "documents"))
