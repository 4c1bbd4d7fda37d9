"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow word by word. Words and pairs of words are counted over all texts. A phrase
x y z with the prefix x y scores at most f(x y) / f(x): its cut after x has l = f(x), and both
its own count and r are at most f(x y), r at least its own count. (Growing single words has
no bound below 1, so all words of sufficient count grow.) The prefixes of highest bound are
the frontier: each round takes, for each language, those with bounds down to a level, counts the
phrases that they begin (and those that end in a pair scoring at or over the level, which
can only drop it), and so knows every phrase that scores at or over the level. A language is
settled when so many phrases survive there that the level cannot hide another; else its
level falls and a round follows.

While counting, a word of a language is a 64-bit hash, so phrases are rows of two or three
longs. The table of all words shows whether two share a hash; then another salt is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxyscope.llm.common import _LOWER, mix64, read, slices, stage, text_or_empty

# Fixed values of the production run.
LEAST_COUNT = 10
TOP = 2000
UNIT = 1_000_000  # scores are whole millionths
DROP_PERCENT = 50
NO_LANGUAGE = "und"
FRONTIER = 4 * TOP  # prefixes of a language in the first round; eight times as many in each next one
HELD = 1 << 20  # prefixes sent to the tasks; beyond, tasks count all phrases of three words

_BETWEEN = np.zeros(256, dtype=bool)  # between words
_BREAK = np.zeros(256, dtype=bool)  # between pieces
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN[[0x20, 0x09]] = True
_BETWEEN |= _BREAK


class Phrases:
    """The words of a slice of texts with their languages, and the phrases that they form."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array, salt: int):
        import xxhash

        inside = ~_BETWEEN[data]
        edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins
        edge[offsets] = True
        begins = inside & edge[:-1]
        begins[1:] |= inside[1:] & ~inside[:-1]
        ends = inside & edge[1:]
        ends[:-1] |= inside[:-1] & ~inside[1:]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.n = n = len(start)
        first = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        text = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(first), pa.py_buffer(_LOWER[data[inside]])])
        coded = text.dictionary_encode()
        named = langs.dictionary_encode()
        row = np.searchsorted(offsets, start, side="right") - 1
        lang = named.indices.to_numpy().astype(np.int64)[row]
        # words of a language, numbered: their first places, numbers and counts
        key = lang * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        _, at, self.word, self.count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        self.words = coded.dictionary.take(coded.indices.take(pa.array(at))).cast(pa.string())
        self.langs = named.dictionary.take(pa.array(lang[at]))
        seeds = [xxhash.xxh64_intdigest(x.as_buffer(), seed=salt) for x in named.dictionary.cast(pa.binary())]
        hashes = [xxhash.xxh64_intdigest(w, seed=seeds[k]) for w, k in zip(self.words.cast(pa.binary()).to_pylist(), lang[at].tolist(), strict=True)]
        self.hash = np.array(hashes, dtype=np.uint64)
        breaks = np.cumsum(_BREAK[data])
        # whether a word and the next one stand in one piece
        self.next = (row[1:] == row[:-1]) & (breaks[start[1:]] == breaks[end[:-1] - 1]) if n else np.zeros(0, bool)

    def grow(self, places: np.ndarray, groups: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct phrases made of the groups at ``places`` and the word ``step`` words on:
        a first place of each, the phrase at each place, and the counts."""
        key = groups * max(1, len(self.hash)) + self.word[places + step]
        _, first, phrase, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        return places[first], phrase, count

    def rows(self, places: np.ndarray, count: np.ndarray, size: int) -> pa.RecordBatch:
        keys = [pa.array(self.hash[self.word[places + j]].view(np.int64)) for j in range(size)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(count)], names=[*"xyz"[:size], "n"])


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits that stand for a pair of words given by their hashes."""
    return mix64(a * np.uint64(3) + mix64(b + np.uint64(0x632BE59BD9B4E019)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), text_or_empty().alias("text"))


def _phrases(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[Phrases]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text"), most_rows=1 << 20):
            yield Phrases(data, offsets, batch.column("lang").slice(a, b - a), salt)


def count_words(docs: DataFrame, salt: int) -> DataFrame:
    """(lang, word, x, n) of all words; x is the word's hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _phrases(batches, salt):
            yield pa.RecordBatch.from_arrays([p.langs, p.words, pa.array(p.hash.view(np.int64)), pa.array(p.count)], names=["lang", "word", "x", "n"])

    return _texts(docs).mapInArrow(work, "lang string, word string, x long, n long").groupBy("lang", "word", "x").agg(F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, salt: int) -> DataFrame:
    """(x, y, n) of all pairs of neighbours."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _phrases(batches, salt):
            places = np.flatnonzero(p.next)
            first, _, count = p.grow(places, p.word[places], 1)
            yield p.rows(first, count, 2)

    return _texts(docs).mapInArrow(work, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))


def count_long(docs: DataFrame, salt: int, begins: np.ndarray | None, ends: np.ndarray | None) -> DataFrame:
    """(x, y, z, n) of phrases of three words that begin with a pair of ``begins`` or end
    with one of ``ends`` (sorted pair keys); a few others may be among them. None: all."""

    def among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
        if not len(held):
            return np.zeros(len(keys), bool)
        return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _phrases(batches, salt):
            near = np.flatnonzero(p.next)
            first, pair, _ = p.grow(near, p.word[near], 1)
            kind = np.full(p.n, -1)
            kind[near] = pair
            places = np.flatnonzero(p.next[:-1] & p.next[1:])
            if begins is not None and len(places):
                key = pair_keys(p.hash[p.word[first]], p.hash[p.word[first + 1]])
                places = places[among(key, begins)[kind[places]] | among(key, ends)[kind[places + 1]]]
            first, _, count = p.grow(places, kind[places], 2)
            yield p.rows(first, count, 3)

    return _texts(docs).mapInArrow(work, "x long, y long, z long, n long").groupBy("x", "y", "z").agg(F.sum("n").alias("n"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(UNIT a^2 / (left right)) in whole numbers of 38 digits."""
    whole = "CAST({} AS DECIMAL(38,0))".format
    return F.expr(f"{whole(UNIT)} * {whole(a)} * {whole(a)} DIV ({whole(left)} * {whole(right)})")


def _pairs(words: DataFrame, counted: DataFrame) -> DataFrame:
    """Pairs of sufficient count: lang, x, y (hashes), first, second (words), a, fx, fy,
    score, and the bound of what they begin."""
    one = words.select("lang", "x", F.col("word").alias("first"), F.col("n").alias("fx"))
    two = words.select(F.col("x").alias("y"), F.col("word").alias("second"), F.col("n").alias("fy"))
    p = counted.withColumnRenamed("n", "a").join(one, "x").join(two, "y")
    bound = F.expr(f"CAST({UNIT} AS DECIMAL(38,0)) * a DIV fx")
    return p.withColumn("score", _score("a", "fx", "fy")).withColumn("bound", bound)


def _levels(pairs: DataFrame, size: int) -> DataFrame:
    """(lang, level): the bound down to which the frontier holds ``size`` prefixes, 0 where
    there are fewer. Bounds are whole millionths, so a language has at most 1,000,001 here."""
    count = pairs.groupBy("lang", "bound").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy("lang").orderBy(F.col("bound").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = count.withColumn("upto", F.sum("k").over(upto))
    return count.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= size, F.col("bound"))), F.lit(0).cast("long")).alias("level"))


def _held_keys(pairs: DataFrame, most: int) -> np.ndarray | None:
    """Sorted pair keys of some pairs (x, y), at most ``most`` of them; None for more."""
    table = pairs.select("x", "y").limit(most + 1).toArrow()
    if table.num_rows > most:
        return None
    return np.unique(pair_keys(*(table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in "xy")))


def _counted_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """Staged word counts, and a salt under which no two words share a hash."""
    for salt in range(100):
        words = stage(count_words(docs, salt))
        if not words.groupBy("x").count().where("count > 1").limit(1).count():
            return words, salt
    raise RuntimeError("collocations: words share hashes under every salt")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST_COUNT, frontier: int = FRONTIER, held: int = HELD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two or three
    words in ``docs`` (lang, text): the phrase's count a, those of the two parts of its lowest
    cut (l, r), the language's words n, and floor(1,000,000 a^2 / (l r)).

    Null text is empty, a null lang is "und" (one language with rows that say so), repeated
    rows count as often as they stand there, and texts without words, or no rows, give nothing. Ties
    go by count, falling, then by phrase in byte order. Other columns are ignored.
    """
    docs = docs.select("lang", "text")
    words, salt = _counted_words(docs)
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    pairs = stage(_pairs(words.where(F.col("n") >= least), count_pairs(docs, salt).where(F.col("n") >= least)))
    size = frontier
    while True:
        levels = stage(_levels(pairs, size))
        known = pairs.join(levels, "lang")
        begins = _held_keys(known.where(F.col("bound") >= F.col("level")), held)  # the frontier's prefixes
        ends = _held_keys(known.where(F.col("score") >= F.col("level")), held) if begins is not None else None
        if ends is None:
            begins = None
        long = stage(count_long(docs, salt, begins, ends).where(F.col("n") >= least))
        surviving = stage(_surviving(pairs, long, levels, top))
        met = surviving.groupBy("lang").agg(F.count(F.lit(1)).alias("k"))
        unsettled = levels.where(F.col("level") > 0).join(met, "lang", "left").where(F.coalesce("k", F.lit(0)) < top)
        if not unsettled.limit(1).count():
            break
        size *= 8
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = surviving.withColumn("rank", F.row_number().over(order).cast("long"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _surviving(pairs: DataFrame, long: DataFrame, levels: DataFrame, top: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the best ``top`` phrases that score at or over their
    language's level and stay beside longer ones."""
    # Pairs inside longer phrases: the greatest count that takes each in.
    inside = long.select("x", "y", "n").unionAll(long.select("y", "z", "n")).groupBy("x", "y").agg(F.max("n").alias("longer"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    two = pairs.join(levels, "lang").where(F.col("score") >= F.col("level")).join(inside, ["x", "y"], "left")
    two = two.where(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * DROP_PERCENT))
    two = two.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), "score")
    head = pairs.select("lang", "x", "y", F.concat_ws(" ", "first", "second").alias("head"), F.col("a").alias("f_head"), F.col("fx").alias("f_first"))
    tail = pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("second").alias("last"), F.col("a").alias("f_tail"), F.col("fy").alias("f_last"))
    three = long.withColumnRenamed("n", "a").join(head, ["x", "y"]).join(tail, ["y", "z"])
    three = three.withColumn("early", _score("a", "f_first", "f_tail")).withColumn("late", _score("a", "f_head", "f_last"))
    by = F.col("early") <= F.col("late")  # the lower cut counts, of equal ones the earlier
    three = three.select(
        "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "a", F.when(by, F.col("f_first")).otherwise(F.col("f_head")).alias("l"),
        F.when(by, F.col("f_tail")).otherwise(F.col("f_last")).alias("r"), F.least("early", "late").alias("score"),
    )
    three = three.join(levels, "lang").where(F.col("score") >= F.col("level")).drop("level")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    both = two.unionByName(three)
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language over all ``documents``."""
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '{NO_LANGUAGE}') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
f1 AS (SELECT lang, unnest(ws) AS phrase, 1 AS size FROM w),
f2 AS (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS phrase, 2 AS size FROM w WHERE len(ws) > 1),
f3 AS (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS phrase, 3 AS size FROM w WHERE len(ws) > 2),
f AS (SELECT lang, phrase, size, count(*) AS a FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3) GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= {LEAST_COUNT}),
cut AS (SELECT c.lang, c.phrase, c.size, c.a, k.k, array_to_string(c.ws[1:k.k], ' ') AS x, array_to_string(c.ws[k.k + 1:], ' ') AS y
        FROM c, (SELECT unnest([1, 2]) AS k) k WHERE k.k < c.size),
s AS (SELECT cut.*, l.a AS l, r.a AS r, ({UNIT}::HUGEINT * cut.a * cut.a // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = cut.x JOIN f r ON r.lang = cut.lang AND r.phrase = cut.y),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS a FROM (
        SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM c WHERE size = 3
        UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE size = 3) GROUP BY ALL),
o AS (SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.phrase = m.phrase WHERE i.a IS NULL OR 100 * i.a < {DROP_PERCENT} * m.a),
g AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM o)
SELECT g.lang, g.rank, g.phrase, g.a, g.l, g.r, t.n, g.score FROM g JOIN t ON t.lang = g.lang WHERE g.rank <= {TOP}
"""
