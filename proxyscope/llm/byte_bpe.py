"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding.

Texts are cut into words by the tokenizer's own pattern (vectorised over code points in
tasks). Words are encoded by Spark higher-order functions: the pairs of neighbouring byte
strings are folded, each step merging the leftmost of least rank, with the ranks in a literal
map (dealt to hash buckets, as a map
literal is searched from end to end). Words of more than ``LONG`` bytes take a fold whose
step merges all places of the least rank at once wherever that gives the same result.

The distinct words that occur most, up to a bound, are encoded first and sent to all tasks,
which look them up. A word beyond the bound is rare: it is encoded, once for each document,
by the same fold in the row where it stands, so no text and no word is shuffled for it.
Decoding concatenates the byte pieces of the ids. The look-up writes and decodes the runs of
ids between rare words; Spark expressions put the rare words' own between them and take the
digests, so that each task has one Python worker only.
"""

from __future__ import annotations

import base64
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxyscope.functions.fields import WHITE_SPACE
from proxyscope.llm.common import read, slices, stage, text_or_empty

# Fixed values of the production run.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
LONG = 64  # bytes of a word
FREQUENT = 1 << 19  # words sent to all tasks at most,
FREQUENT_BYTES = 64  # each of so many bytes at most
BUCKETS = 1 << 16
PLACE = 7  # bits of a place in a word of at most LONG bytes
NO_RANK = 1 << 31

# Fixed value: the pattern that ``word_starts`` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

OTHER, LETTER, NUMBER, SPACE = range(4)


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte pieces and their ranks, which are the ids 0, 1, 2, ... in turn."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"{path}: ids are not 0, 1, 2, ...")
    return ranks


def character_classes() -> bytes:
    """For every code point, whether it is a letter, a number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = bytearray(kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1))
    for c in WHITE_SPACE:
        out[ord(c)] = SPACE
    return bytes(out)


def word_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte places at which the words of a slice of texts begin. Words leave nothing out."""
    c = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(c)
    if not n:
        return np.zeros(0, np.int64)
    place = np.concatenate([[0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))])
    row = np.zeros(n + 1, dtype=bool)  # a text begins (or all end) here
    row[np.searchsorted(place, offsets)] = True
    row[n] = True
    kind = classes[c]
    run = row[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(run)
    end = np.append(begin[1:], n)
    space = kind[begin] == SPACE
    start = np.zeros(n, dtype=bool)
    start[begin[space]] = True
    # the last white space before a word stands apart: with the word if it is a blank
    start[end[space & ~row[end]] - 1] = True
    word = begin[~space]
    after_blank = (word > 0) & ~row[word] & (c[word - 1] == 0x20)
    start[word[~after_blank]] = True
    # 's 't 'm 'd 're 've 'll at a quote of its own
    alone = ~space & (end - begin == 1) & (c[begin] == 0x27)
    quote = begin[alone]
    quote = quote[((quote == 0) | row[quote] | (c[quote - 1] != 0x20)) & ~row[quote + 1]]
    one = c[quote + 1]
    two = np.where(~row[np.minimum(quote + 2, n)], c[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = np.zeros(len(quote), dtype=bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    start[quote[short | long] + 1] = False
    for ends, size in ((short, 2), (long & ~short, 3)):
        rest = quote[ends] + size
        start[rest[rest < n]] = True
    return place[:-1][start]


def words_of(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a slice of texts, and the first word of each text (and the end)."""
    starts = word_starts(data, offsets, classes)
    bounds = np.append(starts, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    return words.dictionary_encode(), np.searchsorted(starts, offsets)


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory that the one before needed goes back to the system."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def count_words(docs: DataFrame, classes) -> DataFrame:
    """(word, n) of every distinct word of the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        for batch in _released(batches):
            for _, _, data, offsets in slices(batch.column("text"), most_rows=1 << 20):
                words, _ = words_of(data, offsets, table)
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                if len(n):
                    yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n)], names=["word", "n"])

    found = docs.select(text_or_empty().alias("text")).mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: what a fold of nothing ends with. (An item
    of an array has Spark derive the type of all of ``body`` for each row, and copies its value.)"""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def rank_map(ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    """The ranks as a literal: an array of small maps from byte strings (a character per
    byte) to ranks, dealt by hash."""
    import xxhash

    held: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        key = piece.decode("latin-1")
        held[xxhash.xxh64_intdigest(key.encode(), seed=42) % buckets][key] = rank  # as F.xxhash64
    return F.from_json(F.lit(json.dumps(held)), "array<map<string,int>>")


def _coded(word: Column, rank: Callable[[Column], Column], long: int = LONG) -> Column:
    """Ids of a word that is not empty; ``rank`` gives a byte string's rank."""

    def encoded(text: Column) -> Column:
        longer = _let(F.split(text, ""), lambda pieces: _fold_long(pieces, rank))
        return F.transform(F.when(F.length(text) <= long, _fold(text, rank)).otherwise(longer), rank)

    return _let(F.decode(word.cast("binary"), "ISO-8859-1"), encoded)  # a character per byte


def _with_ranks(ranks: dict[bytes, int], body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function that gives ranks; the literal map stands in the plan once."""

    def with_map(held: Column) -> Column:
        # two's complement: the unsigned hash's low bits are the bucket
        bucket = lambda piece: F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
        return body(lambda piece: _let(piece, lambda key: F.element_at(F.get(held, bucket(key)), key)))

    return _let(rank_map(ranks), with_map)


def encode_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word (string, not empty), as an array of int."""
    return _with_ranks(ranks, lambda rank: _coded(word, rank))


def _each(words: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of each word of an array."""
    return _with_ranks(ranks, lambda rank: F.transform(words, lambda w: _coded(w, rank)))


def _pair_ranks(pieces: Column, rank: Callable[[Column], Column]) -> Column:
    head = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(head, lambda p, i: rank(F.concat(p, F.get(pieces, i + 1))))


def _fold(text: Column, rank: Callable[[Column], Column]) -> Column:
    """Merge the leftmost neighbours of least rank, once for each byte but one.

    A pair of neighbours is one number: its rank (``NO_RANK`` if none), then the places where it
    begins and ends, so that the least number is the leftmost pair of least rank. The state has
    for every place in the word the pair that meets there, null at both ends and inside of
    pieces. It holds numbers only, as Spark copies it with all that is in it; what is used
    more than once has a name, as Spark works out a lambda's expressions wherever they stand."""
    rest, none = F.lit(1 << 30), F.lit(None).cast("bigint")
    begin = lambda pair: F.shiftright(pair, PLACE).bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    end = lambda pair: pair.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")

    def pair(a: Column, b: Column, joined: Column | None = None) -> Column:  # null if a place is
        ranked = F.coalesce(rank(F.substring(text, a + 1, b - a) if joined is None else joined).cast("bigint"), F.lit(NO_RANK))
        return F.shiftleft(ranked, 2 * PLACE) + (F.shiftleft(a, PLACE) + b)

    def step(state: Column, _: Column) -> Column:
        def merge(least: Column) -> Column:
            return F.when(least < NO_RANK << 2 * PLACE, _let(begin(least), lambda a: _let(end(least), lambda b: merged(a, b)))).otherwise(state)

        def merged(a: Column, b: Column) -> Column:
            left = _let(begin(F.get(state, a)), lambda before: pair(before, b))
            right = _let(end(F.get(state, b)), lambda behind: pair(a, behind))
            return F.concat(F.slice(state, F.lit(1), a), F.array(left), F.array_repeat(none, b - a - 1), F.array(right), F.slice(state, b + 2, rest))

        return _let(F.array_min(state), merge)

    def pieces(state: Column) -> Column:
        """Each pair has the left one of its pieces begin; the last piece goes on to the end."""

        def cut(places: Column) -> Column:
            return F.transform(places, lambda a, i: F.substring(text, a + 1, F.coalesce(F.get(places, i + 1), F.lit(1 << 20)) - a))

        met = F.filter(F.transform(state, lambda pair, i: F.when(pair.isNotNull(), i)), lambda i: i.isNotNull())
        return _let(F.concat(F.array(F.lit(0)), met), cut)

    def fold(turns: Column) -> Column:
        start = F.concat(F.array(none), F.transform(turns, lambda i: pair(i - 1, i + 1, F.substring(text, i, F.lit(2)))), F.array(none))
        return F.aggregate(turns, start, step, pieces)

    return F.when(F.length(text) == 1, F.array(text)).otherwise(_let(F.sequence(F.lit(1), F.length(text) - 1), fold))


_OPEN, _CLOSE = "Ā", "ā"  # around each piece; pieces hold characters up to U+00FF


def _fold_long(pieces: Column, rank: Callable[[Column], Column]) -> Column:
    """The same merges with the pieces as one marked string. A step replaces all places of
    the least rank, from left to right, if they hold the same two pieces and no neighbour
    that this makes, at any time within the step, has a lower rank; else the leftmost only."""
    opened, closed = F.lit(_OPEN), F.lit(_CLOSE)

    def marked(parts: Column) -> Column:
        return F.concat(opened, F.array_join(parts, _CLOSE + _OPEN), closed)

    def parts_of(text: Column) -> Column:
        return F.split(F.substring(text, F.lit(2), F.length(text) - 2), _CLOSE + _OPEN)

    def step(state: Column, _: Column) -> Column:
        def of_parts(p: Column) -> Column:
            def of_ranks(r: Column) -> Column:
                def merge(j: Column) -> Column:
                    least, a, b = F.get(r, j - 1), F.get(p, j - 1), F.get(p, j)

                    def joined(ab: Column) -> Column:
                        higher = lambda x: F.coalesce(rank(x) > least, F.lit(True))
                        safe = higher(F.concat(ab, ab)) & F.forall(
                            F.sequence(F.lit(0), F.size(r) - 1),
                            lambda i: ~F.get(r, i).eqNullSafe(least)
                            | ((F.get(p, i) == a) & higher(F.concat(ab, F.get(p, i + 2))) & higher(F.concat(F.get(p, i - 1), ab))),
                        )
                        one = F.size(F.filter(r, lambda x: x == least)) == 1
                        everywhere = F.replace(state["s"], F.concat(opened, a, closed, opened, b, closed), F.concat(opened, ab, closed))
                        leftmost = marked(F.concat(F.slice(p, F.lit(1), j - 1), F.array(ab), F.slice(p, j + 2, F.size(p))))
                        return F.struct(F.when(one | safe, everywhere).otherwise(leftmost).alias("s"), F.lit(True).alias("on"))

                    return _let(F.concat(a, b), joined)

                least = F.array_min(r)
                ended = F.struct(state["s"].alias("s"), F.lit(False).alias("on"))
                return F.when(least.isNull(), ended).otherwise(_let(F.array_position(r, least).cast("int"), merge))

            return _let(_pair_ranks(p, rank), of_ranks)

        return F.when(state["on"], _let(parts_of(state["s"]), of_parts)).otherwise(state)

    start = F.struct(marked(pieces).alias("s"), F.lit(True).alias("on"))
    return parts_of(F.aggregate(pieces, start, step)["s"])


def word_hashes(words: pa.Array) -> np.ndarray:
    """As F.xxhash64, unsigned."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, seed=42) for w in words.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column without nulls."""
    first = np.asarray(column.offsets, dtype=np.int64)
    return first - first[0], column.flatten().to_numpy(zero_copy_only=False)


class KnownWords:
    """Codes of words that can be looked up, from rows (word, ids, hash); made on the driver
    and sent to the tasks."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("hash").combine_chunks() if table.num_rows else table
        one = lambda name, kind: pa.concat_arrays(table.column(name).chunks).cast(kind) if table.num_rows else pa.array([], kind)
        hashes = one("hash", pa.int64()).to_numpy().view(np.uint64)
        half = int(np.searchsorted(hashes.view(np.int64), 0))  # signed order has the greater half first
        self.hashes = np.concatenate([hashes[half:], hashes[:half]])
        self.turn, self.words = half, one("word", pa.string())
        self.first, self.ids = _lists(one("ids", pa.list_(pa.int32())))

    def find(self, words: pa.Array) -> np.ndarray:
        """Number of each word, -1 where it is not here (or behind another of equal hash)."""
        if not len(self.words) or not len(words):
            return np.full(len(words), -1, dtype=np.int64)
        hashes = word_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = (at + self.turn) % len(self.hashes)
        same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words in turn, and the first of each word (and the end)."""
        size = self.first[numbers + 1] - self.first[numbers]
        first = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(first[-1]) + np.repeat(self.first[numbers] - first[:-1], size)], first


def written(pieces: list[bytes]) -> tuple[list[str], list[str]]:
    """For every id, its decimal form with a comma, and its bytes (a character per byte)."""
    return [f"{i}," for i in range(len(pieces))], [p.decode("latin-1") for p in pieces]


def runs_of(table: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> pa.StringArray:
    """What ``table`` has for the ids, joined from each of ``cuts`` to the next (and the end)."""
    parts = table.take(pa.array(ids))
    bounds = np.frombuffer(parts.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    data = parts.buffers()[2] if len(ids) else pa.py_buffer(b"")
    return pa.StringArray.from_buffers(len(cuts), pa.py_buffer(bounds[np.append(cuts, len(ids))]), data)


def _filled(runs: str, found: Column, table: list[str]) -> Column:
    """The strings of ``runs``, and between each two what ``table`` has for the ids of the
    list of ``found`` that ``between`` names."""

    def joined(own: Column) -> Column:
        return F.array_join(F.zip_with(F.col(runs), F.col("between"), lambda run, i: F.concat(run, F.coalesce(F.get(own, i), F.lit("")))), "")

    def with_table(held: Column) -> Column:
        return _let(F.transform(found, lambda ids: F.array_join(F.transform(ids, lambda i: F.get(held, i)), "")), joined)

    return _let(F.from_json(F.lit(json.dumps(table)), "array<string>"), with_table)


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """Words of ``counts`` (word, n) of at least so many occurrences that there are at most
    ``most``, of ``FREQUENT_BYTES`` bytes or fewer each."""
    upto = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row for each number of occurrences: about the root of the tokens at the most.
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(upto))
    least = sizes.where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return counts.where((F.col("n") >= least) & (F.octet_length("word") <= FREQUENT_BYTES)) if least else counts.limit(0)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256 (of the ids in
    decimal, joined by commas), decoded_sha256 (of the bytes that the ids decode to).

    Null text is empty; an empty text has no ids. Repeated rows and rows without doc_id are
    documents of their own, no rows give no rows, and other columns are ignored.
    ``frequent`` bounds the words that are sent to all tasks; it does not change the result.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    context = spark.sparkContext
    classes = context.broadcast(character_classes())
    counts = stage(count_words(docs, classes).where(F.col("word") != ""))
    common = frequent_words(counts, frequent).repartition(64, "word").select(
        "word", encode_words(F.col("word"), ranks).alias("ids"), F.xxhash64("word").alias("hash")
    )
    common = context.broadcast(KnownWords(common.toArrow()))
    pa.default_memory_pool().release_unused()
    pieces = [p for p, _ in sorted(ranks.items(), key=lambda x: x[1])]
    decimals, characters = written(pieces)
    tables = context.broadcast((pa.array(decimals), pa.array(characters)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, n, shown, raw, between, missing): the number of ids of known words; these
        written out and decoded, from one word that is not known to the next; the places that
        those words have in ``missing``."""
        table, known = np.frombuffer(classes.value, np.uint8), common.value
        shown, raw = tables.value
        for batch in _released(batches):
            for a, b, data, offsets in slices(batch.column("text"), most_rows=1 << 20):
                words, first = words_of(data, offsets, table)
                at = words.indices.to_numpy().astype(np.int64)
                number = known.find(words.dictionary)
                own = number[at] >= 0
                lost = np.flatnonzero(~own)
                row = np.repeat(np.arange(b - a), np.diff(first))[lost]
                # a text's missing words, each once, in the order of the slice's dictionary
                pair, place = np.unique((row << 32) | at[lost], return_inverse=True)
                begins = np.searchsorted(pair >> 32, np.arange(b - a + 1))
                missing = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), words.dictionary.take(pa.array(pair & 0xFFFFFFFF)))
                ids, begin = known.spell(number[at[own]])
                # a run begins with each text and behind each missing word
                start, of = np.concatenate([first[:-1], lost + 1]), np.concatenate([np.arange(b - a), row])
                begin = begin[np.concatenate([[0], np.cumsum(own)])]  # the first id of each word, known or not
                cuts = begin[start[np.lexsort((start, of))]]
                upto = np.searchsorted(row, np.arange(b - a + 1))  # missing words before each text
                runs = pa.array((upto + np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(begin[first])),
                     *(pa.ListArray.from_arrays(runs, runs_of(x, ids, cuts)) for x in (shown, raw)),
                     pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array((place - begins[row]).astype(np.int32))), missing],
                    names=["doc_id", "n", "shown", "raw", "between", "missing"],
                )

    schema = f"doc_id {kind}, n long, shown array<string>, raw array<string>, between array<int>, missing array<string>"
    coded = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(look_up, schema)
    coded = coded.select("doc_id", "n", "shown", "raw", "between", _each(F.col("missing"), ranks).alias("found"))
    found = F.col("found")
    return coded.select(
        "doc_id",
        F.aggregate("between", F.col("n"), lambda n, i: n + F.size(F.get(found, i))).alias("n_tokens"),
        F.sha2(F.rtrim(_filled("shown", found, decimals), F.lit(",")), 256).alias("ids_sha256"),
        F.sha2(F.encode(_filled("raw", found, characters), "ISO-8859-1"), 256).alias("decoded_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the production tokenizer and decoded again."""
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), load_ranks(public_tokenizers.path(TOKENIZER)))
