"""N-gram Jaccard join: Bayesian pruning of MinHash candidates, exact verification.

Shingles are runs of five words (A-Z in lower case). Documents with equal shingle sets are
one node. A node has 128 MinHash values, kept to one byte each for comparison; bands of four
full values make its bucket keys. Members of a bucket are compared eight, then more values
at a time: a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold (uniform prior, given the matches so far) falls below a tolerance. The
pairs left join nodes to groups; within a group all pairs are verified exactly on their
shingle sets, in blocks of bounded size, and the links are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyscope.llm.common import ROW_KEY, Words, mix64, numbered, read, shingles, slices, stage, text_or_empty
from proxyscope.llm.embedding_dedup import _take, shared_buckets
from proxyscope.llm.graph import cells, components, per_cell, reach

# Fixed values of the production run.
WIDTH = 5
THRESHOLD = (4, 5)  # similarity of 4 / 5 or more, kept as integers for an exact test
HASHES = 128
ROWS, BANDS = 4, 24
TOLERANCE = 1e-6
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
SEED = 1
_ROW_BITS = 10  # rows of a slice


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (54 bits) of a slice of up to 1,024 texts, by row, and the
    first index of each row (and the end)."""
    h, row = shingles(Words(data, offsets), width)
    key = np.sort((row.astype(np.uint64) << np.uint64(64 - _ROW_BITS)) | (h >> np.uint64(_ROW_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    rows = (key >> np.uint64(64 - _ROW_BITS)).astype(np.int64)
    return key & np.uint64((1 << (64 - _ROW_BITS)) - 1), np.searchsorted(rows, np.arange(len(offsets)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * 2 + 1, rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def min_hashes(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (rows x HASHES, 32 bits) of non-empty sets."""
    x = (mix64(sets) >> np.uint64(32)).astype(np.uint32)
    a, b = _multipliers()
    out = np.empty((HASHES, len(first) - 1), dtype=np.uint32)
    for i in range(HASHES):
        out[i] = np.minimum.reduceat(x * a[i] + b[i], first[:-1])
    return out.T


def band_keys(values: np.ndarray) -> np.ndarray:
    """Bucket keys (rows x BANDS) from the MinHash values."""
    v = values[:, : ROWS * BANDS].astype(np.uint64).reshape(len(values), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix64(key ^ v[:, :, j]) + np.uint64(j)
    return key.view(np.int64)


def node_names(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """16 bytes that tell sets apart: two sums of hashes of their members."""
    low = np.add.reduceat(mix64(sets), first[:-1])
    high = np.add.reduceat(mix64(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[:-1])
    raw = np.stack([mix64(high), mix64(low + np.diff(first).astype(np.uint64))], axis=1).astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, ROW_KEY, node, size, sig, bands) of every text of numbered rows that has a word."""
    keys = ["doc_id", *ROW_KEY]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), most_rows=1 << _ROW_BITS):
                sets, first = shingle_sets(data, offsets)
                rows = np.flatnonzero(np.diff(first))
                if not len(rows):
                    continue
                first = np.append(first[rows], first[-1])
                values = min_hashes(sets, first)
                sig = (mix64(values.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes()
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(values).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a).take(pa.array(rows)) for k in keys), pa.array(node_names(sets, first), pa.binary()), pa.array(np.diff(first).astype(np.int64)),
                     pa.array([sig[i : i + HASHES] for i in range(0, len(sig), HASHES)], pa.binary()), bands],
                    names=[*keys, "node", "size", "sig", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(*keys, text_or_empty().alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, {ROW_KEY[0]} long, {ROW_KEY[1]} long, node binary, size long, sig binary, bands array<long>")


STEPS = (8, 16, 32, 64, 128)


@cache
def least_matches(tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the fewest matches with which a pair may stay.

    Bytes of different values agree by chance in one of 256 cases, so a pair of similarity s
    matches with probability s + (1 - s) / 256. With a uniform prior on s, the posterior
    probability of s >= threshold after m matches of n is a ratio of integrals, taken here
    over a fine grid.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    high = s >= THRESHOLD[0] / THRESHOLD[1]
    out = {}
    for n in STEPS:
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[high].sum() / weight.sum() >= tolerance:
                out[n] = m
                break
    return out


def may_reach(one: np.ndarray, others: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which rows of ``others`` stay candidates of ``one``, by growing numbers of values."""
    alive = np.arange(len(others))
    matches = np.zeros(len(others), dtype=np.int64)
    done = 0
    for n in STEPS:
        matches[alive] += (others[alive, done:n] == one[done:n]).sum(axis=1)
        alive = alive[matches[alive] >= least[n]]
        done = n
        if not len(alive):
            break
    hit = np.zeros(len(others), dtype=bool)
    hit[alive] = True
    return hit


def shared_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets."""
    n = len(sets)
    if n == 2:
        a, b = sets
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = int((b[at] == a).sum())
        return np.array([[len(a), common], [common, len(b)]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    number = np.cumsum(new) - 1
    often = np.bincount(number)
    column = np.cumsum(often > 1) - 1
    keep = (often > 1)[number]
    owner, column = owner[keep], column[number[keep]]
    total = np.zeros((n, n), dtype=np.float32)
    step = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        dense = np.zeros((n, step), dtype=np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        total += dense @ dense.T
    return np.rint(total).astype(np.int64)


def verified_links(table: pa.Table) -> dict[str, pa.Array]:
    """Per member of a cell: the weight of its linked partners and the least one it reaches."""
    sets = [np.frombuffer(s, dtype="<u8") for s in table.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets])
    side = table.column("side").to_numpy()
    up, down = THRESHOLD
    # inter / (a + b - inter) >= up / down, in integers
    linked = shared_sizes(sets) * (up + down) >= up * (size[:, None] + size[None, :])
    np.fill_diagonal(linked, False)
    if table.column("both")[0].as_py():
        linked &= side[:, None] != side[None, :]
    root = reach(len(sets), lambda i, rest: linked[i, rest])
    node = table.column("node").combine_chunks()
    part = table.column("blocks").combine_chunks()
    return {"node": node, "links": pa.array(linked @ table.column("copies").to_numpy()), "root": _take(node, root), "blocks": part}


def _same_row(rows: DataFrame, key: Column) -> Column:
    """Whether ``key`` (a struct) names the row."""
    same = rows["doc_id"].eqNullSafe(key["doc_id"])
    for k in ROW_KEY:
        same &= rows[k] == key[k]
    return same


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of numbered rows: the signatures; (node, copies, head, size, sig, bands) of every node,
    whose head names its first row, of least (doc_id, ROW_KEY) with null ids last; (node, links)
    and (node, component) of the nodes that have candidates."""
    known = stage(signatures(docs))
    nodes = known.groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_KEY)).alias("head"),
        F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"),
    )
    nodes = stage(nodes)
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    met = shared_buckets(entries).join(nodes.select("node", "sig"), "node")
    least = least_matches()

    def prune(table: pa.Table) -> dict[str, pa.Array]:
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
        label = reach(len(sig), lambda i, rest: may_reach(sig[i], sig[rest], least))
        far = np.flatnonzero(label != np.arange(len(sig)))
        node = table.column("node")
        return {"a": _take(node, far), "b": _take(node, label[far])} if len(far) else {}

    edges = per_cell(cells(met, "bucket", F.ceil(F.col("n") / (4 * BLOCK))), prune, "a binary, b binary")
    groups = stage(components(edges))

    members = groups.join(nodes.select("node", "copies", "head", "size"), "node")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    members = members.join(sizes, "component").select("node", "component", "copies", "head", blocks.alias("blocks"))
    texts = docs.select("doc_id", *ROW_KEY, text_or_empty().alias("text"))
    of = members.join(texts, _same_row(texts, members["head"]))
    listed = _shingle_rows(of.select("node", "component", "copies", "blocks", "text"))
    found = stage(per_cell(cells(listed, "component", F.col("blocks")), verified_links, "node binary, links long, root binary, blocks long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # A group of one block was searched whole in its cell; only the parts of others must be joined.
    joined = found.where(F.col("blocks") == 1).select("node", F.col("root").alias("component"))
    parted = found.where(F.col("blocks") > 1).select(F.col("node").alias("a"), F.col("root").alias("b"))
    if parted.limit(1).count():
        joined = joined.unionAll(components(parted))
    return known, nodes, links, joined


def _bare() -> Column:
    """Whether a text is null or without a word."""
    return ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) per row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id reachable over links (similarity of 0.8 or more), n_links
    the number of other rows linked directly, n_copies that of rows with the same shingle
    set (itself included). Texts of one to four words have one shingle, the whole text. Null
    and empty texts, and texts without a word, link with nothing and are a class of their
    own. Repeated rows are copies of each other; no rows give no rows; other columns are
    ignored.
    """
    known, nodes, links, joined = _linked(numbered(docs))
    info = nodes.select("node", "copies", F.col("head.doc_id").alias("least")).join(joined, "node", "left").join(links, "node", "left")
    info = info.withColumn("component", F.coalesce("component", "node"))
    first = info.groupBy("component").agg(F.min("least").alias("class_id"))
    info = info.join(first, "component").select(
        F.col("node").alias("of"), "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    named = known.select("doc_id", "node").join(info, F.col("node") == F.col("of"))
    named = named.select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies"))
    bare = docs.where(_bare())
    bare = bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return named.unionByName(bare)


def _shingle_rows(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by ``shingles``, the sorted shingle hashes as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text"), most_rows=1 << _ROW_BITS):
                sets, first = shingle_sets(data, offsets)
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                names = node_names(sets, np.append(first[full], first[-1]))
                part = batch.slice(a, b - a)
                wanted = part.column("node").to_pylist()
                rows = np.array([r for r, name in zip(full, names, strict=True) if wanted[r] == name], np.int64)
                part = part.take(pa.array(rows))
                raw = [sets[first[r] : first[r + 1]].astype("<u8").tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "component", "copies", "blocks")), pa.array(raw, pa.binary())], names=["node", "component", "copies", "blocks", "shingles"])

    out = rows.mapInArrow(work, "node binary, component binary, copies long, blocks long, shingles binary")
    return out


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each class: that of least doc_id, of rows under
    one id the least by its text's hash, and one without an id only where no other is in the
    class. Texts without a word all stay, as each is a class of its own."""
    rows = numbered(docs)
    _, nodes, _, joined = _linked(rows)
    heads = nodes.select("node", "head").join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("_class"))
    heads = heads.agg(F.min("head").alias("_head")).select("_head")
    marked = rows.join(heads, _same_row(rows, heads["_head"]), "left")
    return marked.where(F.col("_head").isNotNull() | _bare()).select(*docs.columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents; see ``jaccard_classes`` for nulls, repeats and empty tables."""
    return jaccard_classes(read(spark, sf_dir, "documents"))
