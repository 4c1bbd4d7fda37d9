"""Near-duplicate embeddings by cross-polytope hashing.

Equal vectors of a label are one node. Nodes are hashed in several tables: three pseudo-random
rotations (each of three rounds of random signs and a fast Hadamard transform) give three vectors, and
each is read as its nearest vertex of the cross-polytope, the signed axis of its largest
component. A node is entered in the bucket of its vertices and, by multiprobe, in the next
best ones. Members of a bucket are compared by cosine in double precision, in blocks of
bounded size; links join nodes to groups, and within each group all links are counted
exactly, again in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyscope.llm.common import mix64, read, stage
from proxyscope.llm.graph import cells, components, per_cell, reach

# Fixed values of the production run.
MIN_COSINE = 0.93
TABLES = 14
HASHES = 3  # rotations of a table
PROBES = 3
BLOCK = 1024
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotate(x: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """The pseudo-random rotation of this number, on rows padded to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([seed, number, d])
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
    return y


def vertices(y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest signed axes of each row and the size of the component there."""
    count = min(count, y.shape[1])
    size = np.abs(y)
    order = np.argsort(-size, axis=1, kind="stable")[:, :count]
    value = np.take_along_axis(y, order, axis=1)
    return order * 2 + (value < 0), np.abs(value)


def bucket_numbers(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES) -> np.ndarray:
    """Bucket of each row in each table and probe: shape (rows, tables * probes)."""
    out = []
    for t in range(tables):
        # vertex combinations, best first by the sum of components
        score = np.zeros((len(x), 1))
        number = np.full((len(x), 1), t + 1, dtype=np.uint64)
        for h in range(hashes):
            axis, size = vertices(rotate(x, hashes * t + h), probes)
            score = (score[:, :, None] + size[:, None, :]).reshape(len(x), -1)
            step = number[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + axis[:, None, :].astype(np.uint64)
            number = mix64(step.reshape(len(x), -1))
            best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            score, number = (np.take_along_axis(v, best, axis=1) for v in (score, number))
        out.append(number)
    return np.concatenate(out, axis=1).view(np.int64)


def _usable() -> Column:
    """Whether a row's label is there and its vector finite and not zero: what links at all."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    v = F.col("embedding")
    return F.col("label").isNotNull() & F.coalesce(F.forall(v, finite) & F.exists(v, lambda c: c != 0), F.lit(False))


def vector_rows(frame: DataFrame) -> DataFrame:
    """(vec_id, label, node, raw) of each usable vector; ``raw`` is its components as
    little-endian doubles and ``node`` a digest of label and components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, nodes, raws = [], [], [], []
            vectors = batch.column("embedding")
            flat = vectors.flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
            at = np.asarray(vectors.offsets, dtype=np.int64)
            at = at - at[0]
            for i, label in enumerate(batch.column("label").to_pylist()):
                v = values[at[i] : at[i + 1]]
                raw = (v + 0.0).astype("<f8").tobytes()
                ids.append(i)
                labels.append(label)
                nodes.append(hashlib.md5(f"{label}:".encode() + raw).digest())
                raws.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(ids, pa.int64())), batch.column("label").take(pa.array(ids, pa.int64())), pa.array(nodes, pa.binary()), pa.array(raws, pa.binary())],
                names=["vec_id", "label", "node", "raw"],
            )

    kind, label = (frame.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    rows = frame.where(_usable()).select("vec_id", "label", "embedding")
    return rows.mapInArrow(work, f"vec_id {kind}, label {label}, node binary, raw binary")


def _matrix(column) -> np.ndarray:
    """Unit rows of vectors of one length."""
    x = np.stack([np.frombuffer(r, dtype="<f8") for r in column.to_pylist()])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def buckets(nodes: DataFrame, tables: int, probes: int) -> DataFrame:
    """(node, bucket) rows; the bucket is a hash of label, length, table and vertices."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw")
            size = np.array([len(r) for r in raw.to_pylist()], np.int64)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                part = batch.take(pa.array(rows))
                numbers = bucket_numbers(_matrix(part.column("raw")), tables, probes)
                times = np.repeat(np.arange(len(rows)), numbers.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(pa.array(times)), part.column("label").take(pa.array(times)), pa.array(np.full(len(times), d)), pa.array(numbers.ravel())],
                    names=["node", "label", "size", "number"],
                )

    label = nodes.schema["label"].dataType.simpleString()
    out = nodes.select("node", "label", "raw").mapInArrow(work, f"node binary, label {label}, size long, number long")
    return out.select("node", F.xxhash64("label", "size", "number").alias("bucket"))


def shared_buckets(entries: DataFrame) -> DataFrame:
    """Members (node, bucket, n) of buckets of two or more; of buckets with equal members
    (told by size and two sums of hashes) one stays."""
    size = entries.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
    )
    one = size.where(F.col("n") > 1).groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    return entries.join(one.select("bucket", "n"), "bucket")


def near_vectors(frame: DataFrame, min_cosine: float = MIN_COSINE, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``frame`` (vec_id, embedding, label): vec_id, n_links,
    component_id, kept.

    Vectors of other labels or lengths are never compared. A null label, a null or zero
    vector, or one with a null or non-finite component links with nothing. Rows that repeat
    a vector link with each other. No rows give no rows; other columns are ignored.
    """
    rows = stage(vector_rows(frame))
    nodes = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("raw").alias("raw")
    )
    nodes = stage(nodes)
    met = shared_buckets(buckets(nodes, tables, probes)).join(nodes.select("node", "raw"), "node")
    blocks = F.ceil(F.col("n") / block)

    def link(table: pa.Table) -> dict[str, pa.Array]:
        x = _matrix(table.column("raw"))
        label = reach(len(x), lambda i, rest: x[rest] @ x[i] >= min_cosine)
        far = np.flatnonzero(label != np.arange(len(x)))
        node = table.column("node")
        return {"a": _take(node, far), "b": _take(node, label[far])} if len(far) else {}

    edges = per_cell(cells(met, "bucket", blocks), link, "a binary, b binary")
    groups = stage(components(edges))

    members = groups.join(nodes, "node")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = members.join(sizes, "component")

    def count(table: pa.Table) -> dict[str, pa.Array]:
        x = _matrix(table.column("raw"))
        copies = table.column("copies").to_numpy()
        side = table.column("side").to_numpy()
        both = bool(table.column("both")[0].as_py())
        linked = x @ x.T >= min_cosine
        np.fill_diagonal(linked, False)
        if both:
            linked &= side[:, None] != side[None, :]
        return {"node": table.column("node").combine_chunks(), "links": pa.array(linked @ copies)}

    counted = per_cell(cells(members, "component", F.ceil(F.col("n") / block)), count, "node binary, links long")
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    info = groups.join(least, "component").join(counted, "node", "left").select("node", "component_id", "links")
    info = nodes.select("node", "copies", "least").join(info, "node", "left").select(
        F.col("node").alias("of"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    usable = rows.select("vec_id", "node").join(info, F.col("node") == F.col("of")).select("vec_id", "n_links", "component_id")
    unused = frame.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = usable.unionByName(unused)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _take(column, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows)).combine_chunks() if isinstance(column, pa.ChunkedArray) else column.take(pa.array(rows))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors; see ``near_vectors`` for unusable ones."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
         AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
walk AS (SELECT vec_id AS n, vec_id AS root FROM v UNION SELECT link.b, walk.root FROM walk JOIN link ON walk.n = link.a),
comp AS (SELECT n, min(root) AS component_id FROM walk GROUP BY n),
cnt AS (SELECT a, count(*) AS c FROM link GROUP BY a)
SELECT v.vec_id, coalesce(c, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON comp.n = v.vec_id LEFT JOIN cnt ON cnt.a = v.vec_id
"""
