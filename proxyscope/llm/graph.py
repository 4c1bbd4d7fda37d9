"""Groups of rows compared in blocks, and connected components of the links found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxyscope.llm.common import stage


def cells(rows: DataFrame, group: str, blocks: Column, node: str = "node") -> DataFrame:
    """Deal the members of each group to cells such that every two members meet in one.

    A group is split by hash into ``blocks`` blocks (1 for most); there is a cell for each
    block and for each two blocks, so a member is copied once per block and a group of any
    size is spread over many tasks. Adds ``cell`` (a key) and ``side`` (the member's block)
    and ``both`` (whether the cell joins two blocks).
    """
    own = F.pmod(F.xxhash64(F.lit(7), node), F.col("n_blocks"))
    r = rows.withColumn("n_blocks", blocks.cast("int")).withColumn("side", own.cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    return r.withColumn("both", low != high).withColumn("cell", F.xxhash64(group, low, high)).drop("other", "n_blocks")


def per_cell(dealt: DataFrame, work: Callable[[pa.Table], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Apply ``work`` to the rows of each cell. Cells stream through sorted partitions, so a
    task holds one cell at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                table = pa.concat_tables([held, table])
            key = table.column("cell").to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            edges = [0, *cuts.tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield from _result(work, table.slice(a, b - a))
            held = table.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from _result(work, held)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def _result(work, table: pa.Table) -> Iterator[pa.RecordBatch]:
    if table.num_rows < 2:
        return
    out = work(table.combine_chunks())
    if out:
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def reach(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Label 0..n-1 by the least index that can be reached by links.

    ``near(i, rest)`` tells which of ``rest`` are linked to i. Every member is compared with
    all those not reached yet, so no link between parts is missed, while a dense group costs
    little more than one comparison each.
    """
    label = np.full(n, -1, dtype=np.int64)
    rest = np.arange(n)
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        label[root] = root
        front = [root]
        while front and len(rest):
            hit = near(front.pop(), rest)
            found = rest[hit]
            label[found] = root
            front.extend(found.tolist())
            rest = rest[~hit]
    return label


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node it is connected to.

    Edges point from the greater to the lesser node. In each round every node takes its least
    neighbour for its parent, and then that one's parent; its other neighbours are linked to
    the same. Once each node has one edge, only parents are followed, and the end is seen in
    the round's own table: no node has two edges or a parent that has a parent. Parents are
    written to the shared folder before they are joined: both sides of a join are then plain
    shuffles, which Spark may split where very many nodes have one parent.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def pointed(df: DataFrame) -> DataFrame:
        out = df.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return stage(out.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"))

    now, single = pointed(edges), False
    for _ in range(most_rounds):
        low = now.withColumnRenamed("b", "m").withColumn("k", F.lit(1).cast("long")) if single else stage(
            now.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k"))
        )
        above = low.select(F.col("a").alias("m"), F.col("m").alias("over"))
        jumped = stage(low.join(above, "m", "left").select("a", F.coalesce("over", "m").alias("b"), "m", "k", F.col("over").isNotNull().alias("moved")))
        most, moved = jumped.agg(F.max("k"), F.max("moved")).first()
        single = (most or 0) <= 1
        if single and not moved:
            break
        parents = jumped.select("a", "b")
        if single:
            now = parents
            continue
        others = now.join(jumped.where(F.col("k") > 1).select("a", "m", F.col("b").alias("to")), "a").where(F.col("b") != F.col("m"))
        now = pointed(parents.unionAll(others.select(F.col("b").alias("a"), F.col("to").alias("b"))))
    else:
        raise RuntimeError("components: no end reached")
    roots = jumped.groupBy("b").agg(F.lit(1).alias("one")).select(F.col("b").alias("node"), F.col("b").alias("component"))
    found = jumped.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
    return found.select(F.col("node").cast(kind).alias("node"), "component")
