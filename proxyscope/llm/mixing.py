"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are the tokens. The words of each source are one stream: its documents, dealt to
shards by the first hex digits of md5(seed, doc_id, text) and ordered by that digest. There
are 256 shards, and 16 times as many whenever they would hold more than 4,096 rows on average;
the text takes part, so rows under one id (or none) are spread too.
The stream is cut into blocks of equally many words. Blocks go to sources by highest
quotients target / (2k + 1), then within a source to its shards by size in the same way,
and a shard takes its quota as whole passes over its blocks plus a seeded choice (an affine
permutation of the block numbers) for the rest. All is arithmetic on sizes: the only
shuffles move (doc_id, size) rows, partially summed wherever a total is meant. Words are
counted once: those rows are written as a table that all later steps read. Windows over
sources alone hold one row a source or a shard, never one a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxyscope.llm.common import ROW_KEY, WORD, Words, numbered, read, stage, text_or_empty

# Fixed values of the production mix.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 32
SEED = "mix"
SHARD_ROWS = 4_096
STEP = 1_000_000_007  # a prime above any number of blocks in a shard
TURN = 12_345


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) plus ``weight`` and ``target``.

    Sources in code point order, null last, take the weights in turn. All sizes together
    are shared by weight; a target stops at ``max_repeats`` times its source's size, and the
    excess is shared again by weight until none is above. In order of cap per weight the
    stopped sources come first, so one pass with running sums finds where stopping ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int"))
    by_cap = Window.orderBy(
        (F.col("source_size").cast("double") / F.col("weight")), F.col("source").asc_nulls_last()
    )
    whole = Window.partitionBy()
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    out = out.withColumn(
        "rest", F.sum("source_size").over(whole) - F.sum("cap").over(by_cap) + F.col("cap")
    ).withColumn("open_weight", F.sum("weight").over(whole) - F.sum("weight").over(by_cap) + F.col("weight"))
    fits = F.col("rest") * F.col("weight") <= F.col("cap") * F.col("open_weight")
    seen = F.sum(fits.cast("int")).over(by_cap)
    level = F.min(F.when(fits, F.struct((F.lit(0) - F.col("open_weight")).alias("o"), "rest", "open_weight"))).over(whole)
    out = out.withColumn("seen", seen).withColumn("level", level)
    target = F.when(F.col("seen") == 0, F.col("cap").cast("double")).otherwise(
        (F.col("level.rest") * F.col("weight")).cast("double") / F.col("level.open_weight").cast("double")
    )
    return out.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, keys: list[str], tie: list[Column]) -> DataFrame:
    """(keys, tie0.., quota) of parties with ``share`` (weight), ``seats`` (of the group
    ``keys``) and ``cap``: the seats go to the highest quotients share / (2k + 1), k below
    cap. If the caps together are below the seats, each party gets its cap.

    At a level m a party has min(cap, floor(share * m + 1/2)) seats, so m lies between the
    levels at which min(cap, share * m + 1/2) and min(cap, share * m - 1/2) add up to the seats.
    Seats won at the lower level are given; only the quotients between the two, about three
    for each party, are listed and ranked.
    """
    ties = [f"tie{i}" for i in range(len(tie))]
    p = parties.select(*keys, *[t.alias(n) for t, n in zip(tie, ties, strict=True)], F.col("share").cast("double").alias("share"),
                       F.col("seats").cast("double").alias("seats"), F.col("cap").cast("long").alias("cap"))
    for name, half in (("low", 0.5), ("high", -0.5)):
        p = p.withColumn("full", F.when(F.col("share") > 0, (F.col("cap") - F.lit(half)) / F.col("share")).otherwise(F.lit(float("inf"))))
        order = Window.partitionBy(*keys).orderBy("full", *[F.col(t).asc_nulls_last() for t in ties])
        rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        open_seats = F.col("seats") - F.coalesce(F.sum("cap").over(before), F.lit(0)) - F.count(F.lit(1)).over(rest) * half
        share = F.sum("share").over(rest)
        p = p.withColumn("at", F.when(share > 0, open_seats / share)).withColumn("place", F.row_number().over(order))
        level = F.min(F.when(F.col("at") <= F.col("full"), F.struct("place", "at"))).over(Window.partitionBy(*keys))
        p = p.withColumn(name, level["at"])  # null: every party is at its cap

    def won(level: str, more: int) -> Column:
        n = F.floor(F.col("share") * F.col(level) + 0.5) + more
        return F.greatest(F.lit(0), F.least("cap", F.coalesce(n, F.col("cap")))).cast("long")

    p = p.withColumn("given", won("low", -1)).withColumn("most", F.greatest("given", won("high", 1)))
    k = F.when(F.col("most") > F.col("given"), F.sequence(F.col("given"), F.col("most") - 1)).otherwise(F.array().cast("array<bigint>"))
    p = p.withColumn("open", F.col("seats") - F.sum("given").over(Window.partitionBy(*keys))).withColumn("k", k)
    listed = p.select(*keys, *ties, "open", "share", "given", F.explode_outer("k").alias("k"))
    quotient = F.col("share") / (F.col("k") * 2 + 1)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(quotient.desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties], "k"))
    taken = F.col("k").isNotNull() & (F.col("rank") <= F.col("open"))
    return listed.withColumn("rank", rank).groupBy(*keys, *ties).agg((F.max("given") + F.count(F.when(taken, 1))).alias("quota"))


def shard_digits(n: int) -> int:
    """Hex digits that name a shard when there are ``n`` rows."""
    digits = 2
    while digits < 8 and n > SHARD_ROWS * 16**digits:
        digits += 1
    return digits


def placed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    block: int = BLOCK,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, source) at its place in its source's stream, with
    what its shard takes: ROW_KEY of ``numbered``, doc_id, source, size, source_size, target and
    ``parts``, an array of (start, end, times): word numbers in the document and how often they
    are taken. ``docs`` has been through ``numbered``."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(seed), id_text, F.md5(text_or_empty().cast("binary"))).cast("binary"))
    rows = stage(docs.select(*ROW_KEY, "doc_id", "source", n_words(text_or_empty()).alias("size"), digest.alias("digest")))
    rows = rows.withColumn("shard", F.substring("digest", 1, shard_digits(rows.count())))
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    sizes = shards.groupBy("source").agg(F.sum("shard_size").alias("source_size"))
    goal = source_targets(sizes, weights, max_repeats).withColumn("all", F.lit(1))
    every = Window.partitionBy("all")
    goal = goal.withColumn("share", F.col("target")).withColumn(
        "seats", F.round(F.sum("source_size").over(every) / block).cast("long")
    )
    goal = goal.withColumn("cap", F.ceil(F.col("source_size") / block) * max_repeats)
    won = sainte_lague(goal, ["all"], [F.col("source")]).select(F.col("tie0").alias("w_source"), F.col("quota").alias("seats"))
    goal = goal.drop("seats").join(won, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target", "seats")

    s = shards.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    along = Window.partitionBy("source").orderBy("shard")
    s = s.withColumn("offset", F.sum("shard_size").over(along) - F.col("shard_size"))
    first = F.ceil(F.col("offset") / block)
    end = F.ceil((F.col("offset") + F.col("shard_size")) / block)
    s = s.withColumn("first", first).withColumn("blocks", end - first)
    parties = s.withColumn("share", F.col("shard_size").cast("double")).withColumn("cap", F.col("blocks") * max_repeats)
    parties = parties.withColumn("g", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    quotas = sainte_lague(parties, ["g"], [F.col("shard")]).select("g", F.col("tie0").alias("q_shard"), "quota")
    s = parties.join(quotas.withColumnRenamed("g", "q_g"), (F.col("g") == F.col("q_g")) & (F.col("shard") == F.col("q_shard")))
    s = s.withColumn("passes", F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(F.lit(0)))
    s = s.withColumn("extra", F.col("quota") - F.col("passes") * F.col("blocks"))
    last = _passes(F.col("blocks") - 1)
    s = s.withColumn("last_passes", F.when(F.col("blocks") > 0, last))
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("before", F.coalesce(F.last("last_passes", ignorenulls=True).over(earlier), F.lit(0)))
    s = s.select(
        F.col("source").alias("s_source"), F.col("shard").alias("s_shard"),
        "source_size", "target", "offset", "first", "blocks", "passes", "extra", "before",
    )

    # Empty rows have no part in the stream: they are spread, however many are alike.
    apart = F.when(F.col("size") == 0, F.pmod(F.col(ROW_KEY[1]), F.lit(1024)))
    stream = Window.partitionBy("source", "shard", apart).orderBy("digest", "doc_id", *ROW_KEY)
    d = rows.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))
    d = d.withColumn("end", F.col("end") + F.col("offset")).withColumn("start", F.col("end") - F.col("size"))

    def part(b: Column) -> Column:
        times = F.when(b < F.col("first"), F.col("before")).otherwise(_passes(b - F.col("first")))
        low = F.greatest(F.col("start"), b * block) - F.col("start")
        high = F.least(F.col("end"), (b + 1) * block) - F.col("start")
        return F.struct(low.alias("start"), high.alias("end"), times.cast("long").alias("times"))

    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    parts = F.when(F.col("size") > 0, F.transform(blocks, part))
    return d.select(*ROW_KEY, "doc_id", "source", "size", "source_size", "target", parts.alias("parts"))


def mix_sources(docs: DataFrame, **mix) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size,
    target, taken (words the mix takes; repeats count each time).

    Null text has size 0; a null source is a source of its own; rows that repeat count each
    for itself; no rows give no rows. Other columns are ignored.
    """
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda t, p: t + (p["end"] - p["start"]) * p["times"])
    return placed_documents(numbered(docs), **mix).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce(taken, F.lit(0).cast("long")).alias("taken")
    )


def _copies(text: str, parts: list[dict]) -> Iterator[str]:
    """The text of each pass over a document: the whole text, or the parts it takes, with
    parts that do not adjoin on lines of their own."""
    raw = text.encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    words = Words(data, np.array([0, len(raw)]))
    for turn in range(1, max(p["times"] for p in parts) + 1):
        runs: list[list[int]] = []
        for p in parts:
            if p["times"] < turn:
                continue
            if runs and runs[-1][1] == p["start"]:
                runs[-1][1] = p["end"]
            else:
                runs.append([p["start"], p["end"]])
        if runs == [[0, len(words.start)]]:
            yield text
        else:
            yield b"\n".join(raw[words.start[a] : words.end[b - 1]] for a, b in runs).decode()


def mixed_documents(docs: DataFrame, **mix) -> DataFrame:
    """The mix itself: ``docs``, all columns, with one row for each pass that takes words of
    the document and in ``text`` the words it takes (``n_chars`` follows the text).
    Documents of which no words are taken go, null and empty texts among them. Rows that repeat,
    also under one id or none, are told apart by ROW_KEY, so each has its own place in the mix
    and no key holds more than one row. No rows give no rows."""
    rows = numbered(docs)
    taken = F.filter("parts", lambda p: p["times"] > 0)
    place = placed_documents(rows, **mix).select(F.struct(*ROW_KEY).alias("mix_key"), taken.alias("_mix_parts"))
    place = place.where(F.size("_mix_parts") > 0)
    left = rows.select(F.struct(*[rows[c] for c in docs.columns]).alias("_row"), F.struct(*ROW_KEY).alias("_key"))
    joined = left.join(place, F.col("_key") == F.col("mix_key")).select("_row.*", "_mix_parts")
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for i, (text, parts) in enumerate(zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                for copy in _copies(text, parts):
                    rows.append(i)
                    texts.append(copy)
            columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            columns[at] = pa.array(texts, columns[at].type)
            if length is not None:
                columns[length] = pa.array([len(t) for t in texts], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return joined.mapInArrow(work, docs.schema)


def _passes(i: Column) -> Column:
    """How often block ``i`` of its shard is taken: ``extra`` blocks once more than the rest."""
    chosen = F.pmod(i * STEP + TURN, F.col("blocks")) < F.col("extra")
    return F.col("passes") + chosen.cast("long")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; see ``mix_sources`` for nulls, repeats and empty tables."""
    return mix_sources(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
nd AS (SELECT 2 + CAST(count(*) > {SHARD_ROWS} * 256 AS INT) + CAST(count(*) > {SHARD_ROWS} * 4096 AS INT)
       + CAST(count(*) > {SHARD_ROWS} * 65536 AS INT) AS digits FROM documents),
dd AS (SELECT *, substr(digest, 1, (SELECT digits FROM nd)) AS shard FROM d),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
wt AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM src),
-- a source is stopped at its cap as long as the level of those not yet stopped is above it
run AS (SELECT *, (SELECT sum(source_size) FROM wt) - coalesce(sum(cap) OVER b, 0) AS rest,
        (SELECT sum(w) FROM wt) - coalesce(sum(w) OVER b, 0) AS open_w
        FROM wt WINDOW b AS (ORDER BY source_size / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT CAST(rest AS BIGINT) AS rest, CAST(open_w AS BIGINT) AS open_w FROM run
        WHERE rest * w <= cap * open_w ORDER BY open_w DESC LIMIT 1),
goal AS (SELECT source, pos, source_size, CASE WHEN open_w > (SELECT open_w FROM lev) THEN CAST(cap AS DOUBLE)
         ELSE CAST((SELECT rest FROM lev) * w AS DOUBLE) / CAST((SELECT open_w FROM lev) AS DOUBLE) END AS target FROM run),
quot AS (SELECT source, pos, target / (2 * k + 1) AS q, k FROM goal,
         unnest(range(0, CAST(3 * ceil(source_size / {BLOCK}) AS BIGINT))) AS t(k)),
seat AS (SELECT source, pos, count(*) AS seats FROM
         (SELECT *, row_number() OVER (ORDER BY q DESC, pos, k) AS r FROM quot)
         WHERE r <= (SELECT round(sum(size) / {BLOCK}) FROM d) GROUP BY ALL),
sh AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS n FROM dd GROUP BY ALL),
so AS (SELECT sh.source, goal.pos, shard, n, coalesce(seats, 0) AS seats, source_size, target,
       sum(n) OVER (PARTITION BY goal.pos ORDER BY shard) - n AS off
       FROM sh JOIN goal ON sh.source IS NOT DISTINCT FROM goal.source LEFT JOIN seat ON seat.pos = goal.pos),
bl AS (SELECT *, ceil(off / {BLOCK}) AS b0, CAST(ceil((off + n) / {BLOCK}) - ceil(off / {BLOCK}) AS BIGINT) AS m FROM so),
sq AS (SELECT pos, shard, n / (2 * k + 1) AS q, k, seats FROM bl, unnest(range(0, CAST(3 * m AS BIGINT))) AS t(k)),
won AS (SELECT pos, shard, count(*) AS quota FROM
        (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY q DESC, shard, k) AS r FROM sq) WHERE r <= seats GROUP BY ALL),
blocks AS (SELECT bl.pos, bl.shard, CAST(b0 + i AS BIGINT) AS b, CAST(coalesce(quota, 0) // m AS BIGINT)
           + CAST((i * {STEP} + {TURN}) % CAST(m AS BIGINT) < coalesce(quota, 0) % m AS BIGINT) AS passes
           FROM bl LEFT JOIN won USING (pos, shard), unnest(range(0, CAST(m AS BIGINT))) AS t(i)),
dp AS (SELECT dd.doc_id, dd.size, so.pos, so.source_size, so.target,
       CAST(so.off + sum(dd.size) OVER (PARTITION BY so.pos, so.shard ORDER BY digest, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e
       FROM dd JOIN so ON dd.source IS NOT DISTINCT FROM so.source AND dd.shard = so.shard),
hit AS (SELECT doc_id, pos, e, unnest(range((e - size) // {BLOCK}, (e - 1) // {BLOCK} + 1)) AS b FROM dp WHERE size > 0),
got AS (SELECT hit.doc_id, hit.pos, hit.e, sum(passes * (least(hit.e, (hit.b + 1) * {BLOCK}) - greatest(hit.e - dp.size, hit.b * {BLOCK}))) AS taken
        FROM hit JOIN blocks USING (pos, b) JOIN dp ON dp.doc_id = hit.doc_id AND dp.pos = hit.pos AND dp.e = hit.e GROUP BY ALL)
SELECT dp.doc_id, CAST(dp.size AS BIGINT) AS size, dp.source_size, dp.target, CAST(coalesce(got.taken, 0) AS BIGINT) AS taken
FROM dp LEFT JOIN got ON dp.doc_id = got.doc_id AND dp.pos = got.pos AND dp.e = got.e AND dp.size > 0
"""
