"""Chat formatting: collapse logged snapshots of growing conversations, then render.

A chat service often logs a conversation after every turn, so one conversation lies in the
log many times, each a prefix of a longer one. Each turn gets a rolling hash of all turns up
to it: the running exclusive-or of a 128-bit digest of (turn number, role, text), kept as two
64-bit halves by a window per conversation. Conversations equal in every turn become one row; a conversation whose
whole hash is the prefix hash of a longer one is dropped by an anti-join; the rest, the
maximal conversations, are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxyscope.llm.common import read, stage

# The marks of the rendered form.
TURN_START, TURN_END, DEFAULT_ROLE = "<|im_start|>", "<|im_end|>", "user"


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct turns, numbered from 1 in order of (turn, role, text), with rolling hashes."""
    t = conversations.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit(DEFAULT_ROLE)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull()).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("position", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, salt in (("high", 1), ("low", 2)):
        t = t.withColumn(name, F.bit_xor(F.xxhash64(F.lit(salt), "position", F.xxhash64(F.lit(salt), "role"), F.xxhash64(F.lit(salt), "text"))).over(upto))
    return t


def collapse(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id (the smallest of equal ones), n_turns,
    copies (conversations equal to it), snapshots (distinct shorter ones it takes in).

    Rows without conv_id are left out, repeated rows count once, a null role is "user" and
    a null text is empty; turns of equal number are ordered by role, then text. A
    conversation that is a prefix of several longer ones counts as a snapshot of each.
    """
    return _collapse(turns_of(conversations))


def _collapse(t: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("high", "low"), "position")
    whole = t.groupBy("conv_id").agg(F.max("position").alias("n_turns"), last.alias("h"))
    whole = whole.groupBy("h.high", "h.low", "n_turns").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")
    )
    # A prefix hash with the length of its longest conversation: a first turn that a third
    # of all conversations share is one row here, summed up before the shuffle.
    heads = t.select("conv_id", "high", "low", F.col("position").alias("n_turns"))
    ends = whole.select("conv_id", F.col("n_turns").alias("full"))
    longer = heads.join(ends, "conv_id").where(F.col("n_turns") < F.col("full"))
    prefixes = longer.select("high", "low", "n_turns").distinct()
    maximal = whole.join(prefixes, ["high", "low", "n_turns"], "left_anti").select("conv_id", "n_turns", "copies")
    # Only prefixes that are whole conversations are looked for, each one row; the heads of
    # all conversations are the other side, a plain shuffle that Spark may split at a common turn.
    wholes = stage(whole.join(prefixes, ["high", "low", "n_turns"], "left_semi").select("high", "low", "n_turns"))
    taken = stage(longer).join(wholes, ["high", "low", "n_turns"])
    snapshots = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("snapshots"))
    return maximal.join(snapshots, "conv_id", "left").withColumn("snapshots", F.coalesce("snapshots", F.lit(0).cast("long")))


def render(conversations: DataFrame) -> DataFrame:
    """``collapse`` plus ``rendered``: the turns of each maximal conversation, in order."""
    turns = stage(turns_of(conversations))
    keep = _collapse(turns)
    turn = F.concat(F.lit(TURN_START), "role", F.lit("\n"), "text", F.lit(TURN_END + "\n"))
    t = turns.select("conv_id", "position", turn.alias("turn_text"))
    kept = t.join(keep.select("conv_id"), "conv_id", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("position", "turn_text")))
    texts = kept.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["turn_text"]), "").alias("rendered"))
    return keep.join(texts, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "copies", "snapshots", "rendered")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered; see ``collapse`` for nulls, repeats and ties."""
    return render(read(spark, sf_dir, "conversations"))


OP4_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '{DEFAULT_ROLE}') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_turns,
      list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, turns, count(*) AS copies FROM c GROUP BY n_turns, turns),
p AS (SELECT a.conv_id AS short, b.conv_id AS long FROM u a JOIN u b
      ON b.n_turns > a.n_turns AND b.turns[1] = a.turns[1] AND b.turns[1:a.n_turns] = a.turns)
SELECT u.conv_id, u.n_turns, u.copies,
       (SELECT count(*) FROM p WHERE p.long = u.conv_id) AS snapshots,
       array_to_string(list_transform(u.turns, lambda x: '{TURN_START}' || x.role || chr(10) || x.text || '{TURN_END}' || chr(10)), '') AS rendered
FROM u WHERE u.conv_id NOT IN (SELECT short FROM p)
"""
