"""Document fingerprints: a homomorphic hash of a text's multiset of paragraphs.

A paragraph (a line, or a sentence of a longer line) is hashed with SHA-256 to a wide
vector: eight counters of 32 bits from the digest, and 64 counters of 0 or 1 from its first
64 bits. A text's fingerprint is the sum of its paragraphs' vectors, each counter modulo
2**32, and the number of paragraphs. Sums do not depend on order, equal texts have equal
sums, and a paragraph is inserted or deleted by adding or subtracting its vector
(``combine``). The 64 small counters, read as sums of +1 and -1, are a random projection of
the multiset: the cosine of two of them estimates how alike two texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxyscope.llm.common import ROW_KEY, numbered, read, stage, text_or_empty

WIDE = 8  # counters of 32 bits from the digest
SIGNS = 32  # packed pairs of 0/1 counters: 2 * SIGNS lanes
MODULUS = 1 << 32
PARAGRAPH_END = r"\n+|(?<=[.!?])[ \t]+"
ROWS_PER_RUN = 2048
QUANTILES = 256


def paragraphs(text: Column) -> Column:
    """Non-empty paragraphs of a text, without white space at their ends."""
    parts = F.transform(F.split(text, PARAGRAPH_END), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def vector_columns(paragraph: Column) -> list[Column]:
    """The sums that make up a fingerprint, over the rows of a group (one per paragraph;
    a null row, for a text without any, adds nothing)."""
    digest = F.sha2(paragraph.cast("binary"), 256)
    word = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(WIDE)]
    out = [F.count(paragraph).alias("units")]
    out += [F.coalesce(F.sum(w), F.lit(0).cast("long")).alias(f"w{i}") for i, w in enumerate(word)]
    for k in range(SIGNS):
        low = F.shiftright(word[0], k).bitwiseAND(F.lit(1).cast("long"))
        high = F.shiftright(word[1], k).bitwiseAND(F.lit(1).cast("long"))
        out.append(F.coalesce(F.sum(low + F.shiftleft(high, 32)), F.lit(0).cast("long")).alias(f"s{k}"))
    return out


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per row of ``texts`` (``keys`` tell rows apart): ``units``, ``wide`` (array of
    WIDE counters) and ``signs`` (array of 2 * SIGNS counters). Paragraph rows are summed in
    each task before they are shuffled."""
    rows = texts.select(*keys, F.explode_outer(paragraphs(F.col(text))).alias("paragraph"))
    digest = rows.groupBy(*keys).agg(*vector_columns(F.col("paragraph")))
    wide = F.array(*[F.pmod(F.col(f"w{i}"), F.lit(MODULUS)) for i in range(WIDE)])
    low = [F.col(f"s{k}").bitwiseAND(F.lit(MODULUS - 1)) for k in range(SIGNS)]
    high = [F.shiftrightunsigned(F.col(f"s{k}"), 32) for k in range(SIGNS)]
    return digest.select(*keys, "units", wide.alias("wide"), F.array(*low, *high).alias("signs"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Counters of a text after inserting (sign 1) or deleting (sign -1) paragraphs whose
    counters are ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(MODULUS)))


def as_text(units: Column, wide: Column, signs: Column) -> Column:
    """Lowercase text form: number of paragraphs, wide counters (hex), small counters."""
    hex8 = F.transform(wide, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    small = F.transform(signs, lambda x: x.cast("string"))
    return F.concat_ws(":", units.cast("string"), F.array_join(hex8, ""), F.array_join(small, ","))


def likeness(a_units: Column, a: Column, b_units: Column, b: Column) -> Column:
    """Cosine of two sign projections, 0 to 1; 1 for equal ones, 0 if one has no paragraph."""

    def centred(units: Column, signs: Column) -> Column:
        return F.transform(signs, lambda x: x * 2 - units)

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p * q)
        return F.aggregate(products, F.lit(0).cast("long"), lambda t, p: t + p).cast("double")

    x, y = centred(a_units, a), centred(b_units, b)
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    same = (a_units == b_units) & (a == b)
    cosine = F.when(size > 0, dot(x, y) / size).otherwise(F.lit(0.0))
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def run_of(docs: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> Column:
    """Number of the run of a row of ``docs`` (doc_id and ROW_KEY): ascending along descending
    doc_id with null last, and about ``rows_per_run`` rows each.

    Quantiles of doc_id (QUANTILES + 1 numbers on the driver) cut the ids into segments,
    and each is cut into runs of equal width, so outlying ids only widen the runs of their own
    segment. An id that is several quantiles at once holds many rows: it is a segment by
    itself, cut evenly by the hash of the row's place, as are the rows without id.
    """
    points = [i / QUANTILES for i in range(QUANTILES + 1)]
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.percentile_approx("doc_id", points).alias("at")).first()
    marks = seen["at"] or [0]
    edges = sorted(set(marks))
    each = max(1, seen["ids"] // QUANTILES)  # rows between neighbouring quantiles

    def bits(rows: int) -> int:
        return max(0, -(-rows // rows_per_run) - 1).bit_length()

    def by_place(bits: Column) -> Column:  # an even cut of a 64-bit hash, whose order is that of the hash
        return F.when(bits == 0, F.lit(0)).otherwise(F.call_function("shiftright", F.col(ROW_KEY[1]), (F.lit(64) - bits).cast("int"))).cast("long")

    ids = F.array(*[F.lit(e).cast("long") for e in edges])
    repeats = F.array(*[F.lit(bits(each * marks.count(e))) for e in edges])
    below = F.least(F.size(F.filter(ids, lambda e: e < F.col("doc_id"))), F.lit(len(edges) - 1))
    high, low = F.get(ids, below), F.coalesce(F.get(ids, below - 1), F.get(ids, below) - 1)
    share = (high.cast("double") - F.col("doc_id").cast("double")) / (high.cast("double") - low.cast("double"))
    pieces = -(-each // rows_per_run)
    within = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * pieces)
    segment = F.lit(-2) * below - F.when(F.col("doc_id") == high, F.lit(1)).otherwise(F.lit(0))
    piece = F.when(F.col("doc_id") == high, by_place(F.get(repeats, below))).otherwise(within)
    null_piece = by_place(F.lit(bits(seen["n"] - seen["ids"])))
    width = F.lit(1 << 40)
    return F.when(F.col("doc_id").isNull(), width + null_piece).otherwise(segment * width + piece)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``row`` (a key of the row) and ``next_text`` and
    ``next_row`` of the next row in order of descending doc_id, null last (rows under one id:
    of the hash of their place in the table); after the last comes the first.

    The order is cut into runs (``run_of``), so no task sees it whole: within a run the next
    row is a window function, and the last row of a run gets the first row of the following
    run by a join of one row per run. The following run is found among the runs of a segment,
    and for a segment's last among the segments, of which there are at most 2 * QUANTILES + 2.
    """
    rows = numbered(docs)
    rows = rows.select("doc_id", text_or_empty().alias("text"), F.col(ROW_KEY[1]).alias("spot"), run_of(rows).alias("run"))
    order = Window.partitionBy("run").orderBy(F.col("doc_id").desc_nulls_last(), "spot")
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    heads = stage(rows.where(F.col("place") == 1).select("run", "text"))
    runs = heads.select("run", F.round(F.col("run") / (1 << 40)).alias("segment"))
    inner = runs.withColumn("follow", F.lead("run").over(Window.partitionBy("segment").orderBy("run")))
    firsts = runs.groupBy("segment").agg(F.min("run").alias("first"))
    along = Window.orderBy("segment")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    then = F.coalesce(F.lead("first").over(along), F.first("first").over(whole))
    firsts = firsts.select(F.col("segment").alias("of"), then.alias("then"))
    follow = inner.join(firsts, F.col("segment") == F.col("of")).select(F.col("run").alias("of_run"), F.coalesce("follow", "then").alias("follow"))
    follow = follow.join(heads, F.col("follow") == F.col("run")).select("of_run", "follow", F.col("text").alias("follow_text"))
    rows = rows.join(follow, F.col("run") == F.col("of_run"))
    inside = F.col("next_text").isNotNull()
    next_row = F.when(inside, F.struct("run", (F.col("place") + 1).alias("place"))).otherwise(
        F.struct(F.col("follow").alias("run"), F.lit(1).alias("place"))
    )
    return rows.select(
        "doc_id", "text", F.struct("run", "place").alias("row"),
        F.coalesce("next_text", "follow_text").alias("next_text"), next_row.alias("next_row"),
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with likeness to that and to the
    next text (see ``op5_fingerprints``). Null text is empty; rows with equal or null doc_id
    follow each other by the hash of their place and each keep a row of their own; other columns are ignored."""
    rows = with_next(docs)
    n = F.char_length("text")
    half = F.shiftright(n, 1)
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("kind"), edited.alias("body")),
    )
    lines = rows.select("doc_id", "row", "next_row", n.cast("long").alias("n_chars"), F.inline(both))
    lines = lines.withColumn("sha", F.when(F.col("kind") == 1, F.sha2(F.col("body").cast("binary"), 256)))
    prints = fingerprints(lines, ["doc_id", "row", "next_row", "n_chars", "kind", "sha"], "body")
    value = F.struct("units", "wide", "signs")
    one = prints.groupBy("doc_id", "row", "next_row", "n_chars").agg(
        F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("kind") == 0, value)).alias("own"),
        F.max(F.when(F.col("kind") == 1, value)).alias("edited"),
    )
    one = stage(one)
    others = one.select(F.col("row").alias("next_row"), F.col("own").alias("next"))
    joined = one.join(others, "next_row")
    like = lambda a, b: likeness(F.col(f"{a}.units"), F.col(f"{a}.signs"), F.col(f"{b}.units"), F.col(f"{b}.signs"))
    form = lambda a: as_text(F.col(f"{a}.units"), F.col(f"{a}.wide"), F.col(f"{a}.signs"))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256",
        form("own").alias("fingerprint"), form("edited").alias("edited_fingerprint"),
        like("own", "edited").alias("near_edited"), like("own", "next").alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; see ``edited_fingerprints``."""
    return edited_fingerprints(read(spark, sf_dir, "documents"))


_W = ", ".join(f"CAST(coalesce(sum(w{i}), 0) AS BIGINT) AS w{i}" for i in range(WIDE))
_WORDS = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS w{i}" for i in range(WIDE))
_S = ", ".join(
    f"CAST(coalesce(sum((w{j} >> {k}) & 1), 0) AS BIGINT)" for j in (0, 1) for k in range(SIGNS)
)
_HEX = " || ".join(f"lpad(lower(to_hex(w{i} % {MODULUS})), 8, '0')" for i in range(WIDE))
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id,
      coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text
      FROM d WINDOW o AS (ORDER BY doc_id DESC)),
x AS (SELECT doc_id, next_id, length(text) AS n_chars, text,
      left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM e),
b AS (SELECT doc_id, 0 AS kind, text AS body FROM x UNION ALL SELECT doc_id, 1, edited FROM x),
-- a sentence ends at white space after . ! or ?: that white space becomes a line break first
p AS (SELECT doc_id, kind, trim(unnest(string_split(regexp_replace(body, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))), ' ') AS u FROM b),
h AS (SELECT doc_id, kind, sha256(u) AS h FROM p WHERE u <> ''),
w AS (SELECT doc_id, kind, {_WORDS} FROM h),
v AS (SELECT doc_id, kind, count(*) AS units, {_W}, [{_S}] AS signs FROM w GROUP BY doc_id, kind),
f AS (SELECT b.doc_id, b.kind, coalesce(units, 0) AS units, coalesce(signs, list_transform(range({2 * SIGNS}), lambda x: CAST(0 AS BIGINT))) AS signs,
      CAST(coalesce(units, 0) AS VARCHAR) || ':' || coalesce({_HEX}, repeat('0', {8 * WIDE})) || ':' ||
      coalesce(array_to_string(signs, ','), array_to_string(list_transform(range({2 * SIGNS}), lambda x: 0), ',')) AS form
      FROM b LEFT JOIN v USING (doc_id, kind)),
c AS (SELECT *, list_transform(signs, lambda x: x * 2 - units) AS z FROM f),
l AS (SELECT x.doc_id, n_chars, sha256(edited) AS edited_sha256, a.form AS fingerprint, m.form AS edited_fingerprint,
      a.units AS au, a.z AS az, m.units AS mu, m.z AS mz, n.units AS nu, n.z AS nz
      FROM x JOIN c a ON a.doc_id = x.doc_id AND a.kind = 0 JOIN c m ON m.doc_id = x.doc_id AND m.kind = 1
      JOIN c n ON n.doc_id = x.next_id AND n.kind = 0),
q AS (SELECT *, CAST(list_sum(list_transform(list_zip(az, mz), lambda t: t[1] * t[2])) AS DOUBLE) AS am,
      CAST(list_sum(list_transform(list_zip(az, nz), lambda t: t[1] * t[2])) AS DOUBLE) AS an,
      sqrt(CAST(list_sum(list_transform(az, lambda t: t * t)) AS DOUBLE)) AS na,
      sqrt(CAST(list_sum(list_transform(mz, lambda t: t * t)) AS DOUBLE)) AS nm,
      sqrt(CAST(list_sum(list_transform(nz, lambda t: t * t)) AS DOUBLE)) AS nn FROM l)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN au = mu AND az = mz THEN 1.0 WHEN na * nm > 0 THEN greatest(0.0, least(1.0, am / (na * nm))) ELSE 0.0 END::DOUBLE AS near_edited,
  CASE WHEN au = nu AND az = nz THEN 1.0 WHEN na * nn > 0 THEN greatest(0.0, least(1.0, an / (na * nn))) ELSE 0.0 END::DOUBLE AS near_next
FROM q
"""
