import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns whose names the operators use inside.
CLASHES = ["size", "target", "taken", "node", "bucket", "chunk", "row", "kind", "words", "spans", "start", "end",
           "place", "gone", "twice", "n", "run", "next_text", "component", "label_of", "held", "parts", "key"]

PROSE = "The river rises in the hills and runs past nine towns before it meets the sea at last. "
OTHER = "Bakers start early; their ovens need two hours, and bread cannot wait for anyone at all. "
GERMAN = "Der Fluss entspringt in den Hügeln und fließt an neun Städten vorbei, ehe er das Meer erreicht. "


def long_text() -> str:
    return " ".join(f"w{i * 7919 % 100_003}" for i in range(40_000))


def awkward_rows():
    base = [
        (1, PROSE * 3, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t \r\x0b\x0c", "en", None),
        (5, long_text(), "en", "b"), (6, PROSE * 3, "en", None), (6, PROSE * 3, "en", None), (7, "short", None, "c"),
        (8, GERMAN * 2, "de", "c"), (9, "12 34 !!", "de", "a"), (None, OTHER * 2, "en", "b"), (None, None, None, None),
        (10, PROSE * 3 + "One more line.", "en", "a"), (11, "x\n" * 30, "en", "d"), (12, "\U0001f642 é́   z", "fr", "d"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in base]


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(awkward_rows(), DOCUMENTS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def plain(spark):
    """The documents of the smallest driver tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
