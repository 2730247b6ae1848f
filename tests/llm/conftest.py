import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark, tmp_path):
    """A file-based table of documents (or of another schema) from rows."""

    made = []

    def build(rows, schema=DOCS, files=2):
        path = str(tmp_path / f"t{len(made)}")
        made.append(path)
        frame = spark.createDataFrame(rows, schema)
        frame.repartition(files).write.parquet(path) if rows else frame.write.parquet(path)
        return spark.read.parquet(path)

    return build


def document(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text))


#: Nulls in any column, empty and very long texts, repeated rows and ties.
ODD = [
    document(1, None),
    document(2, ""),
    document(3, "one two three"),
    document(3, "one two three"),
    document(None, "one two three"),
    (4, "words " * 40_000, None, None, None),
    document(5, " \n\n \t"),
    document(6, "Ünï çødé \U0001f600 text\x00with\x1codd\x85signs"),
    document(7, "x" * 100_000),
    document(2, None),
]


@pytest.fixture
def odd(table):
    """The odd rows, with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return table(ODD).withColumns({n: F.lit("clash") for n in ("ids", "digest", "_id", "_row", "node", "shard", "kept", "secrets", "_counts")})
