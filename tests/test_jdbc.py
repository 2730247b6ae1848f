"""What is asked of a PostgreSQL source.  No database is started; a recording reader stands in for the connection."""

import pytest

from lumbre.operators import profile
from lumbre.sources import jdbc
from lumbre.sources.catalog import DeclaredKeys, ForeignKey, declared_catalog
from lumbre.sources.frames import small_frame
from lumbre.sources.tables import SIZES


class Recorder:
    """Stands for ``spark.read``: keeps the options and answers with a prepared frame."""

    def __init__(self, answers=None):
        self.asked, self.answers = [], answers or (lambda options: None)

    def format(self, name):
        self.current = {"format": name}
        return self

    def options(self, **options):
        self.current.update(options)
        return self

    def option(self, key, value):
        return self.options(**{key: value})

    def load(self):
        self.asked.append(self.current)
        return self.answers(self.current)


class Session:
    def __init__(self, spark, answers=None):
        self.spark, self.read = spark, Recorder(answers)

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_table_in_ranges(spark):
    session = Session(spark)
    jdbc.read_table(session, {"url": "jdbc:x", "user": "u"}, '"public"."T"', ("id", 1, 1000, 4))
    assert session.read.asked == [
        {
            "format": "jdbc",
            "url": "jdbc:x",
            "user": "u",
            "dbtable": '"public"."T"',
            "partitionColumn": "id",
            "lowerBound": "1",
            "upperBound": "1000",
            "numPartitions": "4",
        }
    ]


def test_names_are_quoted():
    assert jdbc.quoted('odd "name"') == '"odd ""name"""'
    assert jdbc.literal("it's") == "'it''s'"


@pytest.fixture()
def database(spark):
    """A schema with two tables, one of which cannot be counted."""
    schemas = {"Good": spark.range(1).schema, "bad": spark.range(1).schema}
    keys = DeclaredKeys({"Good": ("id",)}, (ForeignKey("Good", ("id",), "bad", ("id",)),))
    catalog = declared_catalog(spark, schemas, keys)
    by_query = {sql: getattr(catalog, relation) for relation, sql in jdbc.CATALOG_QUERIES.items()}

    def answer(options):
        sql = options["query"]
        if sql in by_query:
            return by_query[sql]
        if "information_schema.tables" in sql:
            return small_frame(spark, "table_name string", [("bad",), ("Good",)])
        if "pg_total_relation_size" in sql:
            return small_frame(spark, SIZES, [("Good", 8192, 16384, 24576)])
        if '"Good"' in sql:
            return small_frame(spark, "registros long", [(42,)])
        raise RuntimeError("permission denied")

    return Session(spark, answer)


def test_profile_of_a_database(database):
    source = jdbc.JdbcDatabase(database, {"url": "jdbc:x"})
    done = profile.profile(source)
    row = done.stats.first()
    assert (row.tabla, row.registros, row.tamaño_total, row.tamaño_tabla, row.tamaño_indices) == (
        "Good",
        42,
        "24 kB",
        "8192 bytes",
        "16 kB",
    )
    assert (row.llaves_primarias, row.llaves_foraneas, row.indices) == ("id", "id -> bad.id", "Good_pkey")
    assert [tuple(r) for r in done.errors.collect()] == [("bad", "permission denied")]
    assert done.stats.count() == 1
    sent = [asked["query"] for asked in database.read.asked]
    # counts and sizes are worked out at the source, the catalog is read once for all tables
    assert 'SELECT COUNT(*) AS registros FROM "public"."Good"' in sent
    assert len(sent) == 1 + 2 + 1 + len(jdbc.CATALOG_QUERIES)


def test_no_credentials_in_the_package():
    import pathlib

    root = pathlib.Path(jdbc.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if "password=" in p.read_text().replace(" ", "")]
