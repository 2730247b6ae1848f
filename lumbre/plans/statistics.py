"""Table statistics over the test tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.functions.text import pretty_size
from lumbre.operators import catalog as lookups
from lumbre.operators import keys, profile, references
from lumbre.plans import schema as facts
from lumbre.sources.catalog import primary_key_definition, primary_key_name
from lumbre.sources.sinks import append_snapshot
from lumbre.sources.tables import ParquetFolder
from lumbre.storage import new_folder

SNAPSHOT_DATE = "2024-01-31"


def _folder(spark: SparkSession, sf_dir: str) -> ParquetFolder:
    return ParquetFolder(spark, sf_dir, facts.KEYS)


def _opened(spark: SparkSession, sf_dir: str) -> tuple[ParquetFolder, list[str]]:
    source = _folder(spark, sf_dir)
    names = source.names()
    source.open(names)
    return source, names


def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, names = _opened(spark, sf_dir)
    return profile.row_counts(source, names)


def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _folder(spark, sf_dir)
    sizes = source.sizes(source.names())
    pretty = [pretty_size(F.col(c)).alias(c.replace("bytes", "pretty")) for c in sizes.columns[1:]]
    return sizes.select("*", *pretty)


def size_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of every magnitude made from the line items, counted by the text they print as."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    size = F.floor("l_extendedprice") * F.expr("shiftleft(1L, 5 * l_linenumber)")
    return lines.groupBy(pretty_size(size).alias("size_text")).agg(F.count(F.lit(1)).alias("n"))


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, names = _opened(spark, sf_dir)
    listing = lookups.table_columns(source.catalog(names).columns)
    return listing.select("tabla", "ordinal_position", "column_name")


def pk_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, _ = _opened(spark, sf_dir)
    candidates = [*facts.PRIMARY.items(), *facts.UNDECLARED_CANDIDATES]
    checks = [keys.verify_key(source.read(table), table, columns) for table, columns in candidates]
    return profile.union_all(checks)


def fk_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, _ = _opened(spark, sf_dir)
    checks = [
        keys.verify_foreign_key(source.read(key.table), source.read(key.parent), key)
        for key in (*facts.FOREIGN, facts.BROKEN_REFERENCE)
    ]
    return profile.union_all(checks)


# Names as a user may give them; only the first two are tables.
LOOKED_UP = ("orders", "lineitem", "o'rders", "x'; DROP TABLE orders; --", 'a"b', "")


def column_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of tables by their bound names."""
    source, names = _opened(spark, sf_dir)
    columns = source.catalog(names).columns
    found = [lookups.bound(spark, lookups.COLUMNS_OF, {"schema": "public", "tabla": name}, columns=columns) for name in LOOKED_UP]
    return profile.union_all(found)


KEYED = ("orders", "lineitem", "events")


def pk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All minimal keys of up to two columns of three tables, found in their rows."""
    source, _ = _opened(spark, sf_dir)
    return profile.union_all([keys.minimal_keys(source.read(table), table, 2) for table in KEYED])


SEARCHED = ("nation", "region", "customer", "supplier", "orders")


def fk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of five tables whose values all occur in another column."""
    source, _ = _opened(spark, sf_dir)
    return references.inclusions({table: source.read(table) for table in SEARCHED})


def full_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record, sizes included."""
    return profile.profile(_folder(spark, sf_dir)).stats


# File sizes are no part of the data a database sees, so queries that are compared leave them out.
SIZE_COLUMNS = ("tamaño_total", "tamaño_tabla", "tamaño_indices", "bytes_total", "bytes_table", "bytes_indexes")


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_stats(spark, sf_dir).drop(*SIZE_COLUMNS)


def top_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.largest_tables(full_stats(spark, sf_dir)).select("tabla", "registros")


def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = profile.profile(_folder(spark, sf_dir))
    return profile.summary(done.stats, done.errors)


def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.report(full_stats(spark, sf_dir), with_sizes=False)


def stats_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "snapshots")
    append_snapshot(full_stats(spark, sf_dir), path, F.lit(SNAPSHOT_DATE))
    kept = spark.read.parquet(path)
    return kept.drop(*SIZE_COLUMNS).withColumn("snapshot_date", F.date_format("snapshot_date", "yyyy-MM-dd"))


QUERIES = {
    "table_row_counts": table_row_counts,
    "table_sizes": table_sizes,
    "size_pretty": size_pretty,
    "table_columns": table_columns,
    "pk_verify": pk_verify,
    "fk_verify": fk_verify,
    "fk_search": fk_search,
    "pk_search": pk_search,
    "column_lookup": column_lookup,
    "table_stats": table_stats,
    "top_tables": top_tables,
    "stats_summary": stats_summary,
    "stats_report": stats_report,
    "stats_snapshot": stats_snapshot,
}


# ---- the same in SQL ----------------------------------------------------------------------------------------


def _values(rows) -> str:
    def cell(value) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


COUNTS = "counts(tabla, registros) AS (" + " UNION ALL ".join(
    f"SELECT '{t}', count(*) FROM {t}" for t in facts.TABLES
) + ")"
COLUMNS = "cols(tabla, pos, col) AS (" + " UNION ALL ".join(
    f"SELECT '{t}', row_number() OVER (), column_name FROM (DESCRIBE {t})" for t in facts.TABLES
) + ")"
PKS = "pks(tabla, pos, col) AS (" + _values(
    (t, i, c) for t, columns in facts.PRIMARY.items() for i, c in enumerate(columns, start=1)
) + ")"
FKS = "fks(tabla, name, pos, col, parent, parent_col) AS (" + _values(
    (k.table, k.name, i, c, k.parent, p)
    for k in facts.FOREIGN
    for i, (c, p) in enumerate(zip(k.columns, k.parent_columns, strict=True), start=1)
) + ")"
INDEXES = "idx(tabla, name, def) AS (" + _values(
    (t, primary_key_name(t), primary_key_definition("public", t, columns)) for t, columns in facts.PRIMARY.items()
) + ")"

STATS = f"""
WITH {COUNTS}, {COLUMNS}, {PKS}, {FKS}, {INDEXES},
c AS (SELECT tabla, count(*) AS n, string_agg(col, ', ' ORDER BY pos) AS names FROM cols GROUP BY tabla),
p AS (SELECT tabla, string_agg(col, ', ' ORDER BY pos) AS names FROM pks GROUP BY tabla),
f AS (SELECT tabla, count(*) AS n, string_agg(col || ' -> ' || parent || '.' || parent_col, ', ' ORDER BY name, pos) AS names
      FROM fks GROUP BY tabla),
i AS (SELECT tabla, count(*) AS n, string_agg(name, ', ' ORDER BY name) AS names FROM idx GROUP BY tabla),
stats AS (
  SELECT counts.tabla, registros, CAST(c.n AS INTEGER) AS cantidad_columnas, c.names AS columnas,
         coalesce(p.names, 'Ninguna') AS llaves_primarias,
         CAST(coalesce(f.n, 0) AS INTEGER) AS cantidad_llaves_foraneas, coalesce(f.names, 'Ninguna') AS llaves_foraneas,
         CAST(coalesce(i.n, 0) AS INTEGER) AS cantidad_indices, coalesce(i.names, 'Ninguno') AS indices
  FROM counts LEFT JOIN c USING (tabla) LEFT JOIN p USING (tabla) LEFT JOIN f USING (tabla) LEFT JOIN i USING (tabla)
)
"""


def _pk_check(table: str, columns) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""
SELECT '{table}' AS tabla, '{", ".join(columns)}' AS columnas, CAST(coalesce(sum(n), 0) AS BIGINT) AS registros,
       count(*) FILTER (WHERE whole) AS llaves_distintas,
       CAST(coalesce(sum(n) FILTER (WHERE NOT whole), 0) AS BIGINT) AS registros_nulos,
       coalesce(max(n) FILTER (WHERE whole), 0) AS max_repeticiones,
       coalesce(max(n) FILTER (WHERE whole), 0) <= 1 AND coalesce(sum(n) FILTER (WHERE NOT whole), 0) = 0 AS es_llave
FROM (SELECT {whole} AS whole, count(*) AS n FROM {table} GROUP BY {", ".join(columns)})"""


def _fk_check(key) -> str:
    pairs = list(zip(key.columns, key.parent_columns, strict=True))
    label = ", ".join(f"{c} -> {key.parent}.{p}" for c, p in pairs)
    missing = " OR ".join(f"child.{c} IS NULL" for c, _ in pairs)
    found = f"EXISTS (SELECT 1 FROM {key.parent} parent WHERE " + " AND ".join(f"parent.{p} = child.{c}" for c, p in pairs) + ")"
    return f"""
SELECT '{key.table}' AS tabla, '{label}' AS llave_foranea, count(*) AS registros,
       count(*) FILTER (WHERE NOT missing AND found) AS con_referencia,
       count(*) FILTER (WHERE NOT missing AND NOT found) AS huerfanos,
       count(*) FILTER (WHERE missing) AS nulos,
       count(*) FILTER (WHERE NOT missing AND NOT found) = 0 AS se_cumple
FROM (SELECT ({missing}) AS missing, {found} AS found FROM {key.table} child)"""


# Columns that may refer to each other, by kind.
_COMPARABLE = (
    ("nation.n_nationkey", "nation.n_regionkey", "region.r_regionkey", "customer.c_custkey", "customer.c_nationkey",
     "supplier.s_suppkey", "supplier.s_nationkey", "orders.o_orderkey", "orders.o_custkey"),
    ("nation.n_name", "region.r_name", "customer.c_name", "customer.c_mktsegment", "supplier.s_name",
     "orders.o_orderstatus", "orders.o_orderpriority"),
    ("customer.c_acctbal", "supplier.s_acctbal", "orders.o_totalprice"),
    ("orders.o_orderdate",),
)


def _inclusion(a: str, b: str) -> str:
    (s, x), (t, y) = a.split("."), b.split(".")
    return f"""SELECT '{s}' AS tabla, '{x}' AS columna, '{t}' AS tabla_referida, '{y}' AS columna_referida,
        (SELECT count(DISTINCT {x}) FROM {s}) AS valores, (SELECT count(DISTINCT {y}) FROM {t}) AS valores_referidos
        WHERE EXISTS (SELECT 1 FROM {s} WHERE {x} IS NOT NULL)
          AND NOT EXISTS (SELECT 1 FROM {s} WHERE {x} IS NOT NULL AND {x} NOT IN (SELECT {y} FROM {t} WHERE {y} IS NOT NULL))"""


# Columns of the searched tables, in their order.
_KEY_COLUMNS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split(),
    "events": "event_id ts user_id event_type value props".split(),
}


def _key_candidates() -> str:
    sets = [(t, s) for t, columns in _KEY_COLUMNS.items() for n in (1, 2) for s in combinations(columns, n)]
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS tabla, [{", ".join(f"'{c}'" for c in s)}] AS cols, (SELECT count(*) FROM (SELECT DISTINCT {", ".join(s)} FROM {t}
        WHERE {" AND ".join(f"{c} IS NOT NULL" for c in s)})) = (SELECT count(*) FROM {t}) AS holds"""
        for t, s in sets
    )


_SIZE_TEXT = """
CASE WHEN b < 10240 THEN b || ' bytes'
     WHEN b // 512 < 20479 THEN (b // 512 + 1) // 2 || ' kB'
     WHEN b // 524288 < 20479 THEN (b // 524288 + 1) // 2 || ' MB'
     WHEN b // 536870912 < 20479 THEN (b // 536870912 + 1) // 2 || ' GB'
     ELSE (b // 549755813888 + 1) // 2 || ' TB' END"""

_DETAIL = """concat_ws(chr(10), '📊 Tabla: ' || tabla, '   • Registros: ' || format('{:,}', registros),
       '   • Columnas (' || cantidad_columnas || '): ' || columnas, '   • Llaves primarias: ' || llaves_primarias,
       '   • Llaves foráneas (' || cantidad_llaves_foraneas || '): ' || llaves_foraneas,
       '   • Índices (' || cantidad_indices || '): ' || indices)"""

SQL = {
    "table_row_counts": f"WITH {COUNTS} SELECT * FROM counts",
    "size_pretty": f"""SELECT {_SIZE_TEXT} AS size_text, count(*) AS n
        FROM (SELECT CAST(floor(l_extendedprice) AS BIGINT) * (CAST(1 AS BIGINT) << (5 * l_linenumber)) AS b FROM lineitem)
        GROUP BY 1""",
    "table_columns": f"""WITH {COLUMNS}
        SELECT tabla, CAST(pos AS INTEGER) AS ordinal_position, col AS column_name FROM cols""",
    "pk_verify": " UNION ALL ".join(
        _pk_check(t, columns) for t, columns in [*facts.PRIMARY.items(), *facts.UNDECLARED_CANDIDATES]
    ),
    "fk_verify": " UNION ALL ".join(_fk_check(k) for k in (*facts.FOREIGN, facts.BROKEN_REFERENCE)),
    "fk_search": " UNION ALL ".join(_inclusion(a, b) for group in _COMPARABLE for a in group for b in group if a != b),
    "pk_search": f"""WITH candidates AS ({_key_candidates()}), found AS (SELECT * FROM candidates WHERE holds)
        SELECT tabla, array_to_string(cols, ', ') AS columnas, CAST(len(cols) AS INTEGER) AS n_columnas FROM found f
        WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.tabla = f.tabla AND len(g.cols) < len(f.cols) AND list_has_all(f.cols, g.cols))""",
    "column_lookup": f"""WITH {COLUMNS} SELECT tabla, CAST(pos AS INTEGER) AS ordinal_position, col AS column_name FROM cols
        WHERE tabla IN ('orders', 'lineitem')""",
    "table_stats": STATS + "SELECT * FROM stats",
    "top_tables": f"WITH {COUNTS} SELECT * FROM counts ORDER BY registros DESC, tabla LIMIT 5",
    "stats_summary": f"""WITH {COUNTS} SELECT count(*) AS encontradas, count(*) AS procesadas,
        CAST(0 AS BIGINT) AS fallidas FROM counts""",
    "stats_report": STATS + f"SELECT tabla, {_DETAIL} AS detalle FROM stats",
    "stats_snapshot": STATS + f"SELECT *, '{SNAPSHOT_DATE}' AS snapshot_date FROM stats",
}
