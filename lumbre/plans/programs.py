"""The named programs over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.functions.text import json_at
from lumbre.operators import curves, logistic, montecarlo, ranking, samples, words
from lumbre.sources import files
from lumbre.storage import cut_lineage, new_folder

ITERATIONS = 5
# Multipliers that spread keys over the 32-bit range, for points that are the same everywhere.
SPREAD_X = 2654435761
SPREAD_Y = 1597334677
RANGE = 4294967296


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.text_lines(table(spark, sf_dir, "documents"), "text", "doc_id")


def monte_carlo_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per line item, placed by its keys."""

    def spread(a: str, b: str, by_a: int, by_b: int) -> Column:
        mixed = F.col(a).cast("long") % 1073741824 * by_a + F.col(b).cast("long") % 1073741824 * by_b
        return mixed % RANGE / RANGE * 2 - 1

    lines = table(spark, sf_dir, "lineitem")
    x = spread("l_orderkey", "l_linenumber", SPREAD_X, SPREAD_Y)
    y = spread("l_partkey", "l_suppkey", SPREAD_Y, SPREAD_X)
    return montecarlo.pi_from_points(lines, x, y)


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_count(document_lines(spark, sf_dir))


def purchase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst``: who bought what, in both directions."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey")
    pairs = lines.join(orders, "k").select(
        F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst")
    )
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.select(F.inline(both))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = ranking.page_rank(purchase_graph(spark, sf_dir), ITERATIONS)
    return ranks.select("node", F.round("rank", 6).alias("rank"))


def row_limited_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = samples.first_rows(table(spark, sf_dir, "orders"), ["o_orderkey"])
    kept = first.filter("o_totalprice > 0").withColumn("size", F.when(F.col("o_totalprice") < 250000, "small").otherwise("large"))
    return samples.totals_by(kept, ["o_orderstatus", "size"], F.col("o_totalprice"))


def etl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "orders-by-year")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("order_year")
    )
    samples.write_partitioned(orders, path, "order_year")
    return samples.totals_by(spark.read.parquet(path), ["order_year", "o_orderstatus"], F.col("o_totalprice"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, score``: is a document of good quality, and how long is it."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.join(documents, "doc_id").select("label", "score")


def binary_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.area_under_roc(scored_labels(spark, sf_dir))


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.roc_curve(scored_labels(spark, sf_dir))


def f_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.f_measures(scored_labels(spark, sf_dir))


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.best_threshold(scored_labels(spark, sf_dir))


FEATURES = ("log_chars", "word_count", "distinct_ratio")


def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label`` and the features; texts are reduced to numbers before anything is shuffled."""
    word_list = F.split("text", r"\s+")
    documents = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars", word_list.alias("w"))
        .select(
            "doc_id",
            F.log1p("n_chars").alias("log_chars"),
            F.size("w").cast("double").alias("word_count"),
            (F.size(F.array_distinct("w")) / F.size("w")).alias("distinct_ratio"),
        )
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return labels.join(documents, "doc_id")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label, features``."""
    return logistic.with_features(feature_columns(spark, sf_dir), FEATURES).select("doc_id", "label", "features")


def line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of every line of the documents, taken as a link."""
    return files.edges_from_lines(document_lines(spark, sf_dir).select("line"))


def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_links(spark, sf_dir)


def pagerank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank over links that come as lines of text."""
    return ranking.page_rank(line_links(spark, sf_dir), 2).select("node", F.round("rank", 10).alias("rank"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a value that lies inside a JSON text, and by one that is never there."""
    events = table(spark, sf_dir, "events")
    inner = json_at(F.col("props"), "k", "none").alias("k")
    state = json_at(F.col("props"), "status.applicationState.state", "UNKNOWN").alias("state")
    return events.groupBy(inner, state).agg(F.count(F.lit(1)).alias("n"))


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the regression is fitted to, one column per feature."""
    values = feature_columns(spark, sf_dir)
    return values.select("doc_id", "label", *(F.round(f, 9).alias(f) for f in FEATURES))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = cut_lineage(labelled_documents(spark, sf_dir))  # every iteration reads it
    return logistic.score(logistic.fit(labelled), labelled)


def logreg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_documents(spark, sf_dir)
    return scored.select("doc_id", "label", F.round("score", 6).alias("score"), "prediction")


def logreg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve and best threshold of the fitted model on its training rows."""
    return curves.summary(scored_documents(spark, sf_dir))


QUERIES = {
    "monte_carlo_pi": monte_carlo_pi,
    "word_count": word_count,
    "pagerank": pagerank,
    "row_limited_summary": row_limited_summary,
    "etl_roundtrip": etl_roundtrip,
    "edge_list": edge_list,
    "pagerank_lines": pagerank_lines,
    "event_props": event_props,
    "labelled_features": labelled_features,
    "logreg_scores": logreg_scores,
    "logreg_summary": logreg_summary,
    "binary_auc": binary_auc,
    "roc_curve": roc_curve,
    "f_measure": f_measure,
    "best_threshold": best_threshold,
}


# ---- the same in SQL ----------------------------------------------------------------------------------------


def _spread_sql(a: str, b: str, by_a: int, by_b: int) -> str:
    mixed = f"CAST({a} AS BIGINT) % 1073741824 * {by_a} + CAST({b} AS BIGINT) % 1073741824 * {by_b}"
    return f"CAST(({mixed}) % {RANGE} AS DOUBLE) / {RANGE} * 2 - 1"


WORDS = """
lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
tokens AS (
  SELECT unnest(CASE WHEN line = '' THEN [''] WHEN rtrim(line, ' ') = '' THEN CAST([] AS VARCHAR[])
                     ELSE string_split(rtrim(line, ' '), ' ') END) AS word FROM lines
)"""

WORD_COUNT = f"WITH {WORDS} SELECT word, count(*) AS n FROM tokens GROUP BY word"


BOUGHT = (
    "pairs AS (SELECT DISTINCT 'C' || o_custkey AS c, 'P' || l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey)",
    "links AS (SELECT c AS src, p AS dst FROM pairs UNION SELECT p, c FROM pairs)",
)
LINE_LINKS = (
    "fields AS (SELECT string_split_regex(unnest(string_split(text, chr(10))), '[ \\t\\n\\x0B\\f\\r]+') AS f FROM documents)",
    "links AS (SELECT DISTINCT f[1] AS src, f[2] AS dst FROM fields WHERE f[2] <> '')",
)


def _pagerank_sql(rounds: int, links: tuple[str, ...] = BOUGHT, places: int = 6) -> str:
    steps = [
        *links,
        "nodes AS (SELECT src, count(*) AS n FROM links GROUP BY src)",
        "r0 AS (SELECT src AS node, CAST(1 AS DOUBLE) AS rank FROM nodes)",
    ]
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS (SELECT dst AS node, CAST(0.15 AS DOUBLE) + CAST(0.85 AS DOUBLE) * sum(rank / n) AS rank "
            f"FROM links JOIN nodes USING (src) JOIN r{i - 1} ON node = src GROUP BY dst)"
        )
    return "WITH " + ",\n".join(steps) + f" SELECT node, round(rank, {places}) AS rank FROM r{rounds}"


CURVE = """
WITH scored AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)),
grouped AS (SELECT score, count(*) FILTER (WHERE label > 0.5) AS p, count(*) FILTER (WHERE label <= 0.5) AS n
            FROM scored GROUP BY score),
curve AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n
          FROM grouped WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT score AS threshold, CAST(2 * tp AS DOUBLE) / CAST(tp + fp + all_p AS DOUBLE) AS f_measure FROM curve)
"""

_TOTALS = """count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS average"""

SQL = {
    "monte_carlo_pi": f"""WITH points AS (SELECT {_spread_sql("l_orderkey", "l_linenumber", SPREAD_X, SPREAD_Y)} AS x,
          {_spread_sql("l_partkey", "l_suppkey", SPREAD_Y, SPREAD_X)} AS y FROM lineitem)
        SELECT count(*) AS samples, count(*) FILTER (WHERE x * x + y * y <= 1) AS inside,
               CAST(4 AS DOUBLE) * count(*) FILTER (WHERE x * x + y * y <= 1) / count(*) AS pi FROM points""",
    "word_count": WORD_COUNT,
    "pagerank": _pagerank_sql(ITERATIONS),
    "edge_list": "WITH " + ", ".join(LINE_LINKS) + " SELECT src, dst FROM links",
    "pagerank_lines": _pagerank_sql(2, LINE_LINKS, 10),
    "event_props": """SELECT coalesce(json_extract_string(props, '$.k'), 'none') AS k,
        coalesce(json_extract_string(props, '$.status.applicationState.state'), 'UNKNOWN') AS state, count(*) AS n
        FROM events GROUP BY 1, 2""",
    "labelled_features": """WITH words AS (SELECT doc_id, n_chars, string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents)
        SELECT doc_id, CAST(quality AS DOUBLE) AS label, round(ln(1 + n_chars), 9) AS log_chars,
               CAST(len(w) AS DOUBLE) AS word_count, round(CAST(len(list_distinct(w)) AS DOUBLE) / len(w), 9) AS distinct_ratio
        FROM labels JOIN words USING (doc_id)""",
    "row_limited_summary": f"""SELECT o_orderstatus, CASE WHEN o_totalprice < 250000 THEN 'small' ELSE 'large' END AS size, {_TOTALS}
        FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT {samples.DEFAULT_ROWS}) WHERE o_totalprice > 0 GROUP BY 1, 2""",
    "etl_roundtrip": f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderstatus, {_TOTALS}
        FROM orders GROUP BY 1, 2""",
    "binary_auc": CURVE + """SELECT CAST(max(all_p) AS BIGINT) AS positives, CAST(max(all_n) AS BIGINT) AS negatives,
        sum(n * (tp - p / 2)) / (CAST(max(all_p) AS DOUBLE) * CAST(max(all_n) AS DOUBLE)) AS auc FROM curve""",
    "roc_curve": CURVE + """SELECT score AS threshold, CAST(fp AS DOUBLE) / all_n AS fpr, CAST(tp AS DOUBLE) / all_p AS tpr FROM curve
        UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT NULL, 1.0::DOUBLE, 1.0::DOUBLE""",
    "f_measure": CURVE + "SELECT threshold, f_measure FROM f",
    "best_threshold": CURVE + "SELECT threshold, f_measure FROM f ORDER BY f_measure DESC, threshold DESC LIMIT 1",
}
