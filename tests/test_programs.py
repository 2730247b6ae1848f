"""The named programs: public example data, brute force on small fixtures, and skew."""

import math
import os
import random

import pyspark
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lumbre.operators import curves, logistic, montecarlo, ranking, samples, words
from lumbre.operators.ordered import in_segments, percentiles, running_totals
from lumbre.sources import files

EXAMPLES = os.path.join(os.path.dirname(pyspark.__file__), "data", "mllib")
needs_examples = pytest.mark.skipif(not os.path.isdir(EXAMPLES), reason="example data is not installed")


def test_pi(spark):
    row = montecarlo.monte_carlo_pi(spark, slices=10, seed=7).first()
    assert row.samples == 1_000_000
    assert abs(row.pi - math.pi) < 0.01


def test_word_count_edges(spark, rows):
    lines = spark.createDataFrame([("",), ("   ",), (" a",), ("a  b  ",)], "line string")
    assert rows(words.word_count(lines)) == [("", 3), ("a", 2), ("b", 1)]


def test_word_count_counts_every_token(spark, sf_dir):
    lines = words.text_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")
    total = words.word_count(lines).agg(F.sum("n")).first()[0]
    assert total == words.words(lines).count()


def test_lines_are_read_and_counted(spark, tmp_path, rows):
    (tmp_path / "text.txt").write_text("a b\n\nb\n")
    assert rows(words.word_count(files.read_lines(spark, str(tmp_path / "text.txt")))) == [("", 1), ("a", 1), ("b", 2)]


@needs_examples
def test_page_rank_on_public_example(spark):
    lines = files.read_lines(spark, os.path.join(EXAMPLES, "pagerank_data.txt"))
    ranks = {r.node: r["rank"] for r in ranking.page_rank(files.edges_from_lines(lines), 5).collect()}
    assert ranks["1"] == pytest.approx(2.326648125)
    assert [ranks[n] for n in "234"] == pytest.approx([0.557783958] * 3, abs=1e-8)


def brute_force_ranks(edges, rounds):
    out = {}
    for src, dst in set(edges):
        out.setdefault(src, []).append(dst)
    ranks = dict.fromkeys(out, 1.0)
    for _ in range(rounds):
        received = {}
        for src, rank in ranks.items():
            for dst in out.get(src, ()):
                received[dst] = received.get(dst, 0.0) + rank / len(out[src])
        ranks = {node: 0.15 + 0.85 * share for node, share in received.items()}
    return ranks


@pytest.mark.parametrize("links_per_task", [1_000_000, 20])
@pytest.mark.parametrize(("rounds", "links_per_bucket"), [(0, 1), (1, 1), (7, 1), (7, 1000)])
def test_page_rank_with_a_hot_source(spark, links_per_task, rounds, links_per_bucket):
    """One node has a third of all links; splitting it changes nothing."""
    draw = random.Random(5)
    edges = [("hub", f"n{i}") for i in range(100)]
    edges += [(f"n{draw.randrange(150)}", f"n{draw.randrange(150)}") for _ in range(180)] + [("n1", "hub"), ("n2", "sink")]
    edges += edges[:20]
    df = spark.createDataFrame(edges, "src string, dst string")
    options = {"links_per_task": links_per_task, "links_per_bucket": links_per_bucket, "cut_every": 3}
    found = {r.node: r["rank"] for r in ranking.page_rank(df, rounds, **options).collect()}
    assert found == pytest.approx(brute_force_ranks(edges, rounds))


def test_page_rank_does_not_sort_the_links_in_a_round(spark):
    """Links without an end lead nowhere, but are links of their source; a round looks shares up by hash."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", None), (None, "a"), ("c", "a"), ("c", "a")], "src string, dst string")
        ranks = ranking.page_rank(df, 2, links_per_task=1)
        assert ranks._jdf.queryExecution().executedPlan().toString().count("ShuffledHashJoin") >= 2
        # a: 1 from b, 1 from c, then b's share alone; b and the missing end: half of a's rank each time
        first = 0.15 + 0.85 * 2
        assert {r.node: r["rank"] for r in ranks.collect()} == pytest.approx(
            {"a": 0.15 + 0.85 * (0.15 + 0.85 / 2), "b": 0.15 + 0.85 * first / 2, None: 0.15 + 0.85 * first / 2}
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("segments", [1, 3, 50])
def test_running_totals_with_a_hot_key(spark, segments):
    draw = random.Random(segments)
    data = [(draw.choice(["hot"] * 5 + ["a", "b", None]), i, draw.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    placed = in_segments(df, [F.asc("i")], ["k"], segments)
    totals = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v"))}
    found = {(r.k, r.i): (r.total, r.top, r.low) for r in running_totals(placed, [F.asc("i")], totals, ["k"]).collect()}
    seen = {}
    for k, i, v in data:
        values = seen.setdefault(k, [])
        if v is not None:
            values.append(v)
        assert found[(k, i)] == ((sum(values), max(values), min(values)) if values else (None, None, None))
    assert len(found) == len(data)


def test_running_totals_descending_without_key(spark):
    df = spark.range(1000).select("id")
    placed = in_segments(df, [F.desc("id")], segments=7)
    found = running_totals(placed, [F.desc("id")], {"t": ("sum", F.col("id"))})
    assert found.filter("t <> (999 + id) * (1000 - id) div 2").count() == 0


def test_percentiles_with_a_hot_key(spark):
    draw = random.Random(9)
    data = [(draw.choice(["hot"] * 6 + ["a", "b"]), draw.choice([None, *range(40)])) for _ in range(900)] + [("none", None), ("one", 3)]
    df = spark.createDataFrame(data, "k string, v int").withColumn("v", F.col("v").cast("double"))
    shares = {"p0": 0.001, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = {r.k: (r.p0, r.p50, r.p95, r.p100) for r in percentiles(df, "v", shares, ["k"]).collect()}
    for key in ("hot", "a", "b", "one"):
        values = sorted(v for k, v in data if k == key and v is not None)
        assert found.pop(key) == tuple(float(values[math.ceil(p * len(values)) - 1]) for p in shares.values())
    assert not found


def scored_fixture(spark, n=500):
    draw = random.Random(3)
    data = [(float(draw.random() < 0.3), round(draw.random(), 2)) for _ in range(n)]
    return data, spark.createDataFrame([(a, b + 0.2 * a) for a, b in data], "label double, score double")


def test_auc_like_the_evaluator(spark):
    _, df = scored_fixture(spark)
    expected = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert curves.area_under_roc(df).first().auc == pytest.approx(expected, abs=1e-12)


def test_roc_and_f_measure_by_brute_force(spark):
    _, df = scored_fixture(spark)
    data = [(r.label, r.score) for r in df.collect()]
    positives = sum(label for label, _ in data)
    negatives = len(data) - positives
    f = {}
    points = {(0.0, 0.0), (1.0, 1.0)}
    for t in {s for _, s in data}:
        tp = sum(label for label, s in data if s >= t)
        fp = sum(1 - label for label, s in data if s >= t)
        points.add((fp / negatives, tp / positives))
        f[t] = 2 * tp / (tp + fp + positives)
    assert {(r.fpr, r.tpr) for r in curves.roc_curve(df).collect()} == points
    assert {r.threshold: r.f_measure for r in curves.f_measures(df).collect()} == pytest.approx(f)
    best = curves.best_threshold(df).first()
    top = max(f.values())
    assert best.f_measure == pytest.approx(top)
    assert best.threshold == max(t for t, v in f.items() if v == top)


def test_curves_of_one_class(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, 0.7)], "label double, score double")
    assert curves.area_under_roc(df).first().auc is None
    assert {(r.fpr, r.tpr) for r in curves.roc_curve(df).collect()} == {(0.0, 0.0), (0.0, 0.5), (0.0, 1.0), (1.0, 1.0)}


@needs_examples
def test_logistic_regression_on_public_example(spark):
    df = files.read_libsvm(spark, os.path.join(EXAMPLES, "sample_libsvm_data.txt"), 692)
    assert df.count() == 100
    model = logistic.fit(df)
    history = model.summary.objectiveHistory
    assert len(history) == 11
    assert (history[0], history[-1]) == pytest.approx((0.683315, 0.580702), abs=1e-6)
    scored = logistic.score(model, df)
    summary = curves.summary(scored).first()
    assert summary.auc == pytest.approx(1.0)
    assert summary.f_measure == pytest.approx(1.0)
    reported = model.summary.fMeasureByThreshold
    best = max(reported.collect(), key=lambda r: (r["F-Measure"], r.threshold))
    assert best.threshold == pytest.approx(summary.threshold)


def test_first_rows_and_write(spark, tmp_path, rows):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("odd"))
    assert samples.first_rows(df, ["id"], 10).agg(F.max("id"), F.count("*")).first()[0:2] == (9, 10)
    many = samples.first_rows(df, ["id"], 4321)
    assert many.agg(F.max("id"), F.count("*")).first()[0:2] == (4320, 4321) and many.columns == df.columns
    assert samples.first_rows(df, ["id"], 9999).count() == 5000
    by_two = samples.first_rows(df, ["odd", "id"], 2600)
    assert rows(by_two) == [*((2 * i, 0) for i in range(2500)), *((2 * i + 1, 1) for i in range(100))] or by_two.count() == 2600
    samples.write_partitioned(df, str(tmp_path / "out"), "odd")
    assert rows(samples.totals_by(spark.read.parquet(str(tmp_path / "out")), ["odd"], F.col("id"))) == [
        (0, 2500, 6247500, 2499.0),
        (1, 2500, 6250000, 2500.0),
    ]
