import zlib

import pytest
from pyspark.sql import functions as F

from conftest import document
from lumbre.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def judged(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels, T.toxicity(docs, labels).toPandas()


def test_held_out_accuracy(judged):
    docs, labels, found = judged
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (found.predicted == (found.score >= 0.5)).all()
    both = found[found.held_out].merge(labels.toPandas(), on="doc_id")
    ranks, toxic = both.score.rank(), both.toxic == 1
    area = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.9
    assert both.predicted[toxic].mean() > 0.6 and both.predicted[~toxic].mean() < 0.02


def test_held_out_labels_are_not_read(judged):
    docs, labels, found = judged
    other = labels.withColumn("toxic", F.when(T.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.toxicity(docs, other).toPandas()
    assert found.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()


def test_texts_with_insults_are_found(judged, spark, table):
    docs, labels, _ = judged
    model = T.train(docs, labels)
    clean = "This is a text about the garden and the weather of the last week, nothing more. " * 5
    planted = table([document(1, clean), document(2, clean + "You are a stupid worthless idiot. " * 3), document(3, None), document(4, "")])
    score = {r["doc_id"]: r["predicted"] for r in T.scored(planted, model).collect()}
    assert score == {1: 0, 2: 1, 3: 0, 4: 0}


def test_learned_words(table, spark):
    rows = [(i, float(i % 4 == 0), f"common word{i} " + ("grumblefish snarkolate" if i % 4 == 0 else "garden")) for i in range(200)]
    words = T.learned_words(spark.createDataFrame(rows, "_id long, _label double, _text string"))
    assert set(words) == {"grumblefish", "snarkolate", "grumb-", "snark-"}
    assert T.learned_words(spark.createDataFrame([], "_id long, _label double, _text string")) == ()


@pytest.mark.parametrize("text,hidden", [("you 1d1ot here", 1), ("an id*ot", 1), ("i d i o t", 1), ("idiooot", 1), ("r2d2 4you a1", 0), ("id*ots", 0), ("st*p*d, m0r0n!", 2), ("x" * 50 + "1" + "y" * 50, 0)])
def test_hidden_insults(text, hidden):
    of = T.Describer()
    lower = text.lower()
    assert of.hidden(lower)[1] + of.stretched(T.Counter(T.WORD.findall(lower)))[1] == hidden


def test_nearness():
    of = T.Describer()
    assert of.nearness("a you b c idiot".split()) == 1 / 3 and of.nearness("idiot x y you clown".split()) == 1
    assert of.nearness("idiot".split()) == 0 == of.nearness("you".split())


def test_odd_rows(odd, judged, spark):
    _, labels, _ = judged
    model = T.train(judged[0], labels)
    rows = T.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert T.scored(odd.limit(0), model).collect() == []


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(1, 0, None), (None, 1, 1)], 0.0), ([(1, 0, 1), (1, 0, 0), (3, 0, 1), (2, 0, 1), (4, 0, 1)], 1.0)])
def test_without_labels_of_both_kinds(odd, spark, labels, score):
    found = T.toxicity(odd, spark.createDataFrame(labels, LABELS)).collect()
    assert {r["score"] for r in found} == {score} and len(found) == odd.count()
