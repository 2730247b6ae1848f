import re

import pytest
from pyspark.sql import functions as F

from conftest import ODD, document
from lumbre.llm import exact_dedup as E


def expected(rows):
    """``{(id, text): (keep, size)}``; null ids come first."""
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    order = lambda i: (i is not None, i or 0)
    return sorted(((i, max(ids, key=order), len(ids)) for ids in groups.values() for i in ids), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("digest", [E.sha256, lambda text: F.lit("same"), lambda text: F.length(text).cast("string")])
def test_odd_rows_with_any_digest(odd, digest):
    """With digests that collide, the bytes still decide."""
    decided = E.deduplicate(odd, digest).cache()
    assert found(decided) == expected(ODD)
    assert decided.filter("kept").count() == len({t or "" for _, t, *_ in ODD})  # also of repeated rows exactly one stays


def test_several_batches_give_the_same(spark, table, monkeypatch):
    rows = [document(i, f"text {i % 37}") for i in range(400)]
    docs = table(rows, files=6)
    assert found(E.deduplicate(docs, batch_files=1)) == expected(rows)


def test_state_goes_on_without_expiry(spark, table, tmp_path):
    """A later run of the stream knows what an earlier one has seen, and only new arrivals are read."""
    place, state = str(tmp_path / "log"), str(tmp_path / "state")
    session = E.stream_session(spark)
    for turn in range(3):
        docs = table([document(10 * turn + i, f"text {i}") for i in range(5)])
        E.arrivals(docs).write.mode("append").parquet(place)
        E.remember(session.readStream.schema(spark.read.parquet(place).schema).parquet(place), state)
        seen = E.remembered(session, state).collect()
        assert len(seen) == 5 and {r["_size"] for r in seen} == {turn + 1}
        assert {r["_last"]["_id"] // 10 for r in seen} == {turn}


def test_locator_leads_to_the_kept_content(spark, table):
    docs = table([document(i, f"text {i % 3}") for i in range(9)])
    decided = E.deduplicate(docs)
    here = docs.select("text", *E.place())
    joined = decided.join(here, (F.col("keep_file") == F.col("_file")) & (F.col("keep_row") == F.col("_row")))
    assert joined.filter(E.sha256(F.col("text")) != F.col("digest")).count() == 0 and joined.count() == 9


def test_empty_table(table):
    assert E.deduplicate(table([])).collect() == []


def test_no_python_in_the_plan(odd):
    plan = E.deduplicate(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
