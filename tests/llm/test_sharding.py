import re
import zlib

import pytest

from conftest import ODD, document
from lumbre.llm import sharding as S


def loads(rows):
    bytes_of = {}
    for r in rows:
        bytes_of[r["shard"]] = bytes_of.get(r["shard"], 0) + r["size"]
    return bytes_of


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_groups_whole(table, shards):
    rows = [document(i, f"word {i % 700} " * (1 + i % 9), "en" if i % 3 else "de", f"src{i % 5}") for i in range(2000)]
    placed = S.shard(table(rows), shards=shards).collect()
    bytes_of = loads(placed)
    assert len(placed) == 2000 and sorted(bytes_of) == list(range(shards))
    assert max(bytes_of.values()) < 1.05 * min(bytes_of.values())
    shard_of, texts = {}, {i: t for i, t, *_ in rows}
    for r in placed:
        assert shard_of.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]].encode()))
    for shard in range(shards):
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in placed)))


def test_a_third_of_all_rows_in_one_group(table):
    rows = [document(i, "the same text again" if i % 3 == 0 else f"another text {i}") for i in range(1500)]
    bytes_of = loads(S.shard(table(rows), shards=4).collect())
    hot = 500 * 20
    rest = sorted(bytes_of.values())
    assert sum(rest) == hot + sum(len(f"another text {i}") + 1 for i in range(1500) if i % 3)
    assert max(rest) <= hot * 1.05  # the group cannot be divided, and takes a shard of its own


def test_target_bytes(table):
    rows = [document(i, f"text {i:05d}") for i in range(1000)]  # 11 bytes each
    bytes_of = loads(S.shard(table(rows), target_bytes=2000).collect())
    assert len(bytes_of) == 6 and max(bytes_of.values()) <= 2000


def test_odd_rows(odd):
    placed = S.shard(odd, shards=4).collect()
    assert len(placed) == len(ODD) and {r["shard"] for r in placed} <= set(range(4))
    assert sorted(r["size"] for r in placed) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ODD)


def test_empty_table(table):
    assert S.shard(table([]), shards=8).collect() == []


def test_no_python_in_the_plan(odd):
    assert not re.search("Python|Pandas|Arrow", S.shard(odd, shards=2)._jdf.queryExecution().executedPlan().toString())
