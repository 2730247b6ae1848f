import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import ODD, document
from lumbre.llm import packing as P
from lumbre.llm.ranks import ranked

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_ids_are_those_of_the_library(library):
    with open(PATH, "rb") as file:
        words = P.Words(file.read())
    rng = random.Random(3)
    signs = list("abİΣÀÿß¼²ªº'REs \n\t\x1c\x85téll've019.,!?-_ñ中\U0001f600") + ["　", " ", "́", "<|endoftext|>", "'ll"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(words.packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [0]


def test_plain_words_are_merged_together_and_not_remembered(library):
    with open(PATH, "rb") as file:
        words = P.Words(file.read())
    rng = random.Random(4)
    plain = ["".join(rng.choice("abdelmorstvABéÀ'.,7-") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    odd = ["中文", "x\x1cy", "don\u2019t"]
    long = ["ab" * 1500, "." * 1200 + "c", "q7'" * 900]
    for text in (" ".join(plain), "\n".join([*plain[:50], odd[0], *plain[50:90], odd[1], odd[2], "end"]), "  ".join([plain[0], *long, plain[1]]), "", " \t"):
        assert np.frombuffer(words.packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [0]
    assert set(words.words) == set(odd)


def test_merges_are_told_by_their_results():
    """Of the symbols of every token, the merges before its own leave just the two that its own joins: so whatever makes its bytes makes it."""
    with open(PATH, "rb") as file:
        model = json.load(file)["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {pair: rank for rank, pair in enumerate(pairs)}
    assert len({a + b for a, b in pairs}) == len(pairs)
    for pair in pairs:
        token = "".join(pair)
        end = "</w>" * token.endswith("</w>")
        parts = list(token.removesuffix("</w>"))
        parts[-1] += end
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), len(ranks)))
            assert (parts[at], parts[at + 1]) in ranks
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert tuple(parts) == pair


def one_by_one(lengths, capacity):
    """Best fit, longest first, piece by piece."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return rooms


@pytest.mark.parametrize("seed", range(30))
def test_plan_over_counts_is_best_fit_over_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.randint(5, 40)
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
    used, seen = Counter(), []
    counts = Counter(lengths)
    rows = P.plan(counts, capacity)
    for at, (length, rank, per, first, offset) in enumerate(rows):
        end = rows[at + 1][1] if at + 1 < len(rows) and rows[at + 1][0] == length else counts[length]
        for i in range(end - rank):
            used[first + i // per] += length
            seen.append((first + i // per, offset + i % per * length, length))
    assert Counter(length for _, _, length in seen) == counts
    assert sorted(capacity - u for u in used.values()) == sorted(one_by_one(lengths, capacity))
    for sequence in used:
        at = 0
        for offset, length in sorted((o, n) for s, o, n in seen if s == sequence):
            assert offset == at
            at += length
        assert at <= capacity


def test_pieces_and_slots(odd, library):
    cut = P.pieces(P.token_ids(odd, PATH))
    rows = P.pack(cut).collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in ODD]
    want = Counter((zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes()), s, len(x[s : s + 2048])) for x in ids for s in range(0, len(x), 2048))
    assert Counter((zlib.crc32(bytes(r["ids"])), r["start"], r["length"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for taken in places.values():
        taken.sort()
        assert [o for o, _ in taken] == [sum(n for _, n in taken[:i]) for i in range(len(taken))]
        assert sum(n for _, n in taken) <= 2048


def test_many_documents_of_one_length(table):
    rows = P.pack(P.pieces(P.token_ids(table([document(i, "a b c") for i in range(1000)], files=5), PATH)).drop("ids")).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 1000 and len({r["sequence_id"] for r in rows}) == 2


def test_empty_table(table):
    assert P.pack(P.pieces(P.token_ids(table([]), PATH))).collect() == []


def test_ranks_within_a_hot_key(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 > 0, F.lit(None)).otherwise("b").alias("k"))
    found = ranked(rows, ["k"], [F.desc("id")], "rank").collect()
    for key in ("hot", "b", None):
        ids = sorted((r["id"] for r in rows.collect() if r["k"] == key), reverse=True)
        assert {r["id"]: r["rank"] for r in found if r["k"] == key} == {i: n for n, i in enumerate(ids)}
