import random

import public_tokenizers
import pytest
import tiktoken

from lumbre.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return B.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = list("ab \n\t\x1c\x85'sSéllved019.,!?-_ñ中\U0001f600") + ["　", " ", "́", "the", "<|endoftext|>", "   ", "'ll"]


@pytest.mark.parametrize("stretch", [7, 1 << 20])
def test_same_as_the_library(ranks, library, monkeypatch, stretch):
    monkeypatch.setattr(B, "STRETCH", stretch)
    pairs, rng = B.BytePairs(ranks, public_tokenizers.PATTERN), random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40)))
        assert pairs.encode(text).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 3000, "!?" * 2000, " " * 5000 + "x", "Zufallswörter" * 300])
def test_long_pieces(ranks, library, text):
    assert B.BytePairs(ranks, public_tokenizers.PATTERN).encode(text).tolist() == library.encode_ordinary(text)


def test_backtracking_with_a_small_vocabulary():
    """Longest matches alone would go wrong here: every text over two letters against the merges one by one."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bb": 257, b"aab": 258, b"bba": 259, b"abbb": 260, b"abab": 261}
    pairs = B.BytePairs(ranks, public_tokenizers.PATTERN)
    for size in range(1, 12):
        for number in range(2**size):
            piece = bytes(97 + (number >> i & 1) for i in range(size))
            want = [piece] if piece in ranks else pairs.merged(piece)
            assert pairs.tokens(piece) == want


@pytest.mark.parametrize("seed", range(30))
def test_pairs_go_together_as_the_merges_say(seed):
    """Random vocabularies made by merges, and some with tokens that no merge reaches: seams against merges one by one."""
    rng = random.Random(seed)
    tokens = [bytes([97 + i]) for i in range(3)]
    while len(tokens) < 25:
        new = rng.choice(tokens) + rng.choice(tokens)
        if new not in tokens and len(new) < 9:
            tokens.append(new)
    if seed % 3 == 0:
        tokens[3:] = rng.sample(tokens[3:], len(tokens) - 3)
    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(tokens[3:])}
    pairs = B.BytePairs(ranks, public_tokenizers.PATTERN)
    for a in tokens:
        for b in tokens:
            if pairs.merged(a) == [a] and pairs.merged(b) == [b]:
                assert pairs.together[a, b] == (pairs.merged(a + b) == [a, b]), (a, b)


def test_decoding(ranks):
    pairs = B.BytePairs(ranks, public_tokenizers.PATTERN)
    ids = B.np.array(random.Random(1).choices(range(50256), k=2000), B.np.int32)
    tokens = {n: t for t, n in ranks.items()}
    assert pairs.decode(ids) == b"".join(tokens[i] for i in ids.tolist()) and pairs.decode(ids[:0]) == b""


def test_rows_and_round_trip(odd, library):
    rows = B.decode(B.encode(odd, PATH, public_tokenizers.PATTERN), PATH).collect()
    texts = sorted((r["text"] or "") for r in odd.select("text").collect())
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == texts
    assert all(library.encode_ordinary(bytes(r["decoded"]).decode()) == r["ids"] for r in rows)
    at_once = B.encode(odd, PATH, public_tokenizers.PATTERN, back="decoded").collect()
    assert sorted((r["ids"], r["decoded"]) for r in at_once) == sorted((r["ids"], r["decoded"]) for r in rows)
    assert B.encode(odd.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
