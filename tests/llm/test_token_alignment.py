import hashlib
import random
from collections import Counter, deque

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from conftest import document
from lumbre.llm import token_alignment as T

FILES = tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


class Plain:
    """Brute force: the libraries on whole texts, all pairs of tokens compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(FILES[0])
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=FILES[1])
        letters = {v: k for k, v in T.byte_letters().items()}
        self.bytes_a = lambda i: bytes(letters[x] for x in self.a.id_to_token(i))

    def bytes_b(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(self, text):
        spaced = f" {text}".encode() if text else b""
        a = self.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = self.b.encode(text) if text else []
        same = b"".join(map(self.bytes_a, a)) == spaced == b"".join(map(self.bytes_b, b))
        return (a, b) if same else ([], [])

    def ranges(self, ids, bytes_of):
        at, found = 0, []
        for i in ids:
            found.append((at, at := at + len(bytes_of(i))))
        return found

    def aligned(self, text):
        a, b = self.tokens(text)
        in_a, in_b = self.ranges(a, self.bytes_a), self.ranges(b, self.bytes_b)
        links, near = [], 0
        for i, (start, end) in enumerate(in_a):
            while near < len(in_b) and in_b[near][1] <= start:
                near += 1
            j = near
            while j < len(in_b) and in_b[j][0] < end:
                links.append((i, j))
                j += 1
        groups, in_a, in_b = [], deque(in_a), deque(in_b)
        for end in sorted({e for _, e in in_a} & {e for _, e in in_b}):
            groups.append(([], []))
            for side, (ids, ranges) in enumerate(((a, in_a), (b, in_b))):
                while ranges and ranges[0][1] <= end:
                    groups[-1][side].append(str(ids[len(ids) - len(ranges)]))
                    ranges.popleft()
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in groups]
        return a, b, links, groups

    def statistics(self, texts):
        done = [self.aligned(t) for t in texts]
        counts = Counter((a[i], b[j]) for a, b, links, _ in done for i, j in links)
        best = {}
        for (_, y), n in counts.items():
            best[y] = max(best.get(y, 0), n)
        rows = []
        for a, b, links, groups in done:
            n = [counts[a[i], b[j]] for i, j in links]
            best_links = sum(counts[a[i], b[j]] == best[b[j]] for i, j in links)
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
            rows.append((len(a), len(b), len(groups), len(links), best_links, sum(n), digest))
        return rows


@pytest.fixture(scope="module")
def plain():
    return Plain()


def pair():
    contents = [open(f, "rb").read() for f in FILES]
    return T.Pair(*contents, public_tokenizers.PATTERN)


def found(docs):
    rows = T.link_statistics(docs, *FILES, public_tokenizers.PATTERN).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"]))]


SIGNS = list("ab \n\t\x1c\x00\x85'sSéllved019.,!?-_ñ中\U0001f600▁ßü…“") + ["　", "\xa0", "́", "the", "<|endoftext|>", "<s>", "<0x41>", "   ", "'ll", " The ", "tion"]


def test_tokens_as_by_the_libraries(plain):
    both, rng = pair(), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 40)))
        ids = both.tokens(f" {text}")
        assert ([], []) == plain.tokens(text) if ids is None else tuple(i.tolist() for i in ids) == plain.tokens(text)


def test_every_settled_character_as_by_the_libraries(plain):
    both = pair()
    signs = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if not both.doubtful.search(c)]
    assert len(signs) > 30_000
    for first in range(0, len(signs), 50):
        some = signs[first : first + 50]
        for text in ("".join(some), " a".join(some), " ".join(some)):
            assert not both.doubtful.search(text)
            assert tuple(i.tolist() for i in both.tokens(f" {text}")) == plain.tokens(text)


def test_documents_as_by_the_libraries(plain, spark, sf_dir):
    both = pair()
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        if row["text"]:
            assert tuple(i.tolist() for i in both.tokens(f" {row['text']}")) == plain.tokens(row["text"])


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "!?" * 2000, " " * 3000 + "x", "Zufallswörter" * 300, "línea\n" * 2000, " ", "x "])
def test_long_runs(plain, text):
    assert tuple(i.tolist() for i in pair().tokens(f" {text}")) == plain.tokens(text)


def test_statistics_of_odd_rows(odd, plain):
    given = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    want = plain.statistics([r["text"] for r in given])
    assert Counter(found(odd)) == Counter(want)
    assert found(odd.limit(0)) == []


def test_pieces_of_long_texts(table, plain, monkeypatch):
    """Chunks of a few characters give what one chunk gives."""
    rng = random.Random(3)
    words = ["the", "nation", "Ünïverse", "a.", "(b", "12345", "<s>", "x\ny", "", "…"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(40)] + ["not ▁ this", "the nation " * 50 + "▁"]
    monkeypatch.setattr(T, "AT_ONCE", 100)
    both = pair()
    records = list(T.Chunks(both).rows((i, i, f" {t}") for i, t in enumerate(texts)))
    by_row = {r["_row"]: r for r in records if "_row" in r}
    want = plain.statistics(texts)
    for i, w in enumerate(want):
        assert tuple(by_row[i][n] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == (*w[:4], w[6])
    chunks = [r for r in records if "chunk" in r]
    assert len({(c["chunk"], c["piece"]) for c in chunks}) == len(chunks) > 100
    assert sum(int(c["many"].sum()) for c in chunks) == sum(int(c["counts"].sum()) for c in chunks) == sum(w[3] for w in want)


def test_statistics_over_many_chunks(table, plain):
    rng = random.Random(8)
    words = ["the", "nation", "Über", "of", "these", "12345", "naïve", "tokens\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = table([document(i, t) for i, t in enumerate(texts)], files=7)
    assert found(docs) == plain.statistics(texts)


def test_real_outputs(odd, plain):
    rows = T.aligned(odd, *FILES, public_tokenizers.PATTERN).collect()
    want = [plain.aligned(r["text"]) for r in odd.select("text").collect()]
    got = [(list(r["ids_a"]), list(r["ids_b"]), [tuple(x) for x in r["links"]], r["groups"].split(";") if r["groups"] else []) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
