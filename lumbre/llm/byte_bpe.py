"""Byte-level byte-pair encoding by ranks, in time linear in the text, and its inverse.

A sequence of tokens is what the merges would give exactly if every token is its own encoding and every two neighbours
are the encoding of their joined bytes.  So a piece is encoded from left to right by longest matches: an Aho-Corasick automaton
over the vocabulary (bytes mapped to Latin-1, one character each) finds all matches in one pass, and where the next token
does not go with the one before it, a shorter one is tried, or the one before is taken back.  Places from which no way
leads on are marked and never tried again, hence linear time.  Whether two tokens go together is decided along their seam and remembered: taking
back the merges of both from the latest one on, no pair of parts that met at the seam may merge before the next of them was made.

Null texts count as empty and give no ids.  Repeated rows give repeated results, an empty table gives no rows.  Texts of any length are cut where white space begins, which never
separates what the splitting pattern keeps together, so memory does not grow with more than the ids themselves.
"""

import base64
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lumbre.llm.workers import Memory, held

#: Bytes of remembered words and of remembered pairs of tokens per worker.
REMEMBERED, PAIRS = 256 << 20, 96 << 20
#: Longer words are not remembered.
LONGEST = 64
#: Rows whose results are held at once.
PART = 200
#: Characters looked at in one go.
STRETCH = 1 << 20
#: Ids decoded in one go.
AT_ONCE = 1 << 19

# Unicode's White_Space characters, which the splitting pattern calls \s.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts a text into words with at most one space before them, and white space; each is split further by itself.
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64-of-the-bytes rank``."""
    ranks = {}
    for line in content.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class BytePairs:
    """The encoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            self.automaton.add_word(token.decode("latin-1"), token)
        self.automaton.make_automaton()
        self.together = Memory(self._together, PAIRS)
        self.words = Memory(self._word, REMEMBERED, LONGEST)
        self.shorter: dict[bytes, bytes | None] = {}  # of tokens, as many as the vocabulary has
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        size = max(ranks.values(), default=-1) + 1
        table = [b""] * size
        for token, rank in ranks.items():
            table[rank] = token
        self.vocabulary = np.frombuffer(b"".join(table), np.uint8)
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def merged(self, piece: bytes) -> list[bytes]:
        """The merges carried out one by one, lowest rank first: quadratic, for short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            pairs = [self.ranks.get(a + b, len(self.ranks)) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(pairs)
            if best == len(self.ranks):
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def last_merge(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that a token is merged from; nothing if it never is, or not by merges of rising rank."""
        if token not in self.parts:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                pairs = [self.ranks.get(a + b, len(self.ranks)) for a, b in zip(parts, parts[1:], strict=False)]
                at = min(range(len(pairs)), key=pairs.__getitem__)
                if pairs[at] >= self.ranks[token]:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            regular = len(parts) == 2 and all(len(p) == 1 or (self.ranks[p] < self.ranks[token] and self.last_merge(p)) for p in parts)
            self.parts[token] = (parts[0], parts[1]) if regular else None
        return self.parts[token]

    def _together(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether the joined bytes are merged to just these two tokens."""
        left, right = pair
        if any(len(t) > 1 and self.last_merge(t) is None for t in pair):
            return self.merged(left + right) == [left, right]
        ranks, before, ever = self.ranks, len(self.ranks), len(self.ranks)
        while True:
            # The parts at the seam meet until a merge of rank ``before`` (on the right side: or of the same rank) takes one of them away.
            if ranks.get(left + right, ever) < before:
                return False
            of_left, of_right = (ranks[t] if len(t) > 1 else -1 for t in (left, right))
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                before, left = of_left, self.parts[left][1]
            else:
                before, right = of_right + 1, self.parts[right][0]

    def _shorter(self, token: bytes) -> bytes | None:
        """The longest proper beginning that is a token."""
        if token not in self.shorter:
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)
        return self.shorter[token]

    def tokens(self, piece: bytes) -> list[bytes]:
        """The exact encoding of one piece."""
        if not piece or piece in self.ranks:
            return [piece] if piece else []
        together, shorter, letters = self.together, self._shorter, piece.decode("latin-1")
        matches = self.automaton.iter_long
        done = [token for _, token in matches(letters)]
        if all(map(together.__getitem__, zip(done, done[1:], strict=False))):
            return done  # the longest matches one after the other go together, as in most words
        longest, end = {}, 0
        for token in done:
            longest[end] = token
            end += len(token)
        size = len(piece)
        dead = bytearray(size + 1)  # places at which no encoding of the whole piece has a boundary
        done = []
        at, before, token = 0, None, longest[0]
        while True:
            end = at + len(token)
            if not dead[end] and (before is None or together[before, token]):
                done.append(token)
                if end == size:
                    return done
                at, before, token = end, token, longest.get(end)
                if token is None:
                    token = longest[end] = next(matches(letters, end))[1]
                continue
            token = shorter(token)
            while token is None:
                dead[at] = 1
                token = done.pop()
                at -= len(token)
                before = done[-1] if done else None
                token = shorter(token)

    def _word(self, word: str) -> bytes:
        """The packed ids of a word or of white space, whose pieces are words too."""
        pieces = self.split.findall(word)
        if len(pieces) != 1:
            return b"".join([self.words[p] for p in pieces])
        ranks, piece = self.ranks, word.encode("utf-8")
        return array("i", [ranks[t] for t in self.tokens(piece)]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as 32-bit integers."""
        packed, start = [], 0
        while start < len(text):
            cut = CUT.search(text, start + STRETCH) if len(text) - start > STRETCH else None
            end = cut.start() if cut else len(text)
            packed.append(b"".join(map(self.words.__getitem__, CHUNK.findall(text[start:end]))))
            start = end
        return np.frombuffer(b"".join(packed), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the joined vocabulary."""
        parts = []
        for first in range(0, len(ids), AT_ONCE):
            some = ids[first : first + AT_ONCE]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            places = np.repeat(self.starts[some] - ends + lengths, lengths)
            places += np.arange(len(places))
            parts.append(self.vocabulary[places].tobytes())
        return b"".join(parts)


def encoder(content: bytes, pattern: str) -> BytePairs:
    return BytePairs(read_ranks(content), pattern)


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that a worker holds the results of no more."""
    for batch in batches:
        for start in range(0, batch.num_rows, PART):
            yield batch.slice(start, PART)


def _vocabulary(docs: DataFrame, path: str):
    """The vocabulary file, read once and sent to the executors; its size does not depend on the data."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def listed(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", back: str | None = None) -> DataFrame:
    """``key, ids``: the ids of each whole text by the rank file at ``path``, pieces cut by ``pattern``.

    ``back`` names a further column, the bytes that the ids give when they are decoded again, without another way through Python.
    No special tokens: their strings are ordinary text.  One row per input row; other columns are not read.
    """
    content = _vocabulary(docs, path)

    def ids(batches):
        pairs = held(encoder, content.value, pattern)
        for part in in_parts(batches):
            rows = [pairs.encode(t or "") for t in part.column(1).to_pylist()]
            columns = [part.column(0), listed(rows)]
            if back:
                columns.append(pa.array([pairs.decode(r) for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    given = docs.select(F.col(key), F.col(text))
    fields = [given.schema[0], StructField("ids", ArrayType(IntegerType())), *([StructField(back, BinaryType())] if back else [])]
    names = [f.name for f in fields]
    return given.mapInArrow(ids, StructType(fields))


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of ``ids`` as a binary column; null ids give no bytes."""
    content = _vocabulary(encoded, path)

    def back(batches):
        pairs = held(encoder, content.value, r"\s+|\S+")
        for part in in_parts(batches):
            column = part.column(ids)
            rows = [np.array([] if r is None else r.values, np.int32) for r in column]
            decoded = pa.array([pairs.decode(r) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, into])

    schema = StructType([*encoded.schema.fields, StructField(into, BinaryType())])
    return encoded.mapInArrow(back, schema)
