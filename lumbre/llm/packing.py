"""Best-fit packing of token sequences, planned on the histogram of lengths.

How full the sequences get depends only on how many pieces there are of each length.  So the plan is made over counts:
lengths in falling order, each put where it leaves the least room, whole groups of equal sequences at a time.  The
histogram has at most ``capacity`` rows and the plan some rows per length, whatever the number of documents.  Then
each piece takes the planned slot with its length and its rank among the pieces of that length.

Null texts count as empty; an empty document is its closing id alone.  Texts are tokenised whole.  Repeated rows
are packed as often as they occur.  Other columns are not read.  An empty table gives no pieces.
"""

import json
import os
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm.byte_bpe import WHITE
from lumbre.llm.ranks import ranked
from lumbre.llm.workers import Memory, held
from lumbre.storage import cut_lineage

CAPACITY = 2048
CLOSING = 0
#: Bytes of remembered words per worker; longer words are not remembered.
REMEMBERED = 96 << 20
LONGEST = 64

#: Characters that every normalisation leaves one character each: printable ASCII and Latin letters.
SETTLED = "!-~\xc0-\xd6\xd8-\xf6\xf8-\xff"
OTHER = re.compile(f"[^{WHITE}{SETTLED}]")
#: Words with any other character.
OTHER_WORD = re.compile(f"(?<![^{WHITE}])[{SETTLED}]*+[^{WHITE}{SETTLED}][^{WHITE}]*+")
#: In lower case, what the tokenizer's own pattern sets apart from runs of letters: one digit, an ending after an apostrophe, a run of signs.
LETTERS = "a-z\xdf-\xf6\xf8-\xff"
SIGNS = re.compile(f"[^{WHITE}{LETTERS}](?:(?<=[0-9])|(?<=')(?:[stmd]|re|ve|ll)|[^{WHITE}0-9{LETTERS}]*+)")
#: Longer pieces, with those around them, go to the tokenizer's merges; pieces merged in one go.
LONG_PIECE, AT_ONCE = 1000, 1 << 14


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {byte: chr(byte if byte in printable else next(others)) for byte in range(256)}


class Words:
    """The ids of texts by a tokenizer file, and what this worker remembers of words.

    White space separates whatever the tokenizer does, so a text's ids are those of its words.  Plain words are cut into pieces and
    merged by ``tiktoken``, many at once; any other word goes through the whole tokenizer.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.library, self.ids = self._merges(json.loads(content)["model"])
        self.words = Memory(self._word, REMEMBERED, LONGEST)

    def _merges(self, model: dict) -> tuple:
        """The merges as ranks of byte strings, where a space ends a piece, and the id of each rank.

        A last byte takes its space before all other merges, as the vocabulary has both kinds of every byte.
        """
        from tiktoken import Encoding

        suffix, known = model["end_of_word_suffix"], model["vocab"]
        byte_of = {letter: byte for byte, letter in self.letters.items()}

        def spelled(token: str) -> bytes:
            inner = token.removesuffix(suffix)
            return bytes(byte_of[c] for c in inner) + b" " * (inner != token)

        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [*byte_of, *(letter + suffix for letter in byte_of), *merged]
        ranks = {spelled(token): rank for rank, token in enumerate(order)}
        if len(ranks) < len(order) or set(order) != set(known):
            raise ValueError("merges of this tokenizer are not told by their results")
        library = Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        return library, np.array([known[token] for token in order], "<u4")

    def _piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        found = SIGNS.sub(r" \g<0> ", text.lower()).split()
        parts = []
        for first in range(0, len(found), AT_ONCE):
            some = found[first : first + AT_ONCE]
            if max(map(len, some)) > LONG_PIECE:
                parts += map(self._piece, some)
            else:
                parts.append(self.ids[self.library.encode_ordinary(" ".join(some) + " ")].tobytes())
        return b"".join(parts)

    def packed(self, text: str) -> bytes:
        """The ids of a text and the closing id, as little-endian unsigned 32-bit integers."""
        parts, at = [], 0
        if OTHER.search(text):
            for word in OTHER_WORD.finditer(text):
                parts += [self._plain(text[at : word.start()]), self.words[word.group()]]
                at = word.end()
        return b"".join([*parts, self._plain(text[at:]), CLOSING.to_bytes(4, "little")])


def token_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: ids of each whole text by the tokenizer file at ``path``, then the closing id, packed as binary."""
    with open(path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(texts):
        words = held(Words, content.value)
        for batch in texts:
            yield pa.array([words.packed(t.as_py()) for t in batch], pa.binary())

    encode.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    ids = F.arrow_udf(encode, "binary")(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key), ids.alias("ids"))


def pieces(encoded: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """``key, piece, start, length, ids``: sequences longer than ``capacity`` cut, the last piece may be shorter."""
    size = (F.length("ids") / 4).cast("long")
    last = F.greatest(F.ceil(size / capacity) - 1, F.lit(0)).cast("int")
    start = F.col("piece").cast("long") * capacity
    return encoded.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        F.col(key),
        "piece",
        start.alias("start"),
        F.least(size - start, F.lit(capacity)).alias("length"),
        F.substring("ids", F.col("piece") * (4 * capacity) + 1, F.lit(4 * capacity)).alias("ids"),
    )


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit, longest first, over counts: rows ``length, from_rank, per_sequence, first_sequence, offset``.

    The pieces of a length from ``from_rank`` on fill sequences from ``first_sequence`` on, ``per_sequence`` each,
    one behind the other from ``offset``.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, how many)
    sequences, slots = 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = next((r for r in range(length, capacity) if rooms[r]), None)
            if room is None:
                room = capacity
                per = capacity // length
                first, many = sequences, -(-left // per)
                sequences += many
            else:
                first, many = rooms[room].pop()
                per = room // length
            # The room left after one piece is the least that still fits, so a sequence is filled before the next.
            full = min(many, left // per)
            if full:
                slots.append((length, rank, per, first, capacity - room))
                rooms[room - per * length].append((first, full))
                rank, left = rank + full * per, left - full * per
            if full < many:
                if left:  # fewer than fill one more sequence
                    slots.append((length, rank, left, first + full, capacity - room))
                    rooms[room - left * length].append((first + full, 1))
                    full, left = full + 1, 0
                if full < many:
                    rooms[room].append((first + full, many - full))
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def slots(ranked_pieces: DataFrame, planned: np.ndarray) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces with ``length`` and ``rank`` (within the length)."""
    sent = ranked_pieces.sparkSession.sparkContext.broadcast(planned)  # some rows per length

    def take(lengths, ranks):
        lengths, ranks = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        length, rank, per, first, offset = sent.value.T
        run = np.searchsorted((length << 44) + rank, (lengths << 44) + ranks, side="right") - 1
        place = ranks - rank[run]
        return pa.StructArray.from_arrays(
            [pa.array(first[run] + place // per[run]), pa.array(offset[run] + place % per[run] * lengths)],
            ["sequence_id", "offset"],
        )

    take.__annotations__ = {"lengths": pa.Array, "ranks": pa.Array, "return": pa.Array}
    slot = F.arrow_udf(take, "struct<sequence_id:long,offset:long>")("length", "rank")
    taken = ranked_pieces.withColumn("_slot", slot)
    return taken.select(*ranked_pieces.columns, "_slot.sequence_id", "_slot.offset").drop("rank")


def pack(cut: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """``cut`` (with ``key, piece, length``) and a slot for every row: ``sequence_id, offset``.

    The columns of ``cut`` are written to the shared folder and sorted once, so leave out what can be joined again.
    """
    written = cut_lineage(cut)
    counts = {r["length"]: r["count"] for r in written.groupBy("length").count().collect()}  # at most capacity rows
    if not counts:
        return written.selectExpr("*", "cast(null as long) sequence_id", "cast(null as long) offset")
    return slots(ranked(written, ["length"], [F.col(key), F.col("piece")], "rank"), plan(counts, capacity))
