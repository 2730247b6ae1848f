"""Which tokens of two tokenizers overlap, and how often the corpus links two ids.

Each text, with a space before it, is encoded by a byte-level tokenizer (A) and a piece tokenizer (B), whose tokens both tile its
bytes.  Per batch of documents, an as-of join keyed by document gives each token start the other side's token that covers it; both
directions together are all overlaps.  Places at which tokens of both sides end cut a text into groups.

How often the corpus links two ids is counted in two steps.  A chunk of some megabytes of text keeps its links as places in a list of its
distinct id pairs; these lists, far smaller than the links, are shuffled, summed up and sent back to their chunks.  A pair occurs
once per chunk at most, so no key of a shuffle holds more rows than there are chunks, and a chunk has a bounded size.  Links never
leave their chunk except to meet its sums.

Texts that are null, empty or changed by a tokenizer (joined tokens differ from the bytes) have no tokens.  A text longer than ``AT_ONCE`` is
aligned piece by piece, cut before a space between two words, where tokens of both sides end.  Strings of special tokens are plain text.  Ids of
documents may repeat or be null, rows are told apart by their place; other columns are not read; an empty table gives no rows.
"""

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lumbre.llm.packing import byte_letters
from lumbre.llm.workers import held
from lumbre.storage import cut_lineage

#: Code points of text aligned in one go: a chunk, unless a word is longer.
AT_ONCE = 3 << 20
#: A longer run without a change between white space and ink goes to the tokenizer itself.
LONG_RUN = 1000
#: A space after ink and before ink: a place at which tokens of both sides end.
CUT = re.compile(r"(?<=[!-~])(?= [!-~])")


def byte_vocabulary(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    byte_of = {letter: byte for byte, letter in byte_letters().items()}
    known = tokenizer.get_vocab()
    table = [b""] * (max(known.values()) + 1)
    for token, number in known.items():
        if all(letter in byte_of for letter in token):
            table[number] = bytes(byte_of[letter] for letter in token)
    return table


def piece_vocabulary(pieces) -> list[bytes]:
    """The bytes of each id of a piece tokenizer: U+2581 as space, ``<0xHH>`` as byte."""
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    return [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]


def settled() -> re.Pattern:
    """Finds a character whose class (letter, number, space, other) is not the same in all versions of Unicode, U+2581, or a very long run."""

    def kind(database, sign):
        category = database.category(sign)
        return None if category == "Cn" else category[0] if category[0] in "LNZ" else "-"

    known = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if c not in "\x1c\x1d\x1e\x1f\x85▁"]
    same = [c for c in known if kind(unicodedata, c) and kind(unicodedata, c) == kind(unicodedata.ucd_3_2_0, c)]
    return re.compile(f"[^{''.join(map(re.escape, same))}]|\\S{{{LONG_RUN}}}|\\s{{{LONG_RUN}}}")


class FasterPieces:
    """The merges of a piece tokenizer in a library for bytes.

    Characters of the vocabulary are put together from their bytes by the lowest ranks, so that they are whole before anything else is merged; then come
    the pieces in the order of their scores.  Bytes of any other character stay alone, which is the tokenizer's way out for them, too.
    No piece goes on after a space that follows ink, so words are merged by themselves.  Pieces of spaces alone share one score, which a rank cannot say: texts
    with two spaces in a row are not for this class.
    """

    def __init__(self, pieces):
        from tiktoken import Encoding

        normal = [i for i in range(pieces.get_piece_size()) if not (pieces.is_byte(i) or pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_unused(i))]
        names = {i: pieces.id_to_piece(i).replace("▁", " ") for i in normal}
        byte_id = {int(pieces.id_to_piece(i)[3:5], 16): i for i in range(pieces.get_piece_size()) if pieces.is_byte(i)}
        merged = [i for i in normal if len(names[i]) > 1 and names[i].strip(" ")]
        scores = [pieces.get_score(i) for i in merged]
        if len(byte_id) < 256 or any(" " in n.lstrip(" ") for n in names.values()) or any(b >= a for a, b in zip(scores, scores[1:], strict=False)):
            raise ValueError("merges of this tokenizer are not told by its scores")
        ids = {bytes([b]): [i] for b, i in byte_id.items()} | {names[i].encode(): [i] for i in normal if len(names[i]) == 1}
        for letter in list(ids):
            for size in range(2, len(letter)):
                ids.setdefault(letter[:size], [byte_id[b] for b in letter[:size]])
        order = sorted(ids, key=lambda t: (len(t), t)) + [names[i].encode() for i in merged]
        ids |= {names[i].encode(): [i] for i in merged}
        words = r" *[^ \n]+|\n| +" if not any("\n" in n for n in names.values()) else " *[^ ]+| +"
        self.library = Encoding("pieces", pat_str=words, mergeable_ranks={t: n for n, t in enumerate(order)}, special_tokens={})
        self.many = np.array([len(ids[t]) for t in order])
        self.flat = np.array([i for t in order for i in ids[t]], np.int32)
        self.starts = np.cumsum(self.many) - self.many

    def encode(self, spaced: str) -> np.ndarray:
        ranks = np.array(self.library.encode_ordinary(spaced))
        many, starts = self.many[ranks], self.starts[ranks]
        if len(ranks) == int(many.sum()):
            return self.flat[starts]
        ends = np.cumsum(many)
        return self.flat[np.repeat(starts - ends + many, many) + np.arange(int(ends[-1]))]


class Pair:
    """Both tokenizers, by the contents of their files.

    Where the classes of all characters are beyond doubt, the merges of both run in a faster library, whose tokens tile the text whatever it is.
    For A its ranks are A's ids, which must be in the order of A's merges.  Other texts go through the tokenizers themselves.
    """

    def __init__(self, content_a: bytes, content_b: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(content_a.decode())
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_proto=content_b)
        self.bytes_a, self.bytes_b = byte_vocabulary(self.a), piece_vocabulary(self.b)
        self.size_a, self.size_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.fast_a = self._ranked(json.loads(content_a), pattern)
        self.fast_b = FasterPieces(self.b)
        self.doubtful = settled()
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        #: Every id before a comma, a bar and a semicolon.
        self.written = pa.array([f"{i}{sign}".encode() for sign in ",|;" for i in ids], pa.binary())
        self.signs = len(ids)

    def _ranked(self, file: dict, pattern: str):
        from tiktoken import Encoding

        special = {t["content"] for t in file["added_tokens"]}
        vocabulary = {token: number for token, number in file["model"]["vocab"].items() if token not in special}
        merges = ("".join(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"])
        order = [vocabulary[m] for m in merges]
        if order != sorted(order) or len(order) + 256 != len(vocabulary) or file["normalizer"] is not None:
            raise ValueError("ids of this tokenizer are not in the order of its merges")
        return Encoding("bytes", pat_str=pattern, mergeable_ranks={self.bytes_a[n]: n for n in vocabulary.values()}, special_tokens={})

    def tokens(self, spaced: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides for a text that begins with a space; none if a tokenizer changes it."""
        settled = not self.doubtful.search(spaced)
        ids_a = self.fast_a.encode_ordinary(spaced) if settled else self.a.encode(spaced, add_special_tokens=False).ids
        if settled and "  " not in spaced:
            return np.array(ids_a, np.int32), self.fast_b.encode(spaced)
        ids_b = self.b.encode(spaced[1:])  # the tokenizer adds the space
        given = spaced.encode()
        for ids, table in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            if b"".join(map(table.__getitem__, ids)) != given:
                return None
        return np.array(ids_a, np.int32), np.array(ids_b, np.int32)


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping tokens (places in both lists).

    Starts count on over the documents of a batch, so they are in order on both sides; documents are the key of the join all the same.
    """
    a = pd.DataFrame({"doc": doc_a, "start": start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"doc": doc_b, "start": start_b, "b": np.arange(len(start_b))})
    covering_b = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy().astype(np.int64)
    covering_a = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy().astype(np.int64)
    inside = start_a[covering_a] < start_b  # equal starts are in the other direction already
    link_a = np.concatenate([a["a"].to_numpy(), covering_a[inside]])
    link_b = np.concatenate([covering_b, b["b"].to_numpy()[inside]])
    return link_a, link_b


class Aligned:
    """The alignment of a batch of texts given by the ids of both sides."""

    def __init__(self, pair: Pair, texts: list[tuple[np.ndarray, np.ndarray]]):
        count = len(texts)
        self.many_a, self.many_b = (np.array([len(t[side]) for t in texts], np.int64) for side in (0, 1))
        self.ids_a, self.ids_b = (np.concatenate([t[side] for t in texts]) for side in (0, 1))
        size_a, size_b = pair.size_a[self.ids_a], pair.size_b[self.ids_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        self.doc_a, self.doc_b = np.repeat(np.arange(count), self.many_a), np.repeat(np.arange(count), self.many_b)
        self.link_a, self.link_b = overlaps(self.doc_a, end_a - size_a, self.doc_b, end_b - size_b)
        self.links = np.bincount(self.doc_a[self.link_a], minlength=count)
        #: Tokens at whose end a group ends: those that end where one of the other side does.
        self.last_a = end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a
        self.last_b = end_a[np.minimum(np.searchsorted(end_a, end_b), len(end_a) - 1)] == end_b
        self.groups = np.bincount(self.doc_a[self.last_a], minlength=count)

    def written(self, pair: Pair) -> list[memoryview]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3;``."""
        group_a = np.cumsum(self.last_a) - self.last_a
        group_b = np.cumsum(self.last_b) - self.last_b
        total = int(self.last_a.sum())
        to_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=total))])  # B tokens before each group
        to_a = np.cumsum(np.bincount(group_a, minlength=total))  # A tokens up to each group
        order = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        order[np.arange(len(self.ids_a)) + to_b[group_a]] = self.ids_a + pair.signs * self.last_a
        order[np.arange(len(self.ids_b)) + to_a[group_b]] = self.ids_b + 2 * pair.signs * self.last_b
        text = pair.written.take(pa.array(order))
        offsets = np.frombuffer(text.buffers()[1], np.int32)
        ends = offsets[np.concatenate([[0], np.cumsum(self.many_a + self.many_b)])].tolist()
        content = memoryview(text.buffers()[2])
        return [content[start:end] for start, end in zip(ends, ends[1:], strict=False)]


def spaced_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Row, key and the text with its space, or nothing for a null or empty text."""
    for batch in batches:
        row, key, text = batch.columns
        for i in range(batch.num_rows):
            whole = text[i].as_py()
            yield row[i].as_py(), key[i].as_py(), f" {whole}" if whole else None


def stretches(text: str) -> Iterator[str]:
    """A long text, cut before a space between two words."""
    start = 0
    while start < len(text):
        cut = CUT.search(text, start + AT_ONCE)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


class Chunks:
    """Turns texts into rows: one per document, and one per chunk of aligned text with its links."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.pending: list[tuple] = []
        self.size = 0

    def rows(self, texts: Iterator[tuple]) -> Iterator[dict]:
        for row, key, text in texts:
            if text is None:
                yield self._document(row, key)
            elif len(text) > AT_ONCE:
                yield from self._flush()
                yield from self._long(row, key, text)
            else:
                tokens = self.pair.tokens(text)
                if tokens is None:
                    yield self._document(row, key)
                    continue
                self.pending.append((row, key, tokens))
                self.size += len(text)
                if self.size > AT_ONCE:
                    yield from self._flush()
        yield from self._flush()

    @staticmethod
    def _document(row, key, counts=(0, 0, 0, 0), digest="") -> dict:
        return {"_row": row, "key": key, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(int, counts), strict=True)), "groups_sha256": digest}

    def _flush(self) -> Iterator[dict]:
        if not self.pending:
            return
        done = Aligned(self.pair, [tokens for _, _, tokens in self.pending])
        for (row, key, _), groups, *counts in zip(self.pending, done.written(self.pair), done.many_a, done.many_b, done.groups, done.links, strict=True):
            yield self._document(row, key, counts, hashlib.sha256(groups[:-1]).hexdigest())
        yield self._chunk([row for row, _, _ in self.pending], done, 0)
        self.pending, self.size = [], 0

    def _long(self, row, key, text: str) -> Iterator[dict]:
        if any(self.pair.tokens(part) is None for part in stretches(text)):
            yield self._document(row, key)
            return
        digest, counts, before = hashlib.sha256(), np.zeros(4, np.int64), None
        for number, part in enumerate(stretches(text)):
            done = Aligned(self.pair, [self.pair.tokens(part)])
            groups = done.written(self.pair)[0]
            if before is not None:
                digest.update(b";")
            digest.update(before := groups[:-1])
            counts += [done.many_a[0], done.many_b[0], done.groups[0], done.links[0]]
            yield self._chunk([row], done, number)
        yield self._document(row, key, counts, digest.hexdigest())

    @staticmethod
    def _chunk(rows: list[int], done: Aligned, piece: int) -> dict:
        pairs = done.ids_a[done.link_a].astype(np.int64) << 32 | done.ids_b[done.link_b]
        kinds, place, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        # Links in the order of their documents; frequent pairs first in the list, so that places are small numbers.
        order = np.argsort(done.doc_a[done.link_a], kind="stable")
        often = np.argsort(-counts, kind="stable")
        rank = np.empty(len(kinds), np.uint16 if len(kinds) <= 1 << 16 else np.uint32)
        rank[often] = np.arange(len(kinds))
        links = pa.compress(rank[place[order]].tobytes(), "zstd", asbytes=True)
        return {
            "chunk": rows[0],
            "piece": piece,
            "rows": rows,
            "many": done.links,
            "links": links,
            "pairs": kinds[often],
            "counts": counts[often],
        }


KINDS = {
    "_row": pa.int64(),
    "key": None,
    **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64()),
    "groups_sha256": pa.string(),
    "chunk": pa.int64(),
    "piece": pa.int32(),
    "rows": pa.list_(pa.int64()),
    "many": pa.list_(pa.int64()),
    "links": pa.binary(),
    "pairs": pa.list_(pa.int64()),
    "counts": pa.list_(pa.int64()),
}
CHUNK = "chunk long, piece int, rows array<long>, many array<long>, links binary, pairs array<long>, counts array<long>"


def opened(docs: DataFrame, path_a: str, path_b: str, pattern: str):
    """A function that gives a worker its tokenizers; their files are sent to the executors.

    ``pattern`` is how A splits texts, in the syntax of the faster library.
    """
    contents = []
    for path in (path_a, path_b):
        with open(path, "rb") as file:
            contents.append(docs.sparkSession.sparkContext.broadcast(file.read()))
    first, second = contents
    return lambda: held(Pair, first.value, second.value, pattern)


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two kinds of rows: documents with ``key`` and their counts and digest, and chunks (``chunk, piece``) with their links."""
    tokenizers = opened(docs, path_a, path_b, pattern)

    def align(batches):
        first = next(batches, None)
        if first is None:
            return
        kind = first.column(1).type
        kinds = {name: kind if name == "key" else k for name, k in KINDS.items()}

        def whole(records):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in records], k) for n, k in kinds.items()], list(kinds))

        def every():
            yield first
            yield from batches

        records = []
        for record in Chunks(tokenizers()).rows(spaced_texts(every())):
            records.append(record)
            if "chunk" in record or len(records) >= 5000:
                yield whole(records)
                records = []
        yield whole(records)

    given = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("key"), F.col(text).alias("text"))
    fields = [StructField("_row", LongType()), given.schema["key"], *(StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links"))]
    schema = StructType([*fields, StructField("groups_sha256", StringType()), *StructType.fromDDL(CHUNK).fields])
    return given.mapInArrow(align, schema)


def link_statistics(docs: DataFrame, path_a: str, path_b: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row.

    ``count_sum`` adds up, over the links of a text, how many links of the corpus link the same two ids; ``n_best`` counts the links whose
    number is the highest that their B id has.
    """
    written = cut_lineage(aligned_chunks(docs, path_a, path_b, pattern, key, text))
    chunks = written.filter("chunk is not null").select("chunk", "piece", "rows", "many", "links", "pairs", "counts")
    listed = chunks.select("chunk", "piece", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "_pair"))
    listed = listed.select("chunk", "piece", "place", F.col("_pair.pairs").alias("pair"), F.col("_pair.counts").alias("n"))
    totals = cut_lineage(listed.groupBy("pair").agg(F.sum("n").alias("total")))
    # An id has at most as many partners as the other vocabulary has ids.
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = totals.groupBy(of_b.alias("b")).agg(F.max("total").alias("most"))
    judged = totals.join(highest, of_b == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    sums = listed.join(judged, "pair").select("chunk", "piece", "place", "total", "best")

    def gather(of_chunk: pa.Table, of_pairs: pa.Table) -> pa.Table:
        place = of_pairs.column("place").to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        total[place] = of_pairs.column("total").to_numpy()
        best[place] = of_pairs.column("best").to_numpy(zero_copy_only=False)
        rows, many = (of_chunk.column(n)[0].values.to_numpy() for n in ("rows", "many"))
        width = np.dtype(np.uint16 if len(place) <= 1 << 16 else np.uint32)
        size = int(many.sum())
        links = np.frombuffer(pa.decompress(of_chunk.column("links")[0].as_py(), size * width.itemsize, "zstd"), width)
        starts = np.concatenate([[0], np.cumsum(many)])
        best, total = (np.concatenate([[0], np.cumsum(x[links], dtype=np.int64)])[starts] for x in (best, total))
        return pa.table({"_row": rows, "n_best": np.diff(best), "count_sum": np.diff(total)})

    # Columns of one table on both sides are told apart by new names.
    packed = chunks.select(F.col("chunk").alias("_chunk"), F.col("piece").alias("_piece"), "rows", "many", "links")
    found = packed.groupBy("_chunk", "_piece").cogroup(sums.groupBy("chunk", "piece")).applyInArrow(gather, "_row long, n_best long, count_sum long")
    per_row = found.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    documents = written.filter("_row is not null").select("_row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return documents.join(per_row, "_row", "left").select(
        F.col("key").alias(key),
        *("n_a", "n_b", "n_groups", "n_links"),
        *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_best", "count_sum")),
        "groups_sha256",
    )


def aligned(docs: DataFrame, path_a: str, path_b: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids_a, ids_b, groups, links`` of each row: the ids of both sides, the groups as text, and the overlapping tokens by place.

    All of a text is in one row here, so a worker holds the alignment of one text at a time.
    """
    tokenizers = opened(docs, path_a, path_b, pattern)
    link = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def align(batches):
        pair = tokenizers()
        for batch in batches:
            for _, key_of, spaced in spaced_texts(iter([batch])):
                tokens = pair.tokens(spaced) if spaced else None
                if tokens is None:
                    columns = [[], [], "", []]
                else:
                    done = Aligned(pair, [tokens])
                    order = np.lexsort((done.link_b, done.link_a))
                    links = pa.StructArray.from_arrays([pa.array(x[order], pa.int32()) for x in (done.link_a, done.link_b)], fields=list(link))
                    columns = [*tokens, bytes(done.written(pair)[0][:-1]).decode(), links]
                kinds = [batch.schema[1].type, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.list_(link)]
                if tokens is not None:
                    columns[3] = pa.ListArray.from_arrays(pa.array([0, len(links)], pa.int32()), links)
                arrays = [pa.array([key_of], kinds[0]), *(c if isinstance(c, pa.ListArray) else pa.array([c], k) for c, k in zip(columns, kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "ids_a", "ids_b", "groups", "links"])

    given = docs.select(F.lit(0).cast("long").alias("_row"), F.col(key).alias("key"), F.col(text).alias("text"))
    real = StructType.fromDDL("ids_a array<int>, ids_b array<int>, groups string, links array<struct<a: int, b: int>>")
    return given.mapInArrow(align, StructType([given.schema["key"], *real.fields])).withColumnRenamed("key", key)
