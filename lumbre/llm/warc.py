"""WARC archives and a two-level index of their captures.

Writing: every task writes gzip members, one per record, to archive files of its own in a folder that all executors
reach.  Files carry a fresh name per attempt and count only when the table of captures names them, so a task that runs
again leaves nothing behind that would be read.  A payload that another page already has becomes a revisit record.

Index: captures are sorted by their key (host labels reversed, then path and query, then the page) over range partitions; each writes an index
file of compressed blocks, with a sparse directory (first key and place of every block) at its end.  A look-up finds
the index file by its first key, the block by binary search in the directory, and the capture in the block; what it
gives is where to read in which archive.  Range reads then go through each archive in order, near ones at once.

Nulls: a null payload is empty, a null URL has an empty key, a null page is written and read back as null.  URLs and texts of any length.  Repeated
rows are records of their own.  Other columns are not read.  Empty tables give an empty archive.
"""

import bisect
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.operators.ordered import shuffle_partitions
from lumbre.storage import cut_lineage, new_folder

#: Payloads shorter than this are never written as revisits.
LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 1 << 28
BLOCK_LINES = 1000
#: Ranges no further apart are read at once, up to so many bytes.
GAP, AT_ONCE = 1 << 16, 1 << 23
ROWS = 1000

# The formats' own names.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:pages:"
DATE = "1970-01-01T00:00:00Z"

CAPTURES = pa.schema(
    [("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
CAPTURES_SQL = "key string, file string, offset long, length long"
RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)
RECORDS_SQL = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def capture_key(url: str | None, page: int | None) -> str:
    """Host labels in reverse, then port, path and query; the page makes it unique."""
    url = url or ""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port else ""
    except ValueError:  # not a URL: its own text is its key
        return f"{quote(url)} {page}"
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{quote(host, safe=',')}{port}){quote(rest, safe='/?&=:%')} {page}"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the record of another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD}{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(content: bytes) -> dict:
    """A record as a row; digest and size are those of the payload that was read, for revisits what the header says."""
    head, block = content.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    number = lambda name: int(fields[name][len(RECORD) + 1 : -1]) if fields.get(name, f"<{RECORD}>") != f"<{RECORD}>" else None
    url = unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    row = {"page_id": number("WARC-Record-ID"), "url": url, "record_type": kind, "refers_to": number("WARC-Refers-To")}
    if kind == "revisit":
        return row | {"payload_bytes": None, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": None}
    payload = block.split(b"\r\n\r\n", 1)[1]
    return row | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload}


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder.replace("file:///", "/", 1) if folder.startswith("file:///") else folder)


def batched(rows: Iterator[dict], schema: pa.Schema, most_bytes: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("payload") or b"") + 100
        if len(held) >= ROWS or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def with_types(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: what each row is written as.

    Equal payloads are found by their digests, reduced to one row per digest in every task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = F.octet_length("payload") >= LEAST_PAYLOAD
    firsts = rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1 and first is not null").select("digest", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


@dataclass
class Archive:
    """An archive: the folder of its files, its captures, and the first keys of its index files in order."""

    folder: str
    captures: DataFrame
    shards: list[tuple[str, str]]


def write_records(typed: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and gives the table of captures, which names the files that count."""

    def write(batches):
        files, base = opened(folder)
        files.create_dir(base, recursive=True)

        def captures():
            out, name, size = None, "", 0
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None or size >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    refers = row["refers_to"]
                    content = record(row["page_id"], row["url"], row["payload"], row["digest"], refers)
                    member = gzip.compress(content, 6, mtime=0)
                    out.write(member)
                    yield {"key": capture_key(row["url"], row["page_id"]), "file": name, "offset": size, "length": len(member)}
                    size += len(member)
            if out is not None:
                out.close()

        yield from batched(captures(), CAPTURES)

    return cut_lineage(typed.mapInArrow(write, CAPTURES_SQL))


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Writes the index files; gives first key and name of each, one per partition of the captures."""

    def write(batches):
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        name, out, size, directory, lines, first = "", None, 0, [], [], ""

        def flush():
            nonlocal size
            block = zlib.compress("\n".join(lines).encode())
            directory.append((first, size, len(block)))
            out.write(block)
            size += len(block)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                if not lines:
                    first = row["key"]
                lines.append(json.dumps([row["key"], row["file"], row["offset"], row["length"]]))
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + struct.pack("<Q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "name": name}])

    placed = captures.repartitionByRange(shuffle_partitions(captures), "key").sortWithinPartitions("key", "file", "offset")
    written = cut_lineage(placed.mapInArrow(write, "first string, name string"))
    return sorted((r["first"], r["name"]) for r in written.collect())  # one row per index file


def write_archive(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES) -> Archive:
    """Writes ``pages`` (``page_id, url, html``) to a new archive in the shared folder, with its index."""
    folder = new_folder(pages.sparkSession, "warc")
    captures = write_records(with_types(pages), folder, archive_bytes)
    return Archive(folder, captures, write_index(captures, folder, block_lines))


class Lookup:
    """Look-ups in the index files of an archive; holds a few directories and blocks."""

    def __init__(self, files: fs.FileSystem, base: str, shards: list[tuple[str, str]], held: int = 8):
        self.files, self.base, self.shards, self.held = files, base, shards, held
        self.firsts = [first for first, _ in shards]
        self.open: OrderedDict[str, tuple] = OrderedDict()
        self.blocks: OrderedDict[tuple, list] = OrderedDict()

    def directory(self, name: str):
        if name not in self.open:
            file = self.files.open_input_file(f"{self.base}/{name}")
            end = file.size()
            (size,) = struct.unpack("<Q", file.read_at(8, end - 8))
            directory = json.loads(zlib.decompress(file.read_at(size, end - 8 - size)))
            self.open[name] = (file, directory, [first for first, _, _ in directory])
            if len(self.open) > 2:
                self.open.popitem(last=False)[1][0].close()
        return self.open[name]

    def block(self, name: str, place: int) -> list:
        if (name, place) not in self.blocks:
            file, directory, _ = self.directory(name)
            _, offset, size = directory[place]
            self.blocks[name, place] = [json.loads(x) for x in zlib.decompress(file.read_at(size, offset)).decode().split("\n")]
            if len(self.blocks) > self.held:
                self.blocks.popitem(last=False)
        return self.blocks[name, place]

    def find(self, key: str) -> Iterator[dict]:
        """All captures with ``key``: equal keys lie in one index file, but maybe in several blocks."""
        shard = bisect.bisect_right(self.firsts, key) - 1
        if shard < 0:
            return
        name = self.shards[shard][1]
        firsts = self.directory(name)[2]
        place = max(0, bisect.bisect_left(firsts, key) - 1)
        while place < len(firsts) and firsts[place] <= key:
            block = self.block(name, place)
            at = bisect.bisect_left(block, key, key=lambda line: line[0])
            while at < len(block) and block[at][0] == key:
                yield dict(zip(CAPTURES.names, block[at], strict=True))
                at += 1
            place += 1


def keys_of(pages: DataFrame) -> DataFrame:
    """The capture keys of ``page_id, url`` rows, each once."""

    def keys(batches):
        for batch in batches:
            urls, ids = batch.column("url").to_pylist(), batch.column("page_id").to_pylist()
            yield pa.RecordBatch.from_pydict({"key": [capture_key(u, i) for u, i in zip(urls, ids, strict=True)]})

    return pages.select("page_id", "url").distinct().mapInArrow(keys, "key string")


def locate(archive: Archive, keys: DataFrame) -> DataFrame:
    """``key, file, offset, length`` of the captures with the given keys, by the two-level index."""
    folder, shards = archive.folder, archive.shards

    def search(batches):
        files, base = opened(folder)
        lookup = Lookup(files, base, shards)
        yield from batched((c for batch in batches for key in batch.column("key").to_pylist() for c in lookup.find(key)), CAPTURES)

    placed = keys.repartitionByRange(shuffle_partitions(keys), "key").sortWithinPartitions("key")
    return placed.mapInArrow(search, CAPTURES_SQL)


def read_records(archive: Archive, located: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at the given places; ranges that lie close together are read at once."""
    folder = archive.folder

    def read(batches):
        files, base = opened(folder)

        def ranges():
            near: list[tuple[int, int]] = []
            name, end = None, 0
            for batch in batches:
                for row in batch.select(["file", "offset", "length"]).to_pylist():
                    start = row["offset"]
                    apart = name != row["file"] or start > end + GAP or end - near[0][0] > AT_ONCE
                    if near and apart:
                        yield name, near
                        near = []
                    name, end = row["file"], start + row["length"]
                    near.append((start, row["length"]))
            if near:
                yield name, near

        def rows():
            held, file = None, None
            for name, near in ranges():
                if name != held:
                    if file is not None:
                        file.close()
                    held, file = name, files.open_input_file(f"{base}/{name}")
                start = near[0][0]
                content = memoryview(file.read_at(near[-1][0] + near[-1][1] - start, start))
                for offset, length in near:
                    with gzip.GzipFile(fileobj=io.BytesIO(content[offset - start : offset - start + length])) as member:
                        row = parsed(member.read())
                    yield row if payloads else row | {"payload": None}

        yield from batched(rows(), RECORDS)

    placed = located.repartitionByRange(shuffle_partitions(located), "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, RECORDS_SQL)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` without payloads, where revisits have the size of the payload they stand for, read from its response."""
    rows = cut_lineage(records.drop("payload"))
    revisits = rows.filter("record_type = 'revisit'")
    first = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
    first = first.agg(F.max("payload_bytes").alias("payload_bytes"))
    filled = revisits.drop("payload_bytes").join(first, ["refers_to", "payload_digest"], "left").select(*rows.columns)
    return rows.filter("record_type = 'response'").unionByName(filled)


def read_archive(spark: SparkSession, archive: Archive, pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the given pages, found through the index and read back."""
    records = read_records(archive, locate(archive, keys_of(pages)), payloads=False)
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
