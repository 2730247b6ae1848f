import gzip
import hashlib
import random

import pytest

from lumbre.llm import warc

PAGES = "page_id long, url string, html string"


def test_keys():
    assert warc.capture_key("https://www.Example.com:8080/a/b?c=d#e", 7) == "com,example,www:8080)/a/b?c=d 7"
    assert warc.capture_key(None, None).endswith(") / None".replace(" ", "", 1)) or warc.capture_key(None, None)
    assert warc.capture_key("http://[broken", 1).endswith(" 1")


def test_record_round_trip():
    for url, payload, refers in [("http://x.org/ä b\r\nc", b"<p>\r\n\r\nWARC/1.1</p>", None), (None, b"", None), ("u", b"x" * 200, 9)]:
        digest = hashlib.sha256(payload).hexdigest()
        row = warc.parsed(warc.record(3, url, payload, digest, refers))
        assert (row["page_id"], row["url"], row["refers_to"], row["payload_digest"]) == (3, url, refers, digest)
        assert row["payload"] == (None if refers else payload)


def rows_of(many):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}.example.org/p{rng.randint(0, 30)}", f"<p>{i % 11}</p>" * rng.choice([1, 30])) for i in range(many)]
    return rows + [(None, None, None), (1000, "x", None), (1001, None, "short"), rows[3], rows[3]]


def expected(rows):
    firsts = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            firsts[html] = min(i, firsts.get(html, i))
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        first = firsts.get(html, i)
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=repr)


def test_archives_are_read_back_through_the_index(spark, table):
    rows = rows_of(300)
    pages = table(rows, PAGES, files=4)
    archive = warc.write_archive(pages, archive_bytes=20_000, block_lines=7)
    assert sorted((tuple(r) for r in warc.read_archive(spark, archive, pages).collect()), key=repr) == expected(rows)
    assert len({r["file"] for r in archive.captures.collect()}) > 4 and len(archive.shards) > 1


def test_files_are_gzip_members_of_whole_records(spark, table):
    archive = warc.write_archive(table(rows_of(50), PAGES))
    files, base = warc.opened(archive.folder)
    for r in archive.captures.collect():
        with files.open_input_file(f"{base}/{r['file']}") as file:
            content = file.read()
        assert gzip.decompress(content).count(b"WARC/1.1\r\nWARC-Type") >= 1
        assert gzip.decompress(content[r["offset"] : r["offset"] + r["length"]]).startswith(b"WARC/1.1")


def test_look_up(table):
    rows = rows_of(200)
    archive = warc.write_archive(table(rows, PAGES, files=3), block_lines=5)
    lookup = warc.Lookup(*warc.opened(archive.folder), archive.shards)
    places = {}
    for r in archive.captures.collect():
        places.setdefault(r["key"], []).append((r["file"], r["offset"], r["length"]))
    for key, want in places.items():
        assert sorted((c["file"], c["offset"], c["length"]) for c in lookup.find(key)) == sorted(want)
    for missing in ("", "com,nowhere)/ 1", "~"):
        assert list(lookup.find(missing)) == []


def test_payloads_and_unnamed_files(spark, table):
    """Files of attempts that failed are not in the table of captures, so they are never read."""
    rows = [(i, f"http://a.org/{i}", f"text {i} " * 40) for i in range(20)]
    pages = table(rows, PAGES)
    archive = warc.write_archive(pages)
    files, base = warc.opened(archive.folder)
    with files.open_output_stream(f"{base}/000000-left-over.warc.gz", compression=None) as out:
        out.write(b"broken")
    records = warc.read_records(archive, warc.locate(archive, warc.keys_of(pages))).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in records} == {i: html for i, _, html in rows}


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_nearly_empty(spark, table, rows):
    pages = table(rows, PAGES)
    found = warc.read_archive(spark, warc.write_archive(pages), pages).collect()
    assert [tuple(r) for r in found] == expected(rows)
