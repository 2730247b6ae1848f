import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import document
from lumbre.llm import fill_middle as M


def plainly(doc_id, text):
    """Brute force: a list of all lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in M.MARKERS):
        return len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_lines_as_by_a_list(block):
    rng = random.Random(block)
    for _ in range(500):
        text = "".join(rng.choice("ab\né\U0001f600") for _ in range(rng.randint(0, 60)))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        lines = M.Lines(text, block)
        assert lines.count == len(units)
        assert [lines.end_of(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def checks(docs):
    made = M.fill_in_middle(docs)
    rows = made.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(r["back"] for r in rows) == sorted(r["text"] or "" for r in docs.select("text").collect())
    want = sorted(map(str, (plainly(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())))
    assert sorted(str((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in rows) == want
    return rows


def test_odd_rows(odd):
    checks(odd)
    assert M.fill_in_middle(odd.limit(0)).collect() == []


def test_markers_and_many_lines(table, monkeypatch):
    texts = ["a<P>b\nc", "x\n" * 50_000, "<S>", "one < two\n<\nP>", "<\n<\n<P\nS>\nM>\n" * 30, "\n" * 7, "no feed", "\r\n\r\nx"]
    rows = checks(table([document(i, t) for i, t in enumerate(texts * 12)]))
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert {r["form"] for r in rows if "a<P>b" in r["output"]} == {"plain"}


def test_rates_and_markers(table):
    docs = table([document(i, f"a{i}\nb\nc\nd") for i in range(400)])
    forms = [r["form"] for r in M.fill_in_middle(docs, rate=50, spm_rate=0).collect()]
    assert set(forms) == {"plain", "psm"} and 140 < forms.count("plain") < 260
    with pytest.raises(ValueError):
        M.fill_in_middle(docs, markers=("<P>", "><", "<M>"))
    with pytest.raises(ValueError):
        M.fill_in_middle(docs, markers=("<P>", "", "<M>"))
