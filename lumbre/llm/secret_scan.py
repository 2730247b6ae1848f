"""Secrets in texts: fixed forms, and stretches whose characters are too evenly spread to be language.

The second part slides a window over every candidate string and keeps the Shannon entropy of the window's characters
by counts: one character enters, one leaves, so a step costs the same for any width.  Each character class (hexadecimal,
capitals with digits, base 64) has its own threshold, since an alphabet of 16 cannot reach the entropy of one of 64.
An allow-list then suppresses strings that are known to be harmless.

Nulls and empty texts have no secrets.  Texts are scanned whole, whatever their length; the memory needed is that of
the text and its spans.  Repeated rows are scanned and returned as often as they occur.  An empty table gives no rows.
"""

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int>>"

# The forms that are always reported, in the order in which equal starts are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is a leftmost match, a shorter one is dropped
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_upper", "entropy_base64")
ORDER = {kind: place for place, kind in enumerate(KINDS)}

#: Logarithms as whole numbers, so that a sum kept by adding and taking away is exact.
UNIT = 1 << 32


@dataclass(frozen=True)
class CharacterClass:
    """Candidate strings are runs of ``alphabet`` of at least ``width`` characters; ``bits`` is the threshold."""

    kind: str
    alphabet: str
    width: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", "0-9a-fA-F", 20, 3.0),
    CharacterClass("entropy_upper", "A-Z0-9", 20, 3.5),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", 20, 3.9),
)

#: Candidates that match one of these are no secrets.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[0-9]+"),  # a number
    re.compile(r"[^0-9]+"),  # letters and signs only: long words, paths, rulers
    re.compile(r"(/?[A-Za-z0-9_-]{1,15}){0,1}(/[A-Za-z0-9_-]{1,15}){2,}/?"),  # a path of short parts
    re.compile(r"(?i).*(example|sample|dummy|placeholder|changeme|redacted|xxxx|0123456789|abcdefgh).*"),
)


def entropy_spans(text: str, start: int, end: int, width: int, bits: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``width`` characters in ``text[start:end]`` with an entropy of at least ``bits``."""
    if end - start < width:
        return []
    weigh = [round(n * math.log2(n) * UNIT) if n else 0 for n in range(width + 1)]
    # entropy = log2(width) - sum(n log2 n) / width, so the threshold is one on the sum
    most = math.floor((math.log2(width) - bits) * width * UNIT + 0.5)
    counts = Counter(text[start : start + width])
    total = sum(weigh[n] for n in counts.values())
    found: list[tuple[int, int]] = []
    for at in range(start, end - width + 1):
        if at > start:
            gone, come = text[at - 1], text[at + width - 1]
            if gone != come:
                n, m = counts[gone], counts[come]
                total += weigh[n - 1] - weigh[n] + weigh[m + 1] - weigh[m]
                counts[gone], counts[come] = n - 1, m + 1
        if total <= most:
            if found and found[-1][1] >= at:
                found[-1] = (found[-1][0], at + width)
            else:
                found.append((at, at + width))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if "=" in text or ":" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def joined_intervals(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order and apart from each other."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def free_parts(start: int, end: int, taken: tuple[list[int], list[int]], least: int) -> Iterator[tuple[int, int]]:
    """The parts of a span that are not taken, of at least so many characters."""
    starts, ends = taken
    at = bisect_right(ends, start)
    while at < len(starts) and starts[at] < end:
        if starts[at] - start >= least:
            yield start, starts[at]
        start = max(start, ends[at])
        at += 1
    if end - start >= least:
        yield start, end


class Scanner:
    """Finds all spans of a text; holds the compiled forms."""

    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allowed=ALLOWED):
        self.classes = [(c, re.compile(f"[{c.alphabet}]{{{c.width},}}")) for c in classes]
        self.allowed = allowed

    def suppressed(self, candidate: str) -> bool:
        return any(form.fullmatch(candidate) for form in self.allowed)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` by start and kind; an entropy span is cut to what no kind before it has, a window of it at least."""
        found = base_spans(text)
        for kind, run in self.classes:
            taken = joined_intervals([(a, b) for _, a, b in found])
            for candidate in run.finditer(text):
                a, b = candidate.span()
                if self.suppressed(candidate.group()):
                    continue
                for start, end in entropy_spans(text, a, b, kind.width, kind.bits):
                    found += [(kind.kind, a, b) for a, b in free_parts(start, end, taken, kind.width)]
        return sorted(found, key=lambda s: (s[1], ORDER.get(s[0], len(ORDER)), s[2]))


def secret_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES
) -> DataFrame:
    """``key, secrets``: all secret spans of each row, in code points with exclusive ends, ordered by start.

    One row per input row; other columns are not read, whatever their names.
    """

    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(classes)
        for batch in texts:
            yield pa.array(
                [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t)] for t in batch.to_pylist()],
                pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
            )

    scan.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(scan, SPANS)
    return docs.select(F.col(key), found(F.coalesce(F.col(text), F.lit(""))).alias("secrets"))
