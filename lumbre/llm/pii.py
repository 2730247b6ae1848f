"""Personal data in texts: fixed forms, and a semi-Markov conditional random field for what is written otherwise.

The field scores whole candidate segments (a run of up to ``LONGEST`` tokens and a type) by features of the segment as a whole:
how many digits, which signs, whether a checksum holds, what stands before it.  A dynamic programme over the ends of segments,
with that bound on their length, finds boundaries and types jointly.  Weights are trained by conditional likelihood on a bounded
sample: stretches around fixed-form hits of ``SAMPLE`` documents, the same hits written in other ways (without the plus sign,
in words, in groups), and stretches of as many documents without hits.  Documents longer than ``SAMPLE_CHARS`` are not drawn; of one document the first
``STRETCHES`` stretches serve, if they have ``STRETCH_CHARS`` characters, ``EXAMPLE_TOKENS`` tokens and entities of ``LONGEST`` tokens at most.  These bounds
are of the training sample alone.  The same table gives the same weights.

Spans of the field are added where they do not overlap fixed ones, which always stay.  A table without hits trains nothing, and only
fixed forms are found.  Nulls and empty texts have no spans.  Texts are read whole; only stretches around digits and signs of
addresses are scored, so time and memory are in proportion to the text.  Repeated rows are treated alike.  Other columns are only
carried along.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.secret_scan import SPANS, joined_intervals
from lumbre.llm.workers import forget, held

# The forms that are always reported, in the order in which they are listed.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"crf_{kind}" for kind in BASE))

#: Tokens of an entity at most; a bracketed sign or word is one token.
LONGEST = 16
#: Documents with hits and as many without, from which the field is trained.
SAMPLE = 40
#: Characters of context on both sides of what may be an entity.
AROUND = 32
#: How much better than no entity a segment must score to be added.
MARGIN = 1.0
ROUNDS, FIRST_PACE, PENALTY = 60, 0.1, 0.0005
#: Bounds of the training sample.
SAMPLE_CHARS, STRETCHES, STRETCH_CHARS, EXAMPLE_TOKENS = 20_000, 20, 600, 48

TOKEN = re.compile(r"\[\.\]|[\[(](?:at|dot|AT|DOT)[\])]|[^\W_]+|[^\w\s]|_")
#: What may be part of an entity: digits, and the signs and words of addresses.
TRIGGER = re.compile(r"[0-9]{2,}|@|[(\[](?:at|AT)[)\]]|\s(?:dot|DOT)\s")
CUES = {
    "email": ("email", "mail", "e"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "mastercard"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a number written in digits is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address form, found from their signs, so that a long run of letters is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        start = at
        while domain and start > free and text[start - 1] in LOCAL:
            start -= 1
        if domain and start < at:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", a, b) for a, b in emails(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that are scored: around triggers, joined where they meet."""
    parts: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if parts and parts[-1][1] >= start:
            parts[-1][1] = end
        else:
            parts.append([start, end])
    found = []
    for start, end in parts:  # no token is cut
        while start > 0 and end - start < 4 * AROUND and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
        found.append((start, end))
    return found


def steps(name: str, value: int, bounds: tuple[int, ...]) -> str:
    return f"{name}{sum(value >= b for b in bounds)}"


EMAIL_SHAPE = re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+")
WORDY_SHAPE = re.compile(r"[\w.%+-]+\s*[\[(]?\s*(?:at|AT|@)\s*[\])]?\s*[\w-]+(\s*[\[(]?\s*(?:dot|DOT|\.)\s*[\])]?\s*[\w-]+)+")


def features(text: str, start: int, end: int, tokens: int, before: str) -> list[str]:
    """What a segment looks like as a whole."""
    part = text[start:end]
    digits = "".join(c for c in part if c in "0123456789")
    letters = sum(c.isalpha() for c in part)
    names = ["bias", steps("digits", len(digits), (1, 4, 7, 9, 10, 12, 13, 16, 17, 20)), steps("tokens", tokens, (2, 3, 4, 6, 8, 10))]
    names.append("letters" + ("none" if not letters else "few" if letters < len(digits) else "many"))
    names.append(steps("dots", part.count("."), (1, 2, 3, 4)))
    names.append(steps("dashes", part.count("-"), (1, 2, 3, 4)))
    names.append(steps("gaps", sum(c.isspace() for c in part), (1, 2, 3, 4)))
    names += [f"has{c}" for c in "@+(,;:/" if c in part]
    names.append("first" + ("digit" if part[0].isdigit() else "letter" if part[0].isalpha() else part[0] if part[0] in "+(" else "sign"))
    names.append("last" + ("digit" if part[-1].isdigit() else "letter" if part[-1].isalpha() else "sign"))
    names.append("left" + ("open" if start == 0 or text[start - 1].isspace() else "shut" if text[start - 1].isalnum() else "sign"))
    names.append("right" + ("open" if end == len(text) or text[end].isspace() else "shut" if text[end].isalnum() else "sign"))
    numbers = not letters and tokens > 0
    if numbers and 13 <= len(digits) <= 19:
        names.append("luhn" if luhn(digits) else "noluhn")
    if numbers and part.count(".") == 3 and len(digits) <= 12:
        octets = part.replace("[.]", ".").split(".")
        names.append("octets" if all(o.isdigit() and small(o) for o in octets) else "nooctets")
    if numbers and 9 <= len(digits) <= 15:
        names.append("groups" + "-".join(str(len(g)) for g in re.findall("[0-9]+", part)[-3:]))
    if EMAIL_SHAPE.fullmatch(part):
        names.append("address")
    elif letters and WORDY_SHAPE.fullmatch(part):
        names.append("wordyaddress")
    names += [f"cue{kind}" for kind, words in CUES.items() if before in words]
    return names


class Lattice:
    """All segments of a stretch of text."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [m.span() for m in TOKEN.finditer(text)]
        words = [text[a:b].lower() for a, b in self.tokens]
        self.names: dict[tuple[int, int], list[str]] = {}  # by last token and length
        for last in range(len(self.tokens)):
            before = next((w for w in reversed(words[max(0, last - 2) : last]) if w.isalpha()), "")
            self.names[last, 1] = features(text, *self.tokens[last], 1, before)
            for length in range(2, min(LONGEST, last + 1) + 1):
                first = last - length + 1
                start, end = self.tokens[first][0], self.tokens[last][1]
                if self.tokens[first][0] - (self.tokens[first - 1][1] if first else 0) > AROUND:
                    continue
                before = next((w for w in reversed(words[max(0, first - 2) : first]) if w.isalpha()), "")
                self.names[last, length] = features(text, start, end, length, before)


    def segment(self, start: int, end: int) -> tuple[int, int]:
        """Last token and number of tokens between two places."""
        inside = [i for i, (a, b) in enumerate(self.tokens) if a < end and start < b]
        return (inside[-1], len(inside)) if inside else (-1, 0)


class Field:
    """Weights per type (0: no entity, one token) and feature."""

    def __init__(self, weights: dict[str, list[float]]):
        self.weights = {name: np.array(w) for name, w in weights.items()}
        self.nothing = np.zeros(len(BASE) + 1)

    def scores(self, lattice: Lattice) -> dict[tuple[int, int], np.ndarray]:
        return {
            at: sum((self.weights.get(n, self.nothing) for n in names), self.nothing)
            for at, names in lattice.names.items()
        }

    def entities(self, text: str) -> list[tuple[str, int, int]]:
        """The best segmentation of a stretch; its entities that are better than nothing by ``MARGIN``."""
        lattice = Lattice(text)
        scores = self.scores(lattice)
        best, back = [0.0], [(0, 0)]
        for last in range(len(lattice.tokens)):
            choices = [(best[last] + scores[last, 1][0], 1, 0)]
            for length in range(1, min(LONGEST, last + 1) + 1):
                found = scores.get((last, length))
                if found is not None:
                    kind = int(found[1:].argmax()) + 1
                    choices.append((best[last + 1 - length] + found[kind], length, kind))
            score, length, kind = max(choices)
            best.append(score)
            back.append((length, kind))
        found, at = [], len(lattice.tokens)
        while at:
            length, kind = back[at]
            if kind:
                plain = sum(scores[i, 1][0] for i in range(at - length, at))
                if scores[at - 1, length][kind] - plain >= MARGIN:
                    found.append((BASE[kind - 1], lattice.tokens[at - length][0], lattice.tokens[at - 1][1]))
            at -= length
        return found[::-1]


def rewritten(kind: str, part: str) -> list[str]:
    """The same entity as people also write it."""
    if kind == "email":
        forms = []
        letters = re.sub("[0-9]+", "x", part)
        name, _, host = letters.partition("@")
        first, short = re.split("[._-]", name)[0] or name, ".".join(host.split(".")[-2:])
        for address in (part, letters, f"{first}@{short}", f"{name}@{short}"):  # without digits and with fewer parts, too
            name, _, host = address.partition("@")
            dots = [host.replace(".", dot) for dot in (" dot ", " [dot] ", "[.]", " (dot) ")]
            forms += [f"{name} at {dots[0]}", f"{name} (at) {host}", f"{name} (at) {dots[0]}", f"{name} [at] {dots[1]}", f"{name}[at]{dots[2]}", f"{name} (at) {dots[3]}"]
        return forms
    if kind == "phone":
        local = re.sub(r"^\+[0-9]{1,3}\s*", "", part)
        return [local, local.replace("(", "").replace(") ", "-"), local.replace("(", "").replace(") ", ".").replace("-", ".")]
    if kind == "card":
        digits = re.sub("[^0-9]", "", part)
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [" ".join(groups), "-".join(groups), ".".join(groups)]
    return [part.replace(".", "[.]")]


def examples(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled stretches of a text, as it is and with its entities written otherwise."""
    labelled = []
    spans = base_spans(text)
    for start, end in stretches(text)[:STRETCHES]:
        if end - start > STRETCH_CHARS:
            continue
        inside = sorted((a - start, b - start, k) for k, a, b in spans if start <= a and b <= end)
        if any(x[1] > y[0] for x, y in zip(inside, inside[1:], strict=False)):
            continue
        part = text[start:end]
        numbers = (m for m in re.finditer("[0-9]{13,19}", part) if luhn(m.group()))
        if any(all(m.end() <= a or b <= m.start() for a, b, _ in inside) for m in numbers):
            continue  # a number that a longer run of digits kept from matching: no example of nothing
        labelled.append((part, [(k, a, b) for a, b, k in inside]))
        if len(inside) == 1:
            a, b, kind = inside[0]
            for other in rewritten(kind, part[a:b]):
                labelled.append((part[:a] + other + part[b:], [(kind, a, a + len(other))]))
            if kind in ("card", "ip"):  # near misses are nothing
                wrong = str((int(part[b - 1]) + 1) % 10) if kind == "card" else part[b - 1] + ".7"
                labelled.append((part[: b - 1] + wrong + part[b:], []))
    return labelled


def trained(labelled: list[tuple[str, list[tuple[str, int, int]]]]) -> dict[str, list[float]]:
    """Weights by conditional likelihood; the sums over all segmentations go over all stretches at once."""
    number: dict[str, int] = {}
    where, lengths, features_at, how_many, marked = [], [], [], [], []
    row = 0
    for part, spans in labelled:  # of a stretch, only numbers are kept
        if not 0 < len(TOKEN.findall(part)) <= EXAMPLE_TOKENS:
            continue
        lattice = Lattice(part)
        entities = [(kind, *lattice.segment(a, b)) for kind, a, b in spans]
        # A stretch with an entity that cannot be one segment teaches nothing, least of all that it is no entity.
        if not all((last, length) in lattice.names for _, last, length in entities):
            continue
        at_row = {at: row + i for i, at in enumerate(lattice.names)}
        covered = {i for _, last, length in entities for i in range(last + 1 - length, last + 1)}
        marked += [(at_row[last, length], BASE.index(kind) + 1) for kind, last, length in entities]
        marked += [(at_row[i, 1], 0) for i in range(len(lattice.tokens)) if i not in covered]
        where.append(np.array([(len(lengths), *at) for at in lattice.names]))
        features_at.append(np.array([number.setdefault(n, len(number)) for each in lattice.names.values() for n in each], np.int32))
        how_many.append(np.array([len(each) for each in lattice.names.values()], np.int32))
        lengths.append(len(lattice.tokens))
        row += len(lattice.names)
    if not any(kind for _, kind in marked):
        return {}
    names = sorted(number)
    column = np.empty(len(names), np.int32)
    column[[number[n] for n in names]] = np.arange(len(names))
    number = {n: i for i, n in enumerate(names)}
    width, kinds = max(lengths), len(BASE) + 1
    lengths, where = np.array(lengths), tuple(np.concatenate(where).T)
    seen = np.zeros((row, len(names)), np.float32)
    seen[np.repeat(np.arange(row), np.concatenate(how_many)), column[np.concatenate(features_at)]] = 1
    gold = np.zeros((row, kinds))
    gold[tuple(np.array(marked).T)] = 1
    weights, before = np.zeros((len(names), kinds)), np.zeros((len(names), kinds))
    pace = np.full((len(names), kinds), FIRST_PACE)
    wanted = seen.T @ gold
    for _ in range(ROUNDS):
        expected = seen.T @ marginals(seen @ weights, where, lengths, width)
        slope = (wanted - expected) / len(lengths) - PENALTY * weights
        # Every weight has a pace of its own, which grows while its slope keeps its sign and falls when that turns.
        same = slope * before
        pace = np.clip(np.where(same > 0, pace * 1.2, np.where(same < 0, pace * 0.5, pace)), 1e-4, 1.0)
        slope = np.where(same < 0, 0, slope)
        weights += np.sign(slope) * pace
        before = slope
    return {n: weights[i].round(6).tolist() for n, i in number.items()}


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of summed exponentials; of nothing but minus infinity it is that."""
    top = np.maximum(values.max(axis=axis, keepdims=True), -1e300)
    return np.log(np.exp(values - top).sum(axis=axis)) + np.squeeze(top, axis)


def marginals(scores: np.ndarray, where, lengths: np.ndarray, width: int) -> np.ndarray:
    """Probability of every segment and type under the field, by sums forwards and backwards over the ends of segments."""
    stretch, last, length = where
    many, kinds = len(lengths), scores.shape[1]
    scores = scores.copy()
    scores[length > 1, 0] = -np.inf  # nothing is always one token long
    table = np.full((many, width, LONGEST + 1, kinds), -np.inf)
    table[stretch, last, length] = scores
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = log_sum(table, 3)
        ahead = np.full((many, width + 1), -np.inf)
        ahead[:, 0] = 0
        for i in range(width):
            reach = np.arange(1, min(LONGEST, i + 1) + 1)
            ahead[:, i + 1] = log_sum(ahead[:, i + 1 - reach] + whole[:, i, reach], 1)
        behind = np.full((many, width + 1), -np.inf)
        behind[np.arange(many), lengths] = 0
        for i in range(width - 1, -1, -1):
            reach = np.arange(1, min(LONGEST, width - i) + 1)
            steps_on = behind[:, i + reach] + whole[:, i + reach - 1, reach]
            behind[:, i] = np.where(lengths == i, 0, log_sum(steps_on, 1))
        total = ahead[np.arange(many), lengths][stretch]
        return np.exp(scores + (ahead[stretch, last + 1 - length] + behind[stretch, last + 1] - total)[:, None])


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> dict[str, list[float]]:
    """Weights from at most ``2 * sample`` documents: those with the smallest hashes, with and without hits.

    The driver sees hashes and weights; the texts of the sample meet in one task, which learns from them.
    """
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    hashed = F.xxhash64("key", "text").alias("hash")
    hit = F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.|\+[0-9][ ().0-9-]{8}|[0-9]{13}|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]")
    short = given.filter(F.length("text") <= SAMPLE_CHARS)
    drawn = [
        row["hash"]
        for wanted in (hit, ~hit & F.col("text").rlike("[0-9]{2}"))
        for row in short.filter(wanted).select(hashed, "key").orderBy("hash", "key").limit(sample).collect()  # a bounded sample
    ]
    if not drawn:
        return {}

    def learn(batches):
        forget()
        texts = {h: t for batch in batches for h, t in zip(*(batch.column(n).to_pylist() for n in ("hash", "text")), strict=True)}
        weights = trained([each for h in drawn for each in examples(texts[h])]) if texts else {}
        yield pa.RecordBatch.from_pydict({"name": pa.array(list(weights), pa.string()), "weights": pa.array(list(weights.values()), pa.list_(pa.float64()))})

    texts = short.select(hashed, "text").filter(F.col("hash").isin(*set(drawn))).groupBy("hash").agg(F.min("text").alias("text"))
    learned = texts.repartition(1).mapInArrow(learn, "name string, weights array<double>")
    return {row["name"]: row["weights"] for row in learned.orderBy("name").collect()}  # a row per feature


def _field(weights: tuple) -> Field:
    return Field({name: list(values) for name, values in weights})


def all_spans(text: str, field: Field | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind and start."""
    found = base_spans(text)
    if field:
        starts, ends = joined_intervals([(a, b) for _, a, b in found])
        for start, end in stretches(text):
            for kind, a, b in field.entities(text[start:end]):
                a, b = a + start, b + start
                before = bisect_left(starts, b)  # of the fixed spans that begin before the end, the last one reaches furthest
                if not before or ends[before - 1] <= a:
                    found.append((f"crf_{kind}", a, b))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _frozen(weights: dict[str, list[float]]) -> tuple:
    return tuple((name, tuple(values)) for name, values in sorted(weights.items()))


def _held_field(frozen: tuple) -> Field | None:
    return held(_field, frozen) if frozen else forget()


def spans_of(weights: dict[str, list[float]], text: Column) -> Column:
    """An array of all spans of a text, in code points with exclusive ends, by kind and start."""
    frozen = _frozen(weights)

    def find(texts):
        field = _held_field(frozen)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in texts:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t, field)] for t in batch.to_pylist()]
            yield pa.array(spans, kind)

    find.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, SPANS)(F.coalesce(text, F.lit("")))


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: dict[str, list[float]] | None = None) -> DataFrame:
    """``key, personal``: all spans of each row; the field is trained on the table unless its weights are given."""
    weights = train(docs, text, key) if weights is None else weights
    return docs.select(F.col(key), spans_of(weights, F.col(text)).alias("personal"))


def without_spans(text: str | None, found: list[tuple[str, int, int]] | None) -> str | None:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the parts are replaced together."""
    if not found or text is None:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.removeprefix('crf_').upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the parts are replaced together."""

    def mask(texts, lists):
        each = ([(s["kind"], s["start"], s["end"]) for s in found or ()] for found in lists.to_pylist())
        return pa.array(map(without_spans, texts.to_pylist(), each), pa.string())

    mask.__annotations__ = {"texts": pa.Array, "lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(mask, "string")(text, spans)


def spans_masked(weights: dict[str, list[float]], text: Column) -> Column:
    """``text, spans``: the text as ``masked`` makes it from ``spans_of`` it, and how many spans there are.

    Both in one call: a task that calls one after the other keeps two Python workers at a time.
    """
    frozen = _frozen(weights)

    def clean(texts):
        field = _held_field(frozen)
        for batch in texts:
            given = batch.to_pylist()
            found = [all_spans(t or "", field) for t in given]
            whole = pa.array(map(without_spans, given, found), pa.string())
            yield pa.StructArray.from_arrays([whole, pa.array(map(len, found), pa.int32())], ["text", "spans"])

    clean.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(clean, "struct<text:string,spans:int>")(text)
