"""Near duplicates by Order MinHash, verified by alignment.

Texts are sequences of shingles of five words.  Each of ``TABLES`` hash functions picks the ``PICKED`` shingles with the smallest
values, shingles that occur several times told apart by their occurrence numbers; the picked ones are kept in the order
they have in the text.  Two texts agree on a table only if the same shingles come in the same order, which depends on the edit
similarity and not only on the sets.  Texts of fewer than ``SHORT`` shingles, for which a table asks too much, are found by a prefix filter
instead, which no similar pair escapes.  Texts that agree on a table are candidates; a banded alignment of their shingle sequences decides:
similar if at most a fifth of the longer one has to be edited.

Texts of a table entry are first aligned with one of it; most entries are one class then.  In the others
every two texts of different classes are decided: those of small entries one by one; large entries are divided by the rarest
shingles, at one of which similar texts must meet, and parts that are still large (taken together where they overlap) are compared in blocks, where shared shingles are counted
for all pairs at once and pairs that share enough are aligned unless they are linked by then.  So candidates that are similar are always
in one class.  Classes are the connected components of the links.  Equal texts are one text from the start.

Null texts count as empty.  Texts without words are near duplicates of equal texts only; of fewer than five words, there is one
shingle of all of them.  Texts are read whole.  Ids may repeat or be null: rows are told apart by id and text; the class id is the smallest id.
Other columns are not read.  An empty table gives no rows.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm.components import components
from lumbre.llm.workers import forget
from lumbre.storage import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE = 5
SIMILARITY = 0.8
TABLES, PICKED = 32, 5
#: Texts of fewer shingles are paired by their first shingles in a fixed order instead of tables.
SHORT = 50
#: Up to so many texts of an entry are paired with each other; larger entries are divided, and compared in blocks of some BLOCK texts and BLOCK_CHARS
#: characters, whichever makes more blocks; a longer text is a block by itself.
SMALL, BLOCK, BLOCK_CHARS = 16, 512, 2 << 20
#: Classes of shingles by which frequencies are counted, and shingles counted in one go in a block.
COUNTER_BITS, WIDE = 18, 4096
#: Numbers handled in one go, whatever the length of the text.
AT_ONCE = 1 << 21

_random = np.random.default_rng(20240117)
_FACTORS = _random.integers(1, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _random.integers(0, 2**63, TABLES, np.uint64)
_ODD = _random.integers(1, 2**63, TABLES, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    return values * np.uint64(0x81DADEF4BC2DD44D)


def shingle_numbers(words: list[str]) -> np.ndarray:
    """One 64-bit number per shingle, different for each occurrence of a shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))  # cheaper than to remember words
    size = min(SHINGLE, len(words))
    count = len(words) - size + 1
    numbers = np.zeros(count, np.uint64)
    for place in range(size):
        numbers += codes[place : place + count] * _FACTORS[place]
    numbers = mixed(numbers)
    order = np.argsort(numbers, kind="stable")
    ordered = numbers[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if not new.all():
        first = np.maximum.accumulate(np.where(new, np.arange(count), 0))
        occurrence = np.empty(count, np.uint64)
        occurrence[order] = (np.arange(count) - first).astype(np.uint64)
        numbers = np.where(occurrence > 0, mixed(numbers + occurrence * np.uint64(0x9E3779B97F4A7C15)), numbers)
    return numbers


def sketch(text: str) -> np.ndarray:
    """One number per table: what the picked shingles are, in their order; none for a text without words.

    A short text has its smallest shingles instead, as many as it may lack of a similar text, and one: similar texts share one of them.
    """
    numbers = shingle_numbers(WORD.findall(text))
    if not len(numbers):
        return np.zeros(0, np.int64)
    entry = np.zeros(0, np.uint64)
    if len(numbers) * SIMILARITY < SHORT:  # also those that a shorter one may be similar to
        entry = mixed(np.sort(numbers)[: spared(len(numbers)) + 1])
    if len(numbers) < SHORT:
        return entry.view(np.int64)
    places = []
    step = max(1, AT_ONCE // len(numbers))
    for first in range(0, TABLES, step):
        last = min(TABLES, first + step)
        values = (numbers[None, :] ^ _SEEDS[first:last, None]) * _ODD[first:last, None]
        places.append(np.sort(np.argpartition(values, PICKED - 1, axis=1)[:, :PICKED], axis=1))
    chosen = numbers[np.concatenate(places)]
    table = _SEEDS.copy()
    for place in range(PICKED):
        table = mixed(table ^ chosen[:, place])
    return np.concatenate([table, entry]).view(np.int64)


def shingles(text: str) -> list[str]:
    words = WORD.findall(text)
    size = min(SHINGLE, len(words))
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []


def same_ahead(a: list, b: list, i: int, j: int) -> int:
    """How many symbols from ``a[i]`` and ``b[j]`` on are equal."""
    start, step = i, 1
    while True:
        if step == 1 and (i >= len(a) or j >= len(b) or a[i] != b[j]):
            return i - start
        if a[i : i + step] == b[j : j + step] and i + step <= len(a) and j + step <= len(b):
            i, j, step = i + step, j + step, step * 2
        else:
            step = max(1, step // 2)


def within(a: list, b: list, limit: int) -> bool:
    """Whether at most ``limit`` insertions, deletions and replacements turn ``a`` into ``b``.

    The alignment is kept to the band of diagonals that so many edits can reach: for every number of edits, the
    furthest place on each diagonal.
    """
    if abs(len(a) - len(b)) > limit:
        return False
    common = sum((Counter(a) & Counter(b)).values())
    if max(len(a), len(b)) - common > limit:  # every symbol without a partner costs an edit
        return False
    goal = len(b) - len(a)
    reach = {0: same_ahead(a, b, 0, 0)}
    for edits in range(limit + 1):
        if reach.get(goal, -1) >= len(a):
            return True
        further = {}
        for k in range(-edits - 1, edits + 2):
            if abs(k - goal) > limit - edits - 1:  # too far from the end for the edits that are left
                continue
            at = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            if at >= 0 and at + k >= 0:
                at = min(at, len(a), len(b) - k)
                further[k] = at + same_ahead(a, b, at, at + k)
        reach = further
    return False


def spared(size: int) -> int:
    """How many of ``size`` shingles a text may not share with a similar one."""
    return int((1 - SIMILARITY) * size + 1e-9)


def similar(a: str, b: str) -> bool:
    x, y = shingles(a), shingles(b)
    longer = max(len(x), len(y))
    if not x or not y:
        return False
    numbers: dict[str, int] = {}
    p = [numbers.setdefault(s, len(numbers)) for s in x]
    q = [numbers.setdefault(s, len(numbers)) for s in y]
    start = same_ahead(p, q, 0, 0)
    p, q = p[start:], q[start:]
    end = same_ahead(p[::-1], q[::-1], 0, 0)
    p, q = p[: len(p) - end], q[: len(q) - end]
    return within(p, q, spared(longer))


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _digest, _row, _sketch`` of every row; ``_row`` numbers them."""

    def entries(texts):
        forget()
        for batch in texts:
            rows = [sketch(t.as_py()) for t in batch]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))

    entries.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("_id"),
        digest_of(text).alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),
        F.arrow_udf(entries, "array<long>")(whole).alias("_sketch"),
    )


def digest_of(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` of the pairs whose texts are similar, and of the others, told apart by ``linked``."""

    def decide(batches):
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("a", "b", "text_a", "text_b")]
            linked = [similar(x, y) for x, y in zip(columns[2], columns[3], strict=True)]
            yield pa.RecordBatch.from_pydict({"a": columns[0], "b": columns[1], "linked": linked})

    first = texts.select(F.col("node").alias("a"), F.col("_text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("_text").alias("text_b"))
    return pairs.join(second, "b").join(first, "a").mapInArrow(decide, "a long, b long, linked boolean")


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``entry, node, label, n`` of the entries (of ``n`` texts) that hold texts of several components; of entries with the same texts, one."""
    placed = members.join(labels.withColumnRenamed("label", "_of"), "node", "left").select("entry", "node", F.coalesce("_of", "node").alias("label"))
    marks = (F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2))
    sizes = placed.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), *marks)
    several = sizes.filter("least < most").groupBy("n", "x0", "x1").agg(F.min("entry").alias("entry"))
    return cut_lineage(placed.join(several.select("entry", "n"), "entry"))


def rare_entries(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``entry, node``: the rarest shingles of each of the ``nodes``, as many as it may lack of a similar text, and one.

    Similar texts share all but so many shingles, so in any order of all shingles they meet at one of the first ones.  The order is by
    frequency among these texts, counted in 2**COUNTER_BITS classes of shingles.
    """
    crowd = nodes.join(texts, "node").select("node", "_text")
    shift = np.uint64(64 - COUNTER_BITS)

    def count(batches):
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                np.add.at(total, shingle_numbers(WORD.findall(text)) >> shift, 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"class": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counts = crowd.mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 << COUNTER_BITS, np.int64)
    frequency[counts["class"].to_numpy()] = counts["n"].to_numpy()

    def rarest(texts):
        for batch in texts:
            rows = []
            for text in batch.to_pylist():
                numbers = shingle_numbers(WORD.findall(text))
                rows.append(numbers[np.lexsort((numbers, frequency[numbers >> shift]))[: spared(len(numbers)) + 1]].view(np.int64))
            yield pa.array(rows, pa.list_(pa.int64()))

    rarest.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return crowd.select("node", F.explode(F.arrow_udf(rarest, "array<long>")("_text")).alias("entry"))


def joined(parts: DataFrame) -> DataFrame:
    """``parts`` (``entry, node, label, n``) without ``n``; parts that share texts are one where that makes fewer pairs than all of them have."""
    groups = components(parts.select(F.col("node").alias("a"), F.col("entry").alias("b"))).select(F.col("node").alias("entry"), F.col("label").alias("group"))
    grouped = cut_lineage(parts.join(groups, "entry"))
    pairs = grouped.select("group", "entry", "n").distinct().groupBy("group").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    texts = grouped.select("group", "node").distinct().groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("texts"))
    together = pairs.join(texts, "group").select("group", (F.col("texts") * F.col("texts") <= F.col("pairs")).alias("together"))
    entry = F.when(F.col("together"), F.xxhash64("group", F.lit(0))).otherwise(F.col("entry")).alias("entry")
    return grouped.join(together, "group").select(entry, "node", "label").distinct()


def forest(nodes: list[int], labels: list[int], texts: list[str]) -> list[tuple[int, int]]:
    """Links between similar texts of different components, as few as tie together what is similar.

    Only pairs that share enough shingles for it are aligned; those are counted for all pairs at once.
    """
    numbers = [shingle_numbers(WORD.findall(t)) for t in texts]
    sizes = np.array([len(x) for x in numbers])
    owner = np.repeat(np.arange(len(texts)), sizes)
    _, kind, many = np.unique(np.concatenate(numbers), return_inverse=True, return_counts=True)
    owner, kind = owner[many[kind] > 1], kind[many[kind] > 1]
    kind = np.unique(kind, return_inverse=True)[1]
    order = np.argsort(kind, kind="stable")
    owner, kind = owner[order], kind[order]
    common = np.zeros((len(texts), len(texts)), np.float32)
    kinds = int(kind[-1]) + 1 if len(kind) else 0
    for first in range(0, kinds, WIDE):
        start, end = np.searchsorted(kind, (first, first + WIDE))
        part = np.zeros((len(texts), min(WIDE, kinds - first)), np.float32)
        part[owner[start:end], kind[start:end] - first] = 1
        common += part @ part.T
    longer = np.maximum(sizes[:, None], sizes[None, :])
    given = np.array(labels)
    enough = (common >= longer - np.floor((1 - SIMILARITY) * longer + 1e-9)) & (given[:, None] < given[None, :])
    root = {label: label for label in labels}

    def top(label):
        while root[label] != label:
            root[label] = label = root[root[label]]
        return label

    links = []
    for i, j in np.argwhere(enough).tolist():
        x, y = top(labels[i]), top(labels[j])
        if x != y and similar(texts[i], texts[j]):
            root[max(x, y)] = min(x, y)
            links.append((nodes[i], nodes[j]))
    return links


def linked_in_blocks(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: links that tie together all similar texts of each entry in ``parts`` (``entry, node, label``), however many they are.

    The texts of an entry are dealt out to blocks, those of a large component to blocks of their own, and any two blocks are compared
    unless both are of the same component.
    """
    measured = parts.join(texts.select("node", F.length("_text").alias("_chars")), "node")
    sizes = measured.groupBy("entry", "label").agg(F.count(F.lit(1)).alias("many"), F.sum("_chars").alias("chars"))
    need = F.greatest(F.col("many") / BLOCK, F.col("chars") / BLOCK_CHARS)
    mixed = sizes.groupBy("entry").agg(F.sum(F.when(need <= 1, F.col("many"))).alias("mixed"), F.sum(F.when(need <= 1, F.col("chars"))).alias("mixed_chars"))
    own = F.when(need > 1, F.col("label"))
    shared = F.greatest(F.col("mixed") / BLOCK, F.col("mixed_chars") / BLOCK_CHARS)
    deal = F.greatest(F.ceil(F.when(own.isNotNull(), need).otherwise(shared)), F.lit(1)).alias("deal")
    kinds = sizes.join(mixed, "entry").select("entry", "label", own.alias("own"), deal)
    by = F.when(F.col("own").isNotNull(), F.xxhash64("node")).otherwise(F.xxhash64("label"))
    block = F.xxhash64("entry", F.coalesce("own", F.lit(-1)), F.pmod(by, "deal")).alias("block")
    dealt = cut_lineage(parts.join(kinds, ["entry", "label"]).select("entry", "node", "label", "own", block))
    blocks = dealt.select("entry", "own", "block").distinct()
    first, second = (blocks.select("entry", F.col("own").alias(f"own_{x}"), F.col("block").alias(x)) for x in "ab")
    both = first.join(second, "entry").filter("a <= b and coalesce(own_a <> own_b, true)")
    tasks = both.select(F.xxhash64("a", "b").alias("task"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    compared = dealt.select("node", "label", "block").join(tasks, "block").join(texts, "node").select("task", "node", "label", "_text")

    def compare(table: pa.Table) -> pa.Table:
        links = forest(*(table.column(n).to_pylist() for n in ("node", "label", "_text")))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return compared.groupBy("task").applyInArrow(compare, "a long, b long")


def link(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, label`` of the linked texts, from ``members`` (``entry, node``) of table entries with several texts.

    First the texts of an entry are aligned with one of it.  In the
    entries that then hold several components all pairs of different components are decided: one by one in entries of up to
    SMALL texts; larger ones are divided by rare shingles first, and what is still larger is compared in blocks.
    """
    leaders = members.groupBy("entry").agg(F.min("node").alias("leader"))
    pairs = members.join(leaders, "entry").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    tried = cut_lineage(verified(pairs, texts))
    labels = components(tried.filter("linked").select("a", "b"))
    now = unsettled(members, labels).filter("n > 2")  # two texts were aligned with each other at once
    if now.isEmpty():
        return labels
    crowded = now.filter(F.col("n") > SMALL).select("node").distinct()
    divided = unsettled(cut_lineage(rare_entries(crowded, texts)), labels)
    few = now.unionByName(divided).filter(F.col("n") <= SMALL).drop("n")
    first, second = (few.select("entry", F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in "ab")
    pairs = first.join(second, "entry").filter("a > b and of_a <> of_b").select("a", "b").distinct()
    results = verified(pairs.join(tried, ["a", "b"], "left_anti"), texts)
    links = tried.unionByName(results).filter("linked").select("a", "b")
    return components(links.unionByName(linked_in_blocks(joined(divided.filter(F.col("n") > SMALL)), texts)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, digest, class_id, class_size, kept`` per row: the smallest id of its class, the rows in it, and whether it is the row that stays.

    The row with the smallest id, then digest, then place stays.
    """
    rows = cut_lineage(sketched(docs, key, text))
    nodes = rows.groupBy("_digest").agg(F.min("_row").alias("node"))
    texts = cut_lineage(rows.join(nodes, "_digest").filter("_row = node").select("node", "_id", "_digest", "_sketch"))
    entries = texts.select(F.explode("_sketch").alias("entry"), "node")
    shared = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(entries.join(shared, "entry"))
    involved = members.select("node").distinct().join(texts.select("node", "_id", "_digest"), "node")
    # The text of the row that stands for its equals: id and digest are spread evenly also where one text is very frequent.
    content = docs.select(F.col(key).alias("_of"), digest_of(text).alias("_key"), F.col(text).alias("_text"))
    same = F.col("_key").eqNullSafe(F.col("_digest")) & F.col("_of").eqNullSafe(F.col("_id"))
    found = cut_lineage(content.join(involved, same).select("node", "_text"))
    labels = link(members, found)
    placed = nodes.join(labels, "node", "left").select("_digest", F.coalesce("label", "node").alias("_class"))
    ids = cut_lineage(rows.select("_id", "_digest", "_row").join(placed, "_digest"))
    stays = F.min(F.struct(F.col("_id").isNull().alias("_no"), "_id", "_digest", "_row")).alias("_stays")
    classes = ids.groupBy("_class").agg(stays, F.count(F.lit(1)).alias("_size"))
    return ids.join(classes, "_class").select(
        F.col("_id").alias(key),
        F.col("_digest").alias("digest"),
        F.col("_stays._id").alias("class_id"),
        F.col("_size").alias("class_size"),
        (F.col("_row") == F.col("_stays._row")).alias("kept"),
    )
