import itertools
import random

import numpy as np
import pytest

from conftest import ODD, document
from lumbre.llm import near_dedup as N
from lumbre.llm.components import components


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def changed(rng, items, many, fresh):
    items = list(items)
    for _ in range(many):
        at = rng.randint(0, len(items))
        kind = rng.random()
        if kind < 0.4 and items:
            items[at % len(items)] = fresh()
        elif kind < 0.7:
            items.insert(at, fresh())
        elif items:
            del items[at % len(items)]
    return items


def test_banded_alignment_is_exact():
    rng = random.Random(5)
    for _ in range(1500):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = changed(rng, a, rng.randint(0, 6), lambda: rng.randint(0, 3))
        for limit in range(8):
            assert N.within(a, b, limit) == (edits(a, b) <= limit)


def test_similarity_is_that_of_the_whole_alignment():
    rng = random.Random(6)
    for _ in range(60):
        words = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(5, 60))]
        a, b = " ".join(words), " ".join(changed(rng, words, rng.randint(0, 4), lambda: "new"))
        x, y = N.shingles(a), N.shingles(b)
        assert N.similar(a, b) == bool(x and y and edits(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9)


def test_order_matters():
    words = [f"w{i}" for i in range(200)]
    halves = words[100:] + words[:100]
    assert not N.similar(" ".join(words), " ".join(halves))
    same = (N.sketch(" ".join(words)) == N.sketch(" ".join(halves))).mean()
    near = (N.sketch(" ".join(words)) == N.sketch(" ".join(words[:99] + ["x"] + words[100:]))).mean()
    assert near > 0.6 > 0.2 > same


def corpus(rng):
    """Texts with chains of near copies, exact copies, and a passage that many share."""
    fresh = lambda: f"w{rng.randint(0, 5000)}"
    passage = " ".join(fresh() for _ in range(60))
    texts = [" ".join(fresh() for _ in range(rng.randint(30, 200))) for _ in range(40)]
    for text in list(texts):
        for _ in range(rng.randint(0, 4)):
            words = text.split()
            text = " ".join(changed(rng, words, rng.randint(0, max(1, len(words) // 25)), fresh))
            texts.append(text)
    texts += texts[:10] + [f"{passage} {' '.join(fresh() for _ in range(40))}" for _ in range(30)]
    return [document(i, t) for i, t in enumerate(texts)]


def classes(rows):
    label = {i: i for i, *_ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, a, *_), (j, b, *_) in itertools.combinations(rows, 2):
        if a == b or N.similar(a, b):
            label[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in label}


def test_classes_equal_brute_force(table):
    rows = corpus(random.Random(8))
    want = classes(rows)
    found = N.near_duplicates(table(rows, files=4)).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == want
    size = {i: list(want.values()).count(c) for i, c in want.items()}
    assert {r["doc_id"]: r["class_size"] for r in found} == size
    assert sorted(r["doc_id"] for r in found if r["kept"]) == sorted(set(want.values()))


def test_recall_on_the_given_documents(spark, sf_dir):
    """All pairs of documents that share a fifth of their shingles, aligned one by one."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sets = {r["doc_id"]: set(N.shingles(r["text"] or "")) for r in rows}
    texts = {r["doc_id"]: r["text"] for r in rows}
    where = {}
    for i, shingles in sets.items():
        for s in shingles:
            where.setdefault(s, []).append(i)
    pairs = {p for ids in where.values() if len(ids) < 100 for p in itertools.combinations(ids, 2)}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) and N.similar(texts[a], texts[b])]
    class_of = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    together = sum(class_of[a] == class_of[b] for a, b in near)
    assert len(near) > 50 and together >= 0.99 * len(near)


def edited(rng, words, edits):
    """Every edit replaces a word, far from the others, so it changes five shingles."""
    words = list(words)
    for at in rng.sample(range(5, len(words) - 5, 5), edits):
        words[at] = f"n{rng.randint(0, 10**9)}"
    return " ".join(words)


def test_star_of_many_copies_is_one_class(table):
    """Copies are similar to their base, hardly ever to each other."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(204)]
    texts = [edited(rng, base, rng.randint(6, 7)) for _ in range(3000)]
    texts.insert(1500, " ".join(base))
    own = N.sketch(texts[1500])
    want = {i for i, t in enumerate(texts) if i == 1500 or (N.sketch(t) == own).any() and N.similar(t, texts[1500])}
    label = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(table([document(i, t) for i, t in enumerate(texts)], files=4)).collect()}
    assert len(want) > 2900 and {label[i] for i in want} == {label[1500]}


def test_similar_short_texts_always_meet():
    rng = random.Random(14)
    met = 0
    for _ in range(20_000):
        words = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 53))]
        a, b = " ".join(words), " ".join(changed(rng, words, rng.randint(1, 2), lambda: "new"))
        if N.similar(a, b):
            met += 1
            assert np.isin(N.sketch(a), N.sketch(b)).any(), (a, b)
    assert met > 1000
    added = "a b c d e f g h"
    assert N.similar(added, added + " i") and np.isin(N.sketch(added), N.sketch(added + " i")).any()


def test_chain_in_a_large_entry_is_one_class(spark):
    """Only neighbours in the chain are similar; everything lies in one entry."""
    rng = random.Random(13)
    texts = [[f"w{i}" for i in range(204)]]
    for _ in range(39):
        texts.append(edited(rng, texts[-1], 7).split())
    texts += [[f"o{k}_{i}" for i in range(100)] + texts[0][:20] for k in range(40)]
    order = rng.sample(range(80), 80)
    rows = [(order[i], " ".join(t)) for i, t in enumerate(texts)]
    members = spark.createDataFrame([(1, node) for node, _ in rows], "entry long, node long")
    label = {r["node"]: r["label"] for r in N.link(members, spark.createDataFrame(rows, "node long, _text string")).collect()}
    want = classes(sorted(rows))
    assert len({want[i] for i in order[:40]}) == 1 and {i: label.get(i, i) for i in want} == want


def test_blocks_by_characters_tie_the_same(spark, monkeypatch):
    """Blocks of a few texts, and texts longer than a block, still meet each other."""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(204)]
    texts = [base, *(edited(rng, base, 7).split() for _ in range(30)), *([f"o{k}_{i}" for i in range(60)] for k in range(20))]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(N, "BLOCK_CHARS", 1500)
    parts = spark.createDataFrame([(1, i, i) for i, _ in rows], "entry long, node long, label long")
    links = N.linked_in_blocks(parts, spark.createDataFrame(rows, "node long, _text string")).collect()
    want, found = classes(rows), {i: i for i, _ in rows}
    for a, b in sorted((r["a"], r["b"]) for r in links):
        low, high = sorted((found[a], found[b]))
        found = {i: low if x == high else x for i, x in found.items()}
    assert found == want


def test_forest_ties_what_brute_force_ties():
    rng = random.Random(12)
    rows = sorted({d[1]: d for d in corpus(rng)}.values())
    texts = [t for _, t, *_ in rows]
    links = N.forest(list(range(len(texts))), list(range(len(texts))), texts)
    label = {i: i for i in range(len(texts))}
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        assert low != high and N.similar(texts[a], texts[b])
        label = {i: low if c == high else c for i, c in label.items()}
    assert label == classes([(i, t) for i, t in enumerate(texts)])


def test_odd_rows(odd):
    rows = N.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    of = lambda i: {(r["class_id"], r["class_size"]) for r in rows if r["doc_id"] == i}
    assert of(3) == of(None) == {(3, 3)} and of(1) == {(1, 3)} and of(2) == {(1, 3)} and of(4) == {(4, 1)}
    assert sum(r["kept"] for r in rows) == len({t or "" for _, t, *_ in ODD})


def test_empty_table(table):
    assert N.near_duplicates(table([])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    label = {i: i for e in links for i in e}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    linked = {i for a, b in links if a != b for i in (a, b)}
    assert found == {i: label[i] for i in linked}


def test_a_round_of_components_reads_links_once_per_step(spark, capsys):
    """Every further copy of a step in the plan of a round is tasks and plan nodes that the driver keeps track of."""
    from lumbre.llm import components as C

    links = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (5, 3), (9, 8)], "a long, b long")
    got = C._near(C._far(links))
    capsys.readouterr()
    got.explain()
    assert capsys.readouterr().out.count("Join ") == 3
    assert {tuple(r) for r in got.collect()} == {(2, 1), (3, 1), (5, 1), (9, 8)}
