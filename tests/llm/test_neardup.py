import random
import re

import numpy as np
import pytest

from skein.llm.components import components
from skein.llm.neardup import Settings, Sketcher, estimate, near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """doc_id -> (n_shingles, component_id), for rows with different ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    passage = " ".join(word() for _ in range(60))
    rows, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(30, 300))]
        for _ in range(rnd.randint(1, 5)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 30))):
                own[rnd.randrange(len(own))] = word()
            rows.append((i := i + 1, (" " if rnd.random() < 0.5 else "\n").join(own)))
    for _ in range(40):
        rows.append((i := i + 1, passage + " " + " ".join(word() for _ in range(rnd.randint(5, 200)))))
    big = [word() for _ in range(200)]
    for _ in range(120):  # a large group of near copies
        own = list(big)
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(len(own))] = word()
        rows.append((i := i + 1, " ".join(own)))
    chain = [word() for _ in range(400)]
    for k in range(0, 200, 8):  # each links with the next only
        rows.append((i := i + 1, " ".join(chain[k : k + 150])))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a b c"), (1004, "A  B\tC"), (1005, "a b c d"), (1006, "x " * 5000), (1007, "x " * 7), (1008, "é" * 100_000), (-5, "a b c")]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def result(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in corpus()], "doc_id long, text string, kept boolean").repartition(6)
    return {r.doc_id: r for r in near_duplicates(docs).collect()}


def test_components_equal_brute_force(result):
    want = brute(corpus())
    assert {i: (r.n_shingles, r.component_id) for i, r in result.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in result.values())


def test_null_ids_repeated_rows_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (7, text), (7, text), (None, "alone in its own component here"), (None, None), (3, "q")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("3", 1, "3", True), ("7", 26, "7", True), ("7", 26, "7", True), ("None", 0, "None", False), ("None", 2, "None", False), ("None", 26, "7", False)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimates_follow_similarity():
    s, rng = Settings(), np.random.default_rng(5)
    sketcher = Sketcher(s)
    for j in (0.3, 0.6, 0.75, 0.9):
        pairs = []
        for _ in range(60):
            n = 2000
            common = int(n * 2 * j / (1 + j))
            pool = rng.integers(0, 1 << 63, 2 * n - common, np.uint64)
            pairs.append((sketcher.registers(pool[:n]), sketcher.registers(pool[n - common :])))
        a, b = (np.array([p[k] for p in pairs]) for k in (0, 1))
        got = estimate(a, b, np.full(60, 2000.0), np.full(60, 2000.0), s.base)
        assert abs(got.mean() - j) < 0.02 and got.std() < 0.05


def test_registers_merge():
    sketcher, rng = Sketcher(Settings()), np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 63, 900, np.uint64), rng.integers(0, 1 << 63, 50, np.uint64)
    both = sketcher.registers(np.concatenate([x, y]))
    assert (both == np.maximum(sketcher.registers(x), sketcher.registers(y))).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 40)] + [(9, 9), (701, 700)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{500 + i: 500 for i in range(40)}, 700: 700, 701: 700}


def test_a_hot_bucket_in_small_blocks(spark):
    """Many texts that share most shingles, so that buckets are far larger than a block, and links that no leader finds."""
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rnd.choice((2, 9, 10, 11))):
            own[rnd.randrange(len(own))] = f"v{rnd.randint(0, 40)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for settings in (Settings(block=16, salts=4), Settings(block=7, bands=120, rows=2, salts=2)):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, settings).collect()} == want
