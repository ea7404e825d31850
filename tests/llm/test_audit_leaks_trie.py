import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import pytest

from skein.llm import trie
from skein.llm.audit import filter_audit
from skein.llm.decontam import contamination, decontaminate
from skein.llm.trie import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audit_brute(docs, labels):
    least = {}
    for d in docs:
        if d["doc_id"] is not None:
            least[d["text"] or ""] = min(least.get(d["text"] or "", d["doc_id"]), d["doc_id"])
    good = {x for x, q, _ in labels if q == 1 and x is not None}
    toxic = {x for x, _, t in labels if t == 1 and x is not None}
    parts = defaultdict(list)
    for d in docs:
        t = d["text"] or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d["doc_id"] is not None and d["doc_id"] > least[t]}
        parts[d["source"] or ""].append((d["doc_id"], {f for f in fails if fails[f]}))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for s, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                fails = [r for r in rows if f in r[1]]
                out[part, "".join(order), s + 1] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                out[part, "".join(order), s + 1].append(shapley[f])
    return out


def audit_docs():
    rnd = random.Random(4)
    long_ = [" ".join(f"w{rnd.randint(0, k)}" for _ in range(220)) for k in (40, 400, 4000)]
    texts = [None, "", "A", "é|", *long_, long_[1].upper(), long_[2] + " $", "z" * 400_000, "x " * 100_000]
    rows = [(i, rnd.choice(texts), rnd.choice([None, "", "a", "b", "hot", "hot"])) for i in range(300)]
    rows += [(None, "", "a"), (None, long_[1], "a"), (3, rows[3][1], rows[3][2]), (3, "", "b"), (7, rows[7][1], "other")]
    return [{"doc_id": a, "text": b, "source": c} for a, b, c in rows]


def test_audit_equals_brute_force(spark):
    docs = audit_docs()
    labels = [(i, i % 3, i % 2) for i in range(0, 200, 2)] + [(5, None, 1), (5, 1, None), (None, 1, 1), (999, 1, 1)]
    rows = [(d["doc_id"], d["text"], d["source"], "clash", 1) for d in docs]
    got = filter_audit(spark.createDataFrame(rows, "doc_id long, text string, source string, mask string, n int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == audit_brute(docs, labels)
    assert len(got) == 600 * len({d["source"] or "" for d in docs})


def test_audit_of_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(spark.createDataFrame([], "doc_id long, text string, source string"), none).collect() == []
    got = filter_audit(spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string"), none).collect()
    assert len(got) == 600 and sum(r.good_lost + r.toxic_lost for r in got) == 0


LOWER = {a: a + 32 for a in range(65, 91)}
LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks_brute(docs, items):
    words = lambda t: LEAK_WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leak_rows(short):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "日本", "x9"]
    some = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, some(rnd.randint(11, 40))) for i in range(40)] + [(40, "alpha beta " * 9), (41, None), (42, " ;"), (3, some(12)), (None, some(15)), (77, "Same, words-as ANOTHER " + some(10)), (78, "same words as another " + some(10))]
    if short:
        items += [(50, "solo"), (51, "two words"), (52, "exactly three words"), (53, some(7)), (54, "four words it is"), (55, "solo")]
    docs = [(i, "\n".join([some(rnd.randint(0, 60)), rnd.choice(items)[1] or "", some(3), "solo two words"[: rnd.choice([0, 4, 14])]])) for i in range(150)]
    hot = items[0][1] + " - " + items[1][1].upper()
    docs += [(1000 + i, hot) for i in range(100)] + [(1, hot), (None, "the four words it is"), (2000, None), (2001, ""), (2002, "alpha beta " * 3000), (2003, "a" * 300_000 + " " + hot), (2004, "exactly, three words!")]
    return docs, items


@pytest.mark.parametrize("short", [False, True])
def test_leaks_equal_brute_force(spark, short):
    docs, items = leak_rows(short)
    table = spark.createDataFrame([(a, b, "clash", 0) for a, b in docs], "doc_id long, text string, token string, rid int").repartition(3)
    got = decontaminate(table, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == leaks_brute(docs, items)


def test_leaks_without_items_or_documents(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in decontaminate(docs, items).collect()) == [(1, 2, 0, 0, nothing, False), (2, 0, 0, 0, nothing, False)]
    assert decontaminate(docs.filter("false"), docs.selectExpr("doc_id item_id", "text")).collect() == []


def test_hits_tell_windows_and_places(spark):
    text = " ".join(f"n{i}" for i in range(12))
    rows, hits, items = contamination(spark.createDataFrame([(5, "before " + text)], "doc_id long, text string"), spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert sorted((r.start, r.n) for r in hits.collect()) == [(1, 10), (2, 10), (3, 10)]
    assert {r.item for r in hits.join(items, "wid").collect()} == {"1"}


def trie_brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((m[0], len(n), members[n[:-1]][0] if n else -1, len(m), children.get(n, 0), leaves[n], saved[n], digest(ends.get(n, []))) for n, m in members.items())


def trie_rows():
    rnd = random.Random(3)
    rows = []
    for c in range(160):
        seed = rnd.randint(0, 6)
        steps = random.Random(seed)
        cut = rnd.randint(0, 30)
        for turn in range(rnd.choice([1, 2, 5, 9, 40])):
            text = steps.choice(["a", "é", "", "long text"]) if turn < cut else rnd.choice("abc")
            rows.append((c, turn, ["user", "assistant"][turn % 2], text))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(120) for t in range(12)]
    rows += [(5003, None, "user", "first"), (5003, 1, None, None), (5003, 1, "", ""), (5003, 1, "user", "b"), (5003, 1, "user", "a"), (5003, None, None, "x")]
    rows += [(7000, t, "user", "deep") for t in range(300)] + [(7001, t, "user", "deep" if t < 250 else "other") for t in range(280)] + [(None, 0, "user", "nobody's")]
    rows += [(9000 + 5 * k, t, "u", f"comb {t}" if t < 3 * k else f"tooth {k}") for k in range(12) for t in range(3 * k + 2)]
    return rows


@pytest.mark.parametrize("block", [3, 4096])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = trie_rows()
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, pos int").repartition(5)
    got = prefix_trie(table)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got.collect()) == trie_brute(rows)


def test_light_paths_have_half_the_members(spark):
    convs, rows = trie.rebuilt(spark.createDataFrame([(c, t, "u", str(c % (t + 2))) for c in range(40) for t in range(6)], "conv long, turn long, role string, text string"))
    nodes, _ = trie._nodes(rows, convs)
    largest = {}
    for r in nodes.collect():
        key = (r.pconv, r.depth - 1)
        largest.setdefault(key, []).append(r.n_convs)
    members = {(r.conv, r.depth): r.n_convs for r in nodes.collect()}
    for key, sizes in largest.items():
        if key in members:
            assert all(2 * n <= members[key] for n in sorted(sizes)[:-1])


def test_trie_of_little(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], kind)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], kind)).collect() == []
    rows = [(4, 0, "u", "x")]  # crc32("4") % 9 turns of conversation 0, which isn't there
    assert sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie(spark.createDataFrame(rows, kind)).collect()) == trie_brute(rows)
