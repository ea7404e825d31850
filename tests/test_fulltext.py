"""The full-text index against counts over the texts themselves, and stems against published ones."""

import math
import re

import pytest

from skein.functions.stems import stem
from skein.operators import fulltext as I

TEXTS = ["Deploy the server", "the deploys were slow, deploying again", "a server", "", None, "deploy deploy deploy the the", "Ünïcode 42 the"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def brute(texts, query, every=False, floored=False, stems=False):
    f = stem if stems else (lambda x: x)
    low = lambda s: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in s)
    split = {k: [f(w) for w in re.findall(r"[^\W_]+", low(t or ""))] for k, t in texts.items()}
    asked = list(dict.fromkeys(f(w) for w in re.findall(r"[^\W_]+", low(query))))
    n, avg, out = len(split), sum(map(len, split.values())) / len(split), {}
    for k, ws in split.items():
        held = [q for q in asked if q in ws]
        if not held or (every and len(held) < len(asked)):
            continue
        score = 0
        for q in held:
            df, tf = sum(q in x for x in split.values()), ws.count(q)
            odds = (n - df + 0.5) / (df + 0.5)
            score += (max(math.log(odds), 1e-6) if floored else math.log(1 + odds)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
        out[k] = round(score, 9)
    return out


def found(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


def test_search_upsert_remove_and_compaction(spark, docs):
    index, texts = I.build(docs, "id", "text"), dict(enumerate(TEXTS))
    for query in ("deploy server", "the", "nothing", "Ünïcode"):
        assert found(I.search(spark, index, query)) == brute(texts, query)
    assert found(I.search(spark, index, "deploy server", every=True)) == brute(texts, "deploy server", every=True)
    assert found(I.search(spark, index, " ,")) == {}
    changed = spark.createDataFrame([(0, "now a client"), (9, "server server"), (5, None)], "id long, text string")
    later, want = I.upsert(index, changed, "text"), texts | {0: "now a client", 9: "server server", 5: None}
    assert found(I.search(spark, later, "deploy server")) == brute(want, "deploy server")
    assert found(I.search(spark, index, "deploy server")) == brute(texts, "deploy server")  # readers of the old one see the old one
    last = I.remove(later, spark.createDataFrame([(2,), (77,)], "id long"))
    want = {k: v for k, v in want.items() if k != 2}
    assert found(I.search(spark, last, "deploy server")) == brute(want, "deploy server") == found(I.search(spark, I.compacted(spark, last), "deploy server"))


def test_turns_are_found_by_stems(spark, docs):
    index = I.build(docs, "id", "text", stems=True)
    got = I.search_turns(spark, index, docs, "Deployed", 2)
    want = brute(dict(enumerate(TEXTS)), "Deployed", True, True, True)
    assert len(want) == 3 and found(got) == dict(sorted(want.items(), key=lambda x: (-x[1], x[0]))[:2])
    assert found(I.search(spark, I.build(docs.limit(0), "id", "text"), "deploy")) == {}


def test_stems():
    # examples of the published paper
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope sensibiliti sensibl triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust adoption adopt communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert {a: stem(a) for a in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))
    assert stem("Ünïcode".lower()) == stem("unicode") and stem("is") == "is" and stem("") == ""


def test_documents_are_counted_where_their_texts_are_dealt(spark):
    """Each word of each document was shuffled to count it; texts are now dealt by key, and nothing else is."""
    from skein.operators import fulltext

    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "B")], "id long, body string")
    got = fulltext._counted(fulltext.Index("id", "bigint", False), docs, "body")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 3, "a", 2), (1, 3, "b", 1), (3, 1, "b", 1)]
