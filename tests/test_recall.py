import random
import re

import pytest

from skein.functions import score as S
from skein.operators import postings as P
from skein.operators.recall import Scope, recall

WORD = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["rare"]
    rows = [(i, " ".join(rnd.choices(words[:60], [60 - j for j in range(60)], k=rnd.randint(0, 40))), rnd.choice(["alpha", "beta gamma", None])) for i in range(1500)]
    rows = [(i, t + (" rare" if i % 400 == 7 else ""), s) for i, t, s in rows] + [(2000, None, None), (2001, "", "x" * 300)]
    table = spark.createDataFrame(rows, "id long, text string, name string").repartition(3)
    return rows, P.build(table, "id", ["text", "name"])


def bm25(rows, query, k):
    import math

    fields = [[WORD.findall((r[f] or "").lower()) for r in rows] for f in (1, 2)]
    score = [0.0] * len(rows)
    for lists in fields:
        average = sum(map(len, lists)) / len(lists)
        for q in dict.fromkeys(WORD.findall(query.lower())):
            df = sum(q in w for w in lists)
            for i, w in enumerate(lists):
                tf = w.count(q)
                if tf:
                    score[i] += math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
    return [(r[0], round(s, 6)) for s, r in sorted(((s, r) for s, r in zip(score, rows) if s), key=lambda x: (-round(x[0], 9), x[1][0]))][:k]


@pytest.mark.parametrize("query", ["rare w0", "w0 w1 beta", "w59 gamma rare", "unknown", "w3"])
@pytest.mark.parametrize("k", [1, 10])
def test_top_equals_scoring_all(corpus, query, k):
    rows, index = corpus
    got = sorted(P.search(index, query, k).collect(), key=lambda r: (-r.score, r.id)) if query != "unknown" else []
    assert [(r.id, round(r.score, 6)) for r in got] == bm25(rows, query, k)


def test_blocks_are_skipped(corpus, spark):
    _, index = corpus
    assert P.top(index, "unknown", 5).blocks == 0
    rows = [(i, "common " * (i % 3 + 1) + ("needle" if i in (5, 900, 901, 5000) else "filler")) for i in range(6000)]
    large = P.build(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", ["text"], near=False)
    best = P.top(large, "common needle", 3, probe=4)
    assert best.scored < best.blocks / 2
    doc = {r.doc: r.id for r in large.documents.collect()}
    assert [doc[r.doc] for r in best.rows.collect()] == [x[0] for x in bm25([(*r, None) for r in rows], "common needle", 3)]


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_osa_distance(spark):
    rnd = random.Random(1)
    pairs = [("".join(rnd.choices("abé", k=rnd.randint(0, 7))), "".join(rnd.choices("abé", k=rnd.randint(0, 7)))) for _ in range(300)] + [("ca", "abc"), ("abcd", "bacde")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.osa_distance(S.F.col("a"), S.F.col("b")).alias("d")).collect()
    assert all(r.d == osa(r.a, r.b) for r in got)


def test_near_terms_equal_brute_force(spark):
    rnd = random.Random(8)
    terms = {"".join(rnd.choices("abcd", k=rnd.randint(1, 10))) for _ in range(400)} | {"z" * 39 + "q", "z" * 41, "z" * 43}
    index = P.build(spark.createDataFrame(enumerate(terms), "id long, text string"), "id", ["text"])
    tokens = {"abcd": 1, "abcdabcd": 2, "dcba": 1, "ddddcccc": 2, "z" * 41: 2}
    got = {(r.token, r.term) for r in P.near_terms(index, tokens).collect()}
    assert got == {(x, t) for x, d in tokens.items() for t in terms if osa(t, x) <= d}


def test_fuzzy_only_if_nothing_is_found(corpus):
    rows, index = corpus
    assert P.fuzzy_tokens("the Wrng_x ab éé documentation") == {"wrng_x": 1, "éé": 1, "documentation": 2}
    found = [r.id for r in P.search(index, "rarre aplha", 3000).collect()]
    assert set(found) <= {r[0] for r in rows if "rare" in (r[1] or "") or r[2] == "alpha"} and {7, 407, 807, 1207} <= set(found)


def test_empty_index(spark):
    index = P.build(spark.createDataFrame([], "id long, text string"), "id", ["text"])
    assert P.search(index, "anything here", 3).collect() == [] and P.search(index, "", 3).collect() == []


CODE = {
    "src/auth.rs": "use std::env;\n\n/// Checks a signed token and its expiry.\nfn verify_token(t: &str) -> bool {\n    decode(t)\n}\n\nfn decode(t: &str) -> bool { true }\n",
    "src/store.rs": "// Rows of users.\nfn fetch_users() { open_pool() }\n\nfn open_pool() {}\n",
    "web/view.ts": "// Paints the table of invoices.\nexport function renderInvoices() { fetch('/users') }\n",
}
NODES = [("auth::verify_token", "src/auth.rs", 4, 6), ("auth::decode", "src/auth.rs", 8, 8), ("store::fetch_users", "src/store.rs", 2, 2), ("store::open_pool", "src/store.rs", 4, 4), ("view::renderInvoices", "web/view.ts", 2, 2)]
EDGES = [("auth::verify_token", "auth::decode", "calls"), ("store::fetch_users", "store::open_pool", "calls"), ("view::renderInvoices", "store::fetch_users", "calls"), ("auth::verify_token", "std::env", "imports")]
FACTS = [(1, "Deploys go out on Tuesdays after the smoke tests.", ["release"]), (2, "Staging shares its database with the demo site.", ["Infra", "database"]), (3, "The invoice numbers are issued by the ledger service.", ["billing"])]
LESSONS = [(1, "when a migration locks the table", "run it in batches at night"), (2, "before renaming a column", "look for readers in the dashboards")]
PREFERENCES = [(1, "I prefer short commit messages."), (2, "Never push on Fridays.")]
GOLD = [
    ("how does verify_token work", "fn verify_token"), ("auth::decode", "fn decode"), ("fetch users from the pool", "fn fetch_users"), ("renderInvoices", "renderInvoices"), ("when do deploys happen on tuesdays", "Tuesdays"),
    ("which database does staging use", "Staging shares"), ("migration locks", "in batches"), ("renaming column", "readers in the dashboards"), ("commit messages style", "short commit"), ("who issues invoice numbers", "ledger service"),
]


@pytest.fixture(scope="module")
def tables(spark):
    lines = {p: t.split("\n") for p, t in CODE.items()}
    chunks = [(f"{p}:{a}-{b}", p, s, a, b, "\n".join(lines[p][a - 1 : b])) for s, p, a, b in NODES]
    index = P.build(spark.createDataFrame(chunks, "id string, path string, symbol string, start_line int, end_line int, body string"), "id", ["body", "symbol"])
    return index, dict(
        nodes=spark.createDataFrame(NODES, "id string, path string, start_line int, end_line int"), edges=spark.createDataFrame(EDGES, "src string, dst string, kind string"), files=spark.createDataFrame(CODE.items(), "path string, text string"),
        facts=spark.createDataFrame(FACTS, "n long, text string, tags array<string>"), lessons=spark.createDataFrame(LESSONS, "n long, trigger string, advice string"), preferences=spark.createDataFrame(PREFERENCES, "n long, text string"),
    )


def test_gold_set(tables):
    index, rest = tables
    five = three = 0
    for asked, expected in GOLD:
        bodies = [r.body for r in sorted(recall(index, asked, **rest).collect(), key=lambda r: (-r.score, r.id))]
        five += any(expected in b for b in bodies[:5])
        three += any(expected in b for b in bodies[:3])
    assert five >= 8 and three >= 6


def test_bodies_and_context(tables):
    index, rest = tables
    got = {r.symbol: r for r in recall(index, "auth::verify_token", **rest).collect()}
    one = got["auth::verify_token"]
    assert one.stage == "symbol" and one.body.startswith("fn verify_token") and one.body.rstrip().endswith("}")
    assert one.preview == "fn verify_token(t: &str) -> bool { ⏎ decode(t) ⏎ }"
    assert (one.callers, one.callees, one.siblings, one.imports) == ([], ["auth::decode"], ["auth::decode"], ["std::env"])
    assert one.doc == "Checks a signed token and its expiry."
    assert got["auth::decode"].callers == ["auth::verify_token"]


def test_scope(tables):
    index, rest = tables
    ask = lambda **s: {(r.path, r.symbol) for r in recall(index, "users invoices fetch database staging", scope=Scope(**s), **rest).collect()}
    everything = ask()
    assert ask(languages=("rust",)) == {x for x in everything if x[0].endswith((".rs", ".md"))}
    assert ask(paths=("web/",)) <= {("web/view.ts", "view::renderInvoices")} | {x for x in everything if x[1] is None}
    assert all(s is None or "pool" in s.lower() for _, s in ask(symbols=("POOL",)))
    assert ("MEMORY.md", None) in ask(tags=("INFRA",)) and ("MEMORY.md", None) not in ask(tags=("release",))


def test_mistyped_query_and_nothing(tables):
    index, rest = tables
    assert any("fn fetch_users" in r.body for r in recall(index, "ftech uesrs", **rest).collect())
    assert recall(index, "zz", **rest).collect() == []
    assert recall(index, "users", least=9.0, **rest).collect() == []


def test_a_long_word_has_no_more_rests_than_a_short_one(spark):
    """Every rest of a word of up to 40 letters was written: 821 rows for one of them."""
    rnd = random.Random(3)
    long_ = ["".join(rnd.choices("abcdefgh", k=40)) for _ in range(5)]
    typed = [x[:3] + x[4:] for x in long_] + [x[:5] + x[6] + x[5] + x[7:-1] for x in long_] + ["q" + x for x in long_]
    index = P.build(spark.createDataFrame(enumerate(long_), "id long, text string"), "id", ["text"])
    assert index.read("rests").count() <= len(long_) * (1 + P.PREFIX + P.PREFIX * (P.PREFIX - 1) // 2)
    got = {(r.token, r.term) for r in P.near_terms(index, dict.fromkeys(typed, 2)).collect()}
    assert got == {(x, t) for x in typed for t in long_ if osa(t, x) <= 2} and len(got) >= len(typed)
