import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import html as H
from skein.llm.html import Blocks, Settings, content_paths, extract_pages, main_text, path_ratios, smoothed
from skein.llm.langid import Encoder, Profile, held_out, letter_vectors, predict, train
from skein.llm.mixing import MixSettings, fit_rates, labelled_domains, mix, mixed

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Menu one</a><li><a>Two</a></ul></nav><div class="ad">Buy, now. Really.</div>
<div class="cookie-notice">We use cookies, all right.</div>
<article><header><h1>A title &amp; more</h1></header><p><b>First   <i>para</i>graph,
 with text &lt;here&gt;.<br>After a break.<p>Second &eacute; &#x263A; paragraph. It goes on, and on.<ul><li>one<li>two</ul>
<div class="share"><a>Tweet</a></div><form><label>Name</label><input><button>Send</button></form></article>
<aside>Side story, long enough. To be text.</aside><section id="comments"><p>Great post, thanks! I liked it.</p></section>
<footer>&copy; site</footer>"""
WANT = "A title & more First paragraph, with text <here>. After a break. Second é ☺ paragraph. It goes on, and on. one two"


def test_article_alone_is_kept():
    assert main_text(PAGE) == WANT


def test_pages_that_do_not_mark_their_article():
    body = "".join(f"<p>Sentence number {i}, which is long enough to be content. And another one, too.</p>" for i in range(9))
    page = f"<body><div id=nav><a>x</a> <a>y</a></div><div class=story><h2>Head</h2>{body}</div><div class=footer>Bye, now.</div><table><tr><td><a href=1>link</a></table></body>"
    got = main_text(page)
    assert got.count("Sentence number") == 9 and "link" not in got and "Bye" not in got and "x" not in got.split()


def test_an_advert_in_an_inline_element_leaves_its_siblings():
    for inner in ('<a class="related" href=x><p>Other story.</p></a>', '<span class="notice"><p>Other story.</p></span>'):
        assert main_text(f"<article><p>First, text.</p>{inner}<p>Second, text.</p></article>") == "First, text. Second, text."


def test_a_marked_article_is_kept_whole():
    long = "word, " * 100 + "end."
    cells = "".join(f"<tr><th>h{i}<td>{i}%" for i in range(20))
    sources = "".join(f"<li><a href=x>Source {i}</a>" for i in range(9))
    page = f"<nav><a>Menu</a></nav><article><h1>T</h1><p>{long}</p><p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.<p>{long}<p>{long}<table>{cells}</table><figure><figcaption>Cap</figcaption></figure><ol>{sources}</ol></article>"
    got = main_text(page)
    want = ["T", long, "Where x=1 holds.", long, long, *(w for i in range(20) for w in (f"h{i}", f"{i}%")), "Cap", *(f"Source {i}" for i in range(9))]
    assert got == " ".join(want)
    assert main_text("<article><a href=x>Source</a></article><nav><a>Menu</a></nav>") == "Source"
    assert main_text(f"<article><a href=x>Other story</a></article><div><p>{long}</div>") == long


def test_names_of_an_articles_parts():
    page = """<div class="page-header">Site, name.</div><article><header class="entry-header"><h1 class="entry-header">Title</h1></header><div class="article-header">Sub, title.</div>
    <section id="discussion"><h2 id="related-work">Related <span id="search">work</span></h2><p>Text, one.</p></section><section id="search-methods"><p class="hidden-markov">Text, two.</p></section>
    <section class="related"><p>Other, story.</p></section><div class="share_buttons">Share, it.</div><div id="comments"><p>Nice, one.</p></div><div class="box related-posts">More, stories.</div><h2 hidden>Unseen</h2></article>"""
    assert main_text(page) == "Title Sub, title. Related work Text, one. Text, two."


def test_odd_pages(spark):
    rows = [(1, "u", None, "c"), (2, None, "", "c"), (None, "u", "plain, text.", "c"), (4, "u", "<p>a<![if x]>b</p", "c"), (5, "u", "<!x <a", "c"), (6, "u", "<p>" * 3000 + "deep, text.", "c"), (7, "u", PAGE, None), (7, "u", PAGE, None), (8, "u", "<article>" + "word, " * 200_000, "c")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[None] == "plain, text." and by[6] == "deep, text." and by[7] == WANT and by[8].count("word") == 200_000
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


BARE = (
    "<body><div><ul><li><a href=1>Home, sweet</a><li><a href=2>News, old</a></ul></div><div><h1>Title</h1>"
    + "".join(f"<p>Sentence {i}, which is long enough to be content. " + "And another one, too. " * 12 + "</p>" for i in range(6))
    + "<ol><li>one<li>two</ol></div><div>Copyright, 2020.</div>"
)


def test_the_ratio_decides():
    sidebar = "<article><h1>T</h1><p>A paragraph, which is long enough. It goes on.</p><div class=sidebar>Other, things.</div><aside>More of it.</aside><p>The end, of it.</p></article>"
    for page in (PAGE, BARE, sidebar):
        assert main_text(page) != main_text(page, Settings(threshold=0.0))
    assert main_text(sidebar) == "T A paragraph, which is long enough. It goes on. The end, of it."
    # neither marks nor classes nor ids
    got = main_text(BARE)
    assert got.startswith("Title Sentence 0") and got.endswith("too. one two")
    # an article that says little beside a long text isn't the page's
    long = "A sentence, among many. " * 40
    assert main_text(f"<div><p>{long}</p></div><article><a href=x>Teaser</a></article>") == long.strip()


def test_path_sums_equal_brute_force():
    """Sums over well-formed pages by a parser of four lines, and the fused ratios from them a path at a time."""
    import re

    rnd = random.Random(6)

    def tree(depth):
        tag = rnd.choice(["div", "p", "section", "article", "ul", "aside"] if depth < 4 else ["p"])
        if tag == "p" or depth > 5:
            text = " ".join(rnd.choice(["word", "and,", "so.", "long words"]) for _ in range(rnd.randint(1, 30)))
            return f"<p>{text} <a>{'link' * rnd.randint(0, 3)}</a></p>"
        return f"<{tag}>" + "".join(tree(depth + 1) for _ in range(rnd.randint(1, 4))) + f"</{tag}>"

    chosen = 0
    for _ in range(60):
        page, stack, want = tree(0) + tree(0), [], {}
        for end, tag, text in re.findall(r"<(/?)(\w+)>([^<]*)", page):
            stack.pop() if end else stack.append(tag)
            if stack and stack[-1] in ("p", "a") and text:
                key = "/".join(t for t in stack if t != "a")
                sums = want.setdefault(key, [0, 0, 0, 0])
                if stack[-1] == "p" and not end:
                    sums[0] += 1
                    sums[1] += len(text.strip())
                    sums[2] += len(re.findall("[.,]", text))
                if stack[-1] == "a":
                    sums[1] += len(text) + 1 if text else 0
                    sums[3] += len(text)
        parser = Blocks()
        parser.feed(page)
        parser.close()

        def name(k):
            return (name(parser.paths[k].parent) + "/" if parser.paths[k].parent > 0 else "") + parser.paths[k].tag

        order = list(dict.fromkeys(k for k, _ in parser.blocks))
        got = {name(k): [p.nodes, p.chars, p.marks, p.linked] for k in order for p in [parser.paths[k]]}
        assert got == want
        text, marks = [want[name(k)][1] / want[name(k)][0] for k in order], [(want[name(k)][2] + 0.5) / want[name(k)][0] for k in order]
        near = lambda v, i: sum(v[max(i - 1, 0) : i + 2]) / len(v[max(i - 1, 0) : i + 2])
        sums = [want[name(k)] for k in order]
        ratio = [(text[i] * marks[i] * near(text, i) * near(marks, i)) ** 0.25 * max(1 - w[3] / w[1], 0.02) for i, w in enumerate(sums)]
        assert np.allclose(path_ratios(parser.paths, order, Settings()), ratio)
        # the selection, a path at a time
        steps = [name(k).split("/") for k in order]
        nested = [x.count("article") > 1 for x in steps]
        aside = ["aside" in x or n for x, n in zip(steps, nested)]
        weighted = [r * (0.02 if low else 1) for r, low in zip(ratio, aside)]
        inside = ["article" in x for x in steps]
        body = [i and not low for i, low in zip(inside, aside)]
        if not any(body):
            continue
        shared = sum(r * w[1] for r, w, x in zip(ratio, sums, body) if x) / sum(w[1] for w, x in zip(sums, body) if x)
        score = [shared if x else r * (1 if i else 0.02) for r, x, i in zip(weighted, body, inside)]
        if shared >= max((r for r, i in zip(score, inside) if not i), default=0):
            chosen += 1
            assert content_paths(parser.paths, order, Settings()) == {k for k, r in zip(order, score) if r >= 0.8 * max(score)}
    assert chosen > 5


def test_random_ratios_change_most_pages(monkeypatch):
    rnd = random.Random(4)
    words = lambda n: " ".join(rnd.choice(["word", "and,", "so.", "long"]) for _ in range(n))
    pages = [f"<nav><ul><li><a>{words(2)}</a></ul></nav><article><h1>{words(4)}</h1><p>{words(40)}</p><ul><li>{words(5)}</ul></article><footer>{words(6)}</footer>" for _ in range(100)]
    real = [main_text(p) for p in pages]
    dice = np.random.default_rng(3)
    monkeypatch.setattr(H, "fused_ratios", lambda paths, order, settings: dice.random(len(order)) * np.where([paths[k].aside or paths[k].mark != "article" for k in order], settings.prior, 1.0))
    assert sum(main_text(p) != r for p, r in zip(pages, real)) > 60


def test_a_high_ratio_overcomes_names_and_a_low_one_loses_the_article():
    long = "A sentence, among many. " * 40
    assert main_text(f"<div class=widget><p>{long}</p></div><nav><a>Menu</a></nav>") == long.strip()
    assert main_text(f"<article><a href=1>Teaser</a></article><div class=story><h2>Head</h2><p>{long}</p></div>") == "Head " + long.strip()


def test_forms_and_controls():
    page = "<body><form id=aspnet><div class=top><a>Menu</a></div><article><h1>T</h1><p>Some text, in a <label>labelled</label> <button>sentence</button>, here.</p><form><p>Leave a reply, please.</p><label>Name</label><button>Send</button></form><button>Like</button></article></form>"
    assert main_text(page) == "T Some text, in a labelled sentence, here."
    body = "".join(f"<p>Sentence number {i}, which is long enough to be content. And another one, too.</p>" for i in range(9))
    assert main_text(f"<body><form><div><h2>Head</h2>{body}</div><div class=footer>Bye, now.</div></form>").startswith("Head Sentence number 0")


def test_reader_comments_and_menus_in_articles():
    said = "I tried it, twice. It works, as you say. " * 3
    page = f"<article><h1>Soup</h1><p>Boil it, and stir. Then serve it, hot.</p><ul class=menu><li>First, the soup.<li>Then, bread.</ul><ul class=menu><li><a>Home</a></ul><section><article class=comment><p>{said}</p></article></section><div class=article-comments><p>{said}</p></div><div class=user-comment><p>{said}</p></div></article><article class=comment><p>{said}</p></article>"
    assert main_text(page.replace("<ul class=menu><li><a>Home</a></ul>", "")) == "Soup Boil it, and stir. Then serve it, hot. First, the soup. Then, bread."
    only_links = page.replace("<ul class=menu><li>First, the soup.<li>Then, bread.</ul>", "")
    assert main_text(only_links) == "Soup Boil it, and stir. Then serve it, hot."


@pytest.mark.parametrize("unit", ["<a ", "<!--", '<a ">', '<a x="><b" ', "</a", "<script>", "<title>", "<textarea>x", "<", '<p x=\'>t<b" "><c', "<a b=", "<p><b>", "&", "<a b" + " " * 99, "<![CDATA["])
def test_unclosed_constructs_in_linear_time(unit):
    import time

    took = []
    for size in (300_000, 1_200_000):
        page = "hello, text. " + unit * (size // len(unit))
        start = time.perf_counter()
        main_text(page)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 30


@pytest.mark.parametrize("page", ["<div class=x>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<i><p>" + "<b>" * 50_000 + "</i>" * 50_000, "<div>" * 50_000 + "<li>a</li>" * 50_000, "<a><span class=ad>" * 50_000], ids=range(5))
def test_deep_pages_in_bounded_time_and_memory(page):
    import time
    import tracemalloc

    start = time.perf_counter()
    assert "deep, text." in main_text(page + "deep, text.")
    assert time.perf_counter() - start < 20
    tracemalloc.start()
    main_text(page[: len(page) // 4])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_smoothing_is_a_local_mean():
    assert smoothed(np.array([3.0, 0.0, 6.0, 9.0]), 1).tolist() == [1.5, 3.0, 5.0, 7.5]


LETTERS = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "äöüßabcz "}


def sample(rnd, lang, n):
    syllables = ["".join(p) for p in zip(LETTERS[lang][:-1], LETTERS[lang][1:-1], LETTERS[lang][3:-1])]
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language_is_learned_from_training_rows_alone(spark):
    rnd = random.Random(3)
    rows = [(i, sample(rnd, lang := rnd.choice(list(LETTERS)), rnd.randint(3, 60)), lang, 0.5) for i in range(600)]
    truth = {r[0]: r[2] for r in rows}
    docs = spark.createDataFrame(rows + [(9001, None, "aa", 0.1), (9002, "12 34!", "aa", 0.1), (9003, "", None, None), (None, "abc", "aa", None)], "doc_id long, text string, lang string, score double")
    kept = held_out(F.col("doc_id"))
    model = train(docs.filter(~kept))
    got = predict(docs.select("doc_id", kept.alias("held_out"), "text", "score"), model).collect()
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r._score <= 1
    assert {r.lang_pred for r in got if r.doc_id in (9001, 9002, 9003)} == {"und"}
    own = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(own) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in own) / len(own) > 0.97
    # labels of held-out rows change nothing
    other = docs.withColumn("lang", F.when(kept, F.lit("zz")).otherwise(F.col("lang")))
    again = train(other.filter(~kept))
    assert again.langs == model.langs and (again.prototypes == model.prototypes).all()


def test_language_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(none)
    assert predict(none, model).collect() == []
    assert [r.lang_pred for r in predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()] == ["und"]


def test_bundles_equal_plain_products():
    """Bind, permute and bundle a letter at a time, with no table of n-grams."""
    profile = Profile(dims=128)
    texts = ["Hello, world! é", "日本語 текст", "", "12", "a", "x" * 300 + " ab"]
    for text, got in zip(texts, Encoder(profile).bundles(texts)):
        letters = [c if c.isalpha() else " " for c in f" {text} ".lower()]
        letters = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
        want = np.zeros(128)
        for i in range(len(letters) - 2):
            v = np.ones(128)
            for place, x in enumerate(letters[i : i + 3]):
                v = v * np.roll(letter_vectors(np.array([ord(x) if x != " " else 0]), profile)[0], 2 - place)
            want += v
        assert (got == want).all()


def test_letters_have_vectors_of_their_own():
    codes = np.concatenate([np.arange(0x400, 0x500), np.arange(0x4E00, 0x5600)])
    vectors = letter_vectors(codes, Profile()).astype(np.float32)
    cosine = vectors @ vectors.T / 512
    np.fill_diagonal(cosine, 0)
    assert np.abs(cosine).max() < 0.35 and set(np.unique(vectors)) == {-1, 1}


def test_a_long_text_of_many_different_ngrams_in_bounded_memory():
    import tracemalloc

    rnd = random.Random(3)
    text = "".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(300_000))
    tracemalloc.start()
    Encoder(Profile()).bundles([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6


def active_set(a, b):
    """Nonnegative least squares by Lawson and Hanson's active sets: another method, for the least residual of |a x - b|."""
    free, x = np.zeros(a.shape[1], bool), np.zeros(a.shape[1])
    for _ in range(10 * a.shape[1]):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        if gradient.max() <= 1e-9 * np.abs(a.T @ b).max():
            break
        free[gradient.argmax()] = True
        while True:
            s = np.zeros(len(x))
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (s[free] > 0).all():
                break
            low = free & (s <= 0)
            x = x + (x[low] / (x[low] - s[low])).min() * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
    return x


def fitted(spark, p, tokens, goal, **options):
    groups = spark.createDataFrame([(i, x.tolist(), float(t)) for i, (x, t) in enumerate(zip(p, tokens))], "i long, p array<double>, tokens double")
    fit = fit_rates(groups, goal.tolist(), MixSettings(**options))
    rows = groups.select("i", fit.rate(F.col("p"), F.lit(0.0)).alias("rate")).collect()
    return fit, np.array([r.rate for r in sorted(rows)])


def some_groups(n, alpha):
    rng = np.random.default_rng(4)
    p = rng.dirichlet(alpha, n)
    return p, rng.integers(1, 500, n).astype(float)


def test_rates_meet_targets(spark):
    p, tokens = some_groups(400, [0.6, 0.4, 0.3])
    goal = tokens.sum() * np.array([0.6, 0.2, 0.2])
    fit, rate = fitted(spark, p, tokens, goal)
    assert np.abs(p.T @ (tokens * rate) - goal).sum() < 1e-3 * goal.sum() and (rate >= 0).all()
    # the same steps by hand: each moves all rates along the gradient, and projects them
    metric, want = np.linalg.pinv(p.T @ (p * tokens[:, None])), np.ones(len(p))
    for _ in fit.steps:
        want = np.maximum(0, want - p @ (metric @ (p.T @ (tokens * want) - goal)))
    assert np.allclose(rate, want)


def test_unreachable_targets_come_as_near_as_active_sets(spark):
    p, tokens = some_groups(40, [5, 5, 5])  # no document is of one domain, so shares of 0.98 are out of reach
    goal = tokens.sum() * np.array([0.98, 0.01, 0.01])
    with pytest.warns(UserWarning, match="misses its targets"):
        fit, rate = fitted(spark, p, tokens, goal, steps=400)
    half = np.linalg.cholesky(np.linalg.inv(p.T @ (p * tokens[:, None]))).T  # misses are measured in this metric
    a = half @ (p * tokens[:, None]).T
    size = lambda r: np.linalg.norm(a @ r - half @ goal)
    assert size(rate) <= 1.02 * size(active_set(a, half @ goal))
    assert np.allclose(np.array(fit.miss) * goal.sum(), p.T @ (tokens * rate) - goal)


def test_a_fit_that_misses_is_reported(spark):
    groups = spark.createDataFrame([([0.5, 0.5], 100.0)], "p array<double>, tokens double")
    with pytest.warns(UserWarning, match="misses its targets"):
        assert abs(fit_rates(groups, [90.0, 10.0], MixSettings()).miss[0]) > 0.3


def test_clashing_names(spark):
    names = ["words", "n", "distinct", "symbols", "features", "hits", "logit0", "copy", "tokens", "posteriors", "rate", "copies", "miss"]
    rows = [(i, "fine " * 20 + ("junk" if i % 3 == 0 else ""), *range(len(names))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    known = spark.createDataFrame([(i, "low" if i % 3 == 0 else "clean") for i in range(60)], "doc_id long, domain string")
    targets = {"clean": 0.5, "low": 0.5}
    plain = {r.doc_id: r.rate for r in mix(docs.select("doc_id", "text"), known, targets).collect()}
    for r in mix(docs, known, targets).collect():
        assert tuple(r)[2 : 2 + len(names)] == tuple(range(len(names))) and r["_rate"] == plain[r.doc_id]
    out = mixed(docs, known, targets=targets)
    assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {tuple(range(len(names)))}


def test_thin_posteriors_count(spark):
    rows = [(i, "fine " * 20 + ("junk" if i == 0 else "")) for i in range(400)]
    known = spark.createDataFrame([(i, "low" if i in (0, 1) else "clean") for i in range(400)], "doc_id long, domain string")
    got = mix(spark.createDataFrame(rows, "doc_id long, text string"), known, {"clean": 0.999, "low": 0.001}).collect()
    assert all(0 < r.posteriors[1] < 0.01 for r in got[1:])  # a grid of 0.01 made it 0


def test_mixing_by_labels(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        kind = rnd.choice(["clean", "clean", "low", "toxic"])
        words = [f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(20, 60))]
        words += {"clean": ["fine"], "low": ["|", "junk"], "toxic": ["nasty."]}[kind]
        rows.append((i, " ".join(words), kind, 0.1))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    rows += [(900, None, None, None), (901, "", None, None), (902, "x " * 300_000, None, None), (None, "fine", None, None), (5, rows[5][1], None, None)]
    labels += [(900, None, 1), (None, 1, 0), (5, 1, 0), (5, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double").repartition(3)
    known = labelled_domains(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    targets = {"clean": 0.7, "low": 0.2, "toxic": 0.1}
    got = mix(docs, known, targets, MixSettings(min_documents=3)).collect()
    assert len(got) == len(rows)
    tokens = np.array([r.tokens for r in got], float)
    assert all(r.tokens == len((r.text or "").split()) for r in got)
    p, rate = np.array([r.posteriors for r in got]), np.array([r._rate for r in got])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all() and all(r.copies in (int(r._rate), int(r._rate) + 1) for r in got)
    assert np.abs(p.T @ (tokens * rate) / tokens.sum() - [0.7, 0.2, 0.1]).max() < 0.01
    right = [r for r in got if r.source and r.posteriors.index(max(r.posteriors)) == list(targets).index(r.source)]
    assert len(right) > 0.95 * 300
    out = mixed(docs, known, targets=targets, settings=MixSettings(min_documents=3))
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_mixing_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    known = labelled_domains(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert mix(none, known).collect() == []
    one = mix(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), known).collect()
    assert len(one) == 1 and one[0].tokens == 2


def test_held_out_accuracy_on_documents(spark):
    import os

    from skein.llm.queries import op7_language_id

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("needs the small tables")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").collect()}
    own = [r for r in op7_language_id(spark, small).collect() if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(own) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in own) >= 0.9 * len(own)
