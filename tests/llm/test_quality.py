import collections
import random
import re

from skein.llm.quality import QualityRules, quality_columns, quality_filter


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    inside = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside), failed


def texts():
    rnd = random.Random(5)
    parts = ["a", "b ", " ", "\n", "é ", "#", "a b\n", "\x0b", "日本 ", "w1 w2 w3 w4 w5 w6 w7 w8 w9 ", "same line of words\n"]
    some = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 90))) for _ in range(300)]
    return [None, "", "\n", "a", "\na\na\n\n", " ".join(f"w{i}" for i in range(50)), "x " * 500_000, "z" * 2_000_000, *some]


def test_base_measures_equal_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(1, "", "clash"), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = quality_columns(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert r.kept in ("clash", None) and not (r.base_failed and r._kept)


def test_repetition_rejects_and_clean_text_stays(spark):
    rnd = random.Random(2)
    clean = " ".join(f"word{rnd.randint(0, 9999)}" for _ in range(300))
    lines = "\n".join(["one two three four five six"] * 3 + [" ".join(f"w{rnd.randint(0, 9999)}" for _ in range(12)) for _ in range(3)])
    phrase = " ".join(f"p{i}" for i in range(6))
    ngrams = " ".join(f"{phrase} x{i} y{i}" for i in range(30))
    docs = spark.createDataFrame([(1, clean), (2, lines), (3, ngrams), (4, "few words")], "doc_id long, text string")
    assert [r.doc_id for r in quality_filter(docs).collect()] == [1]
    loose = QualityRules(min_words=1, ngram_chars={}, line_chars=2.0, max_repeat_words_percent=100)
    assert sorted(r.doc_id for r in quality_filter(docs, rules=loose).collect()) == [1, 2, 3, 4]


def test_empty_table(spark):
    assert quality_columns(spark.createDataFrame([], "doc_id long, text string")).collect() == []
