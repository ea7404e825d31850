"""Hashes stand for equality nowhere: words that collide under any odd base modulo 2**64, and hashers that collide by force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from skein.llm.common import PRIME, Hasher, same_slices, times, words
from skein.llm.neardup import near_duplicates
from skein.llm.packing import pack
from skein.llm.quality import QualityRules, measure
from skein.llm.tokenfile import token_output
from skein.llm.tokens import Encoder, tokenizer_path


def thue_morse(doublings):
    a, b = "a", "b"
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


class Poor(Hasher):
    """Gives all slices one hash until it is thrown away."""

    def slices(self, data, starts, ends):
        return np.full(len(starts), 7, np.uint64)


def as_bytes(*texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, np.cumsum([0, *(len(t.encode()) for t in texts)])


def test_arithmetic_modulo_the_prime():
    rnd = random.Random(1)
    a, b = ([rnd.choice([0, 1, PRIME - 1, rnd.randrange(PRIME)]) for _ in range(3000)] for _ in "ab")
    assert [int(x) for x in times(np.array(a, np.uint64), np.array(b, np.uint64))] == [x * y % PRIME for x, y in zip(a, b)]
    h = Hasher(3)
    v = np.array(a, np.uint64)
    total, want = 0, [0]
    for i, x in enumerate(a):
        total = (total + x * pow(h.step, i, PRIME)) % PRIME
        want.append(total)
    assert [int(x) for x in h.sums(v)] == want


@pytest.mark.parametrize("doublings", [10, 11, 12])
def test_words_that_collide_modulo_a_power_of_two(doublings):
    a, b = thue_morse(doublings)
    data, _ = as_bytes(a, b)
    for size in (len(a), 48):
        x, y = Hasher(1).slices(data, np.array([0, len(a)]), np.array([size, len(a) + size]))
        assert x != y
    # as words of a text, too
    text = " ".join(a + b + a + b)
    data, offsets = as_bytes(text)
    starts, ends, doc = words(data, offsets)
    hasher = Hasher(1)
    at, w = hasher.windows(hasher.slices(data, starts, ends), doc, len(a))
    assert w[0] != w[len(a)] and w[0] == w[2 * len(a)]


def test_equal_windows_have_equal_hashes_wherever_they_stand():
    text = " ".join(f"word{i}" for i in range(40))
    hasher = Hasher(5)
    found = []
    for lead in ("", "x ", "a b c d e f g h "):
        data, offsets = as_bytes(lead + text)
        starts, ends, doc = words(data, offsets)
        _, w = hasher.windows(hasher.slices(data, starts, ends), doc, 5)
        found.append(w[len(w) - 36 :].tolist())
    assert found[0] == found[1] == found[2] and len(set(found[0])) == 36


def test_same_slices():
    rnd, texts = random.Random(2), []
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 500):
        t = "".join(rnd.choice("ab") for _ in range(n))
        texts += [t, t, t[:-1] + ("a" if t[-1:] == "b" else "b")] if n else ["", "", ""]
    data, offsets = as_bytes(*texts)
    first, second, other = offsets[:-1][::3], offsets[:-1][1::3], offsets[:-1][2::3]
    sizes = np.diff(offsets)[::3]
    assert same_slices(data, first, data, second, sizes).all()
    assert same_slices(data, first, data, other, sizes).tolist() == [n == 0 for n in sizes]


def test_tokens_of_colliding_words():
    texts = [w for n in (10, 11) for w in thue_morse(n)] + [" the cat sat on the mat, and the cat's 12 hats..."]
    for hasher in (Hasher(), Poor()):
        enc = Encoder(tokenizer_path(), hasher)
        for _ in range(2):
            for lo, hi, ids, offsets in enc.encode(texts):
                for i in range(lo, hi):
                    assert ids[offsets[i - lo] : offsets[i - lo + 1]].tolist() == enc.tokenizer.encode(texts[i], add_special_tokens=False).ids


def test_packed_and_written_ids_of_colliding_words(spark):
    texts = list(enumerate(thue_morse(11)))
    docs, tokenizer = spark.createDataFrame(texts, "doc_id long, text string"), Encoder(tokenizer_path()).tokenizer
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts}
    assert {r.doc_id: r.ids_crc32 for r in token_output(docs).collect()} == {i: crc([*x, 0]) for i, x in want.items()}
    assert {r.doc_id: r.ids_crc32 for r in pack(docs, window=4096).collect()} == {i: crc([*x, 1]) for i, x in want.items()}


def test_repeats_of_colliding_words():
    a, b = thue_morse(10)
    filler = " ".join(f"w{i}" for i in range(20))
    first = " ".join([a, *(f"x{i}" for i in range(7))])
    second = " ".join([b, *(f"x{i}" for i in range(7))])
    data, offsets = as_bytes(f"{a}\n{b}\n{filler} {first} {filler[:5]} {second}")
    got = measure(data, offsets, QualityRules())
    assert got["n_dup_lines"].tolist() == [0] and got["n_repeat_words"].tolist() == [0]
    again = measure(data, offsets, QualityRules(), Poor())  # a collision is seen, and measured again at another base
    assert {k: v.tolist() for k, v in again.items()} == {k: v.tolist() for k, v in got.items()}


def test_sets_of_colliding_words(spark):
    a, b = thue_morse(10)
    tail = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(4))
    rows = [(1, a), (2, b), (3, f"{a} {tail}"), (4, f"{b} {tail}")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (1, i) for i in (1, 2, 3, 4)}
