"""Token ids by the tokenizers library, with each distinct pre-token encoded once.

A byte-level BPE merges only inside a pre-token, so the ids of a text are the ids of its
pre-tokens one after another. numpy finds the pre-tokens of many texts at once, a hash table
holds the bytes and ids of those seen, and the library's BPE model encodes the others. A hit counts only if the bytes are equal. Texts that hold an added
token or characters whose class may differ between Unicode versions go to the library whole.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from skein.llm.common import Hasher, mixed, same_slices, slices

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Code points held at a time, and pre-tokens and their bytes kept before the table starts anew.
CHUNK_CHARS, TABLE_WORDS, TABLE_BYTES = 1 << 19, 3_000_000, 64 << 20
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: white space, letter, number, other; unsure where unassigned or above the BMP."""
    out = np.full(0x110000, UNSURE, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER, "C": OTHER, "M": OTHER, "P": OTHER, "S": OTHER, "Z": OTHER}
    for c in range(0x3000):
        kind = unicodedata.category(chr(c))
        out[c] = UNSURE if kind == "Cn" else kinds[kind[0]]
    out[0x3000:0xA000] = UNSURE
    out[0x4E00:0x9FA6] = LETTER
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def pretokens(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts laid end to end, by the public pattern of byte-level BPE:
    contractions, then letters, numbers or others with one space before, then white space."""
    kind = classes()[codes]
    start = np.ones(len(codes), bool)
    start[1:] = kind[1:] != kind[:-1]
    first = np.zeros(len(codes) + 1, bool)
    first[offsets[:-1][offsets[:-1] < len(codes)]] = True
    start |= first[:-1]
    head = np.flatnonzero(start[1:] & ~first[1:-1] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1  # after white space
    start[head - 1] = True
    start[head] = codes[head - 1] != 0x20
    quote = np.flatnonzero((codes == 0x27) & start)
    quote = quote[quote + 1 < len(codes)]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        padded = np.append(codes, [0, 0, 0]).astype(np.uint32)
        a, b = padded[quote + 1], np.where(first[np.minimum(quote + 2, len(codes))], 0, padded[quote + 2])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[one | two] + 1] = False
        for at in (quote[one] + 2, quote[two] + 3):
            start[at[at < len(codes)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts, as one flat array with offsets."""

    def __init__(self, path: str, hasher: Hasher | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the model reads bytes as printable signs: those that print as they are, the others in order from 256
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.signs = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.hasher = hasher or Hasher()
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n, self.filled = 0, 0
        self.begin, self.length, self.ids = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32), np.zeros(1 << 17, np.uint16)
        # the bytes of the pre-tokens, one after another
        self.spelt, self.spelt_at, self.spelt_size, self.spelt_end = np.zeros(1 << 18, np.uint8), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the table, or -1."""
        out, left, mask = np.full(len(h), -1, np.int32), np.arange(len(h)), (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            got = self.keys[slot]
            hit = got == h[left]
            out[left[hit]] = self.at[slot[hit]]
            go = ~hit & (got != 0)
            left, slot = left[go], (slot[go] + 1) & mask
        return out

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        slot, mask = (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.at[slot[won]] = values[won]
            h, values, slot = h[~won], values[~won], (slot[~won] + 1) & mask

    def _add(self, h: np.ndarray | None, texts: list[str]) -> None:
        """Adds pre-tokens and their ids; without hashes they are found by their index alone."""
        tokenize, signs = self.tokenizer.model.tokenize, self.signs
        found = [[t.id for t in tokenize(x.encode().decode("latin-1").translate(signs))] for x in texts]
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
        if self.ids.dtype == np.uint16 and len(flat) and flat.max() > 0xFFFF:
            self.ids = self.ids.astype(np.uint32)
        n, total = self.n + len(texts), self.filled + len(flat)
        while len(self.begin) < n:
            size = 2 * len(self.begin)
            for name in ("begin", "length", "spelt_at", "spelt_size"):
                setattr(self, name, np.resize(getattr(self, name), size))
        while len(self.ids) < total:
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.filled : total] = flat
        self.begin[self.n : n] = self.filled + np.cumsum(lengths) - lengths
        self.length[self.n : n] = lengths
        raw = [x.encode() for x in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        end = self.spelt_end + int(sizes.sum())
        while len(self.spelt) < end:
            self.spelt = np.resize(self.spelt, 2 * len(self.spelt))
        self.spelt[self.spelt_end : end] = np.frombuffer(b"".join(raw), np.uint8)
        self.spelt_at[self.n : n] = self.spelt_end + np.cumsum(sizes) - sizes
        self.spelt_size[self.n : n] = sizes
        self.spelt_end = end
        if h is None:
            self.n, self.filled = n, total
            return
        if 2 * n > len(self.keys):
            old, used = self.keys, self.keys != 0
            values = self.at[used]
            while 2 * n > (1 << self.bits):
                self.bits += 2
            self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(old[used], values)
        self._put(h, np.arange(self.n, n, dtype=np.int32))
        self.n, self.filled = n, total

    def encode(self, texts: list[str]):
        """Yields (first text, end text, ids, offsets) for runs of texts; None counts as empty."""
        texts = [t or "" for t in texts]
        for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK_CHARS):
            yield lo, hi, *self._run(texts[lo:hi])

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
        codes = np.frombuffer(joined.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
        odd = classes()[codes] == UNSURE
        if odd.any() or any(a in joined for a in self.added):
            bad = np.zeros(len(texts), bool)
            bad[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
            bad |= np.fromiter((any(a in t for a in self.added) for t in texts), bool, len(texts))
            parts = [None] * len(texts)
            for i in np.flatnonzero(bad):
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            good = np.flatnonzero(~bad)
            if len(good):
                ids, at = self._run([texts[i] for i in good])
                for k, i in enumerate(good):
                    parts[i] = ids[at[k] : at[k + 1]]
            out = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(p) for p in parts], out=out[1:])
            return np.concatenate(parts).astype(np.uint32), out
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = pretokens(codes, offsets)
        ends = np.append(starts[1:], len(codes))
        data = np.frombuffer(joined.encode(), np.uint8)
        begin = starts if len(data) == len(codes) else np.flatnonzero((data & 0xC0) != 0x80)[starts]
        finish = np.append(begin[1:], len(data))
        h = mixed(self.hasher.slices(data, begin, finish)) | np.uint64(1)
        if self.n > TABLE_WORDS or self.spelt_end > TABLE_BYTES:
            self.clear()
        at = self._find(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            first = miss[first]
            self._add(new, [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            at[miss] = self._find(h[miss])
        sizes = finish - begin
        equal = sizes == self.spelt_size[at]
        own = np.flatnonzero(equal)
        equal[own] = same_slices(data, begin[own], self.spelt[: self.spelt_end], self.spelt_at[at[own]], sizes[own])
        other = np.flatnonzero(~equal)
        if len(other):  # two pre-tokens of one hash: the later ones have entries of their own
            texts_of = [joined[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist())]
            where = {x: self.n + k for k, x in enumerate(dict.fromkeys(texts_of))}
            self._add(None, list(where))
            at[other] = [where[x] for x in texts_of]
        lengths = self.length[at].astype(np.int64)
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        ids = self.ids[np.repeat(self.begin[at] - total[:-1], lengths) + np.arange(total[-1])].astype(np.uint32)
        return ids, total[np.searchsorted(starts, offsets, side="left")]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker, kept between its tasks."""
    return Encoder(path)
