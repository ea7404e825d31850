"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +-1. The letters of an n-gram, permuted by their place, are bound by product; a
text's n-gram vectors are bundled by sum. A language's prototype bundles the unit vectors of its training texts, and a
text gets the language whose prototype is nearest by cosine, both seen from the mean of all prototypes.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import fresh_name, mixed, slices

UNKNOWN = "und"
BITS, CHUNK_CHARS = 21, 1 << 18
#: N-grams whose vectors are held at a time, characters and texts bundled at a time.
GRAMS, SLICE_CHARS, SLICE_TEXTS = 8192, 1 << 16, 256


@dataclass(frozen=True)
class Profile:
    dims: int = 512
    n: int = 3
    seed: int = 7


@lru_cache(1)
def letters() -> np.ndarray:
    """Each code point that is a letter as itself, others as 0."""
    out = np.zeros(0x110000, np.int64)
    own = np.array([c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"])
    out[own] = own
    return out


def letter_vectors(codes: np.ndarray, profile: Profile) -> np.ndarray:
    """(len(codes), dims) vectors of +-1: each code point has its own, from the bits of its hashes."""
    words_of = -(-profile.dims // 64)
    with np.errstate(over="ignore"):
        place = np.arange(words_of, dtype=np.uint64) + np.uint64(profile.seed) * np.uint64(0x9E3779B97F4A7C15)
        bits = mixed(mixed(codes.astype(np.uint64))[:, None] + mixed(place)[None, :])
    return (np.unpackbits(bits.view(np.uint8), axis=1)[:, : profile.dims].astype(np.int8) << 1) - 1


class Encoder:
    """Bundles of texts; vectors of n-grams are made when first met and kept, `keep` at most."""

    def __init__(self, profile: Profile, keep: int = 50_000):
        if profile.n > 3:
            raise ValueError("an n-gram is one number of 63 bits: three letters at most")
        self.p, self.keep = profile, keep
        self.keys, self.vectors = np.zeros(0, np.int64), np.zeros((0, profile.dims), np.int8)

    def _bound(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones((len(keys), self.p.dims), np.int8)
        for place in range(self.p.n):
            letter, which = np.unique((keys >> (BITS * (self.p.n - 1 - place))) & ((1 << BITS) - 1), return_inverse=True)
            out *= np.roll(letter_vectors(letter, self.p), self.p.n - 1 - place, axis=1)[which]
        return out

    def _of(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of n-grams in ascending order."""
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = keys[~known]
            if len(self.keys) + len(new) > self.keep:
                return self._bound(keys)
            where = np.searchsorted(self.keys, new)
            self.keys, self.vectors = np.insert(self.keys, where, new), np.insert(self.vectors, where, self._bound(new), axis=0)
            at = np.searchsorted(self.keys, keys)
        return self.vectors[at]

    def bundles(self, texts: list[str]) -> np.ndarray:
        """(len(texts), dims) bundle of each text, 0 where it has no letter. Vectors are held for GRAMS n-grams at a time, so
        memory follows the characters of the longest text, not its different n-grams times the dimensions."""
        laid = [f" {t} ".lower() for t in texts]
        lengths = np.fromiter(map(len, laid), np.int64, len(laid))
        out = np.zeros((len(texts), self.p.dims), np.float32)
        for lo, hi in slices(np.maximum(lengths, SLICE_CHARS // SLICE_TEXTS), SLICE_CHARS):
            out[lo:hi] = self._bundled(laid[lo:hi], lengths[lo:hi])
        return out

    def _bundled(self, laid: list[str], lengths: np.ndarray) -> np.ndarray:
        codes = np.frombuffer("".join(laid).encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
        kind = letters()[codes]
        doc = np.repeat(np.arange(len(laid)), lengths)
        keep = np.ones(len(kind), bool)  # runs of other than letters count as one
        keep[1:] = (kind[1:] != 0) | (kind[:-1] != 0) | (doc[1:] != doc[:-1])
        kind, doc = kind[keep], doc[keep]
        n, out = self.p.n, np.zeros((len(laid), self.p.dims), np.float32)
        if len(kind) < n:
            return out
        keys = np.zeros(len(kind) - n + 1, np.int64)
        for place in range(n):
            keys = (keys << BITS) | kind[place : len(kind) - n + 1 + place]
        inside = doc[: len(keys)] == doc[n - 1 :]
        keys, doc = keys[inside], doc[: len(inside)][inside]
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], doc[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        starts = np.append(np.flatnonzero(new), len(keys))
        for a in range(0, len(starts) - 1, GRAMS):
            b = min(a + GRAMS, len(starts) - 1)
            own = slice(starts[a], starts[b])
            which = np.cumsum(new[own]) - 1
            counts = np.bincount(doc[own] * (b - a) + which, minlength=len(laid) * (b - a)).reshape(len(laid), -1)
            out += counts.astype(np.float32) @ self._of(keys[starts[a:b]]).astype(np.float32)
        return out


@lru_cache(2)
def encoder(profile: Profile) -> Encoder:
    return Encoder(profile)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(size == 0, 1, size)


def _bundled(texts: list[str | None], profile: Profile) -> Iterator[tuple[int, int, np.ndarray]]:
    texts = [t or "" for t in texts]
    for lo, hi in slices(np.fromiter(map(len, texts), np.int64, len(texts)), CHUNK_CHARS):
        yield lo, hi, encoder(profile).bundles(texts[lo:hi])


@dataclass
class Model:
    """Prototypes of languages, as unit vectors from their mean."""

    profile: Profile
    langs: list[str]
    mean: np.ndarray
    prototypes: np.ndarray

    def predict(self, bundles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each bundle; the score is the cosine, moved to 0..1."""
        cosine = _unit(_unit(bundles) - self.mean) @ self.prototypes.T
        best = cosine.argmax(1)
        return best, np.clip((1 + cosine[np.arange(len(best)), best]) / 2, 0, 1)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", profile: Profile = Profile()) -> Model:
    """Prototypes of the non-null languages of `docs`, from all its texts with a letter.

    What reaches the driver is a vector for each language; there must be few of them, as languages are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, bundles in _bundled(batch.column(1).to_pylist(), profile):
                units = _unit(bundles.astype(np.float64))
                for name in set(names[lo:hi]):
                    sums[name] = sums.get(name, 0) + units[names[lo:hi] == name].sum(0)
        # whole numbers, so that the sum doesn't depend on the order of tasks
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([np.rint(v * 2**20).astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    known = docs.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    cells = known.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in cells})
    table = np.zeros((len(langs), profile.dims))
    where = {name: k for k, name in enumerate(langs)}
    for r in cells:
        table[where[r.lang], r.i] = r.x
    table = _unit(table)
    mean = table.mean(0) if len(langs) > 1 else np.zeros(profile.dims)
    return Model(profile, langs, mean, _unit(table - mean))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with columns lang_pred and score (underscored where they clash).

    Null texts, texts without a letter, and all texts if the model knows no language, get `und` with score 0. Texts count
    whole; repeated rows get the same answer; an empty table gives no rows. Of equal cosines the first language by name wins.
    """
    names: list[str] = []
    for name in ("lang_pred", "score"):
        names.append(fresh_name([*docs.columns, *names], name))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a vector for each language
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        langs = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(k).to_pylist()
            pick, score = np.full(len(texts), len(model.langs)), np.zeros(len(texts))
            if model.langs:
                for lo, hi, bundles in _bundled(texts, model.profile):
                    has = np.fromiter(map(_has_letter, texts[lo:hi]), bool, hi - lo)
                    best, s = model.predict(bundles)
                    pick[lo:hi], score[lo:hi] = np.where(has, best, len(model.langs)), np.where(has, s, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs[pick], pa.string()), pa.array(score)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5; true where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
