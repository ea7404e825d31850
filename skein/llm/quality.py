"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths in numpy measure how many characters of a text lie
inside n-grams of words, or lines, that the text holds twice or more. Hashes find the repeats; their
words and bytes are then compared, so what is counted is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import Hasher, byte_views, fresh_name, mixed, same_slices, words

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """Limits; a text that breaks one is rejected.

    `ngram_chars` maps an n-gram length in words to the largest share of the text's word characters
    inside n-grams found twice or more; `line_chars` is the largest share inside repeated lines.
    """

    min_words: int = 20
    window: int = 8
    max_repeat_words_percent: int = 30
    ngram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30})
    line_chars: float = 0.30
    max_symbols_per_word: float = 0.3


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_ngram_share", pa.float64()), ("dup_line_share", pa.float64())]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


class Collision(Exception):
    """Two different texts have one hash."""


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the keys that occur twice or more, the first place of the same key)."""
    none = np.zeros(0, np.int64)
    if len(keys) < 2:
        return none, none
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return none, none
    twice = np.unique(twice)
    at = np.searchsorted(twice, keys)
    found = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == keys)
    first = np.full(len(twice), -1)
    first[at[found][::-1]] = found[::-1]  # the earliest is written last
    return found, first[at[found]]


def _word_ids(h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each different word, by its bytes."""
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    rep, sizes = first[ids], ends - starts
    if not ((sizes == sizes[rep]).all() and same_slices(data, starts, data, starts[rep], sizes).all()):
        raise Collision
    return ids


def _in_document(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(h ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the words inside windows of n words that begin at `at`."""
    step = np.bincount(at, minlength=size + 1) - np.bincount(at + n, minlength=size + 1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, rules: QualityRules, hasher: Hasher | None = None) -> dict[str, np.ndarray]:
    """The measures of the documents that lie end to end in `data`. What hashes call a repeat is compared word by word; should two
    different texts have one hash, all is measured again at another base."""
    while True:
        try:
            return _measured(data, offsets, rules, hasher or _hasher())
        except Collision:
            hasher = Hasher()


@lru_cache(1)
def _hasher() -> Hasher:
    return Hasher()


def _measured(data: np.ndarray, offsets: np.ndarray, rules: QualityRules, hasher: Hasher) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    per_doc = lambda mask, weight=None: np.bincount(doc[mask], None if weight is None else weight[mask], n).astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = lead[ends] - lead[starts]
    everything = np.ones(len(starts), bool)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out = {"n_words": per_doc(everything), "word_chars": per_doc(everything, chars), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}
    h = hasher.slices(data, starts, ends)
    sums, ids = hasher.sums(h), None
    share = np.zeros(n)
    broken = np.zeros(n, bool)
    total = np.maximum(out["word_chars"], 1)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    for k in sorted({rules.window, *rules.ngram_chars}):
        at, w = hasher.of_sums(sums, doc, k)
        again, first = _repeated(_in_document(w, doc[at]))
        if not len(again):
            continue
        ids = _word_ids(h, data, starts, ends) if ids is None else ids
        if not (doc[at[again]] == doc[at[first]]).all() or any((ids[at[again] + j] != ids[at[first] + j]).any() for j in range(k)):
            raise Collision
        inside = _covered(at[again], k, len(starts))
        if k == rules.window:
            out["n_repeat_words"] = per_doc(inside)
        if k in rules.ngram_chars:
            part = per_doc(inside, chars) / total
            broken |= part > rules.ngram_chars[k]
            share = np.maximum(share, part)
    # lines, split at \n alone: a line begins at a document's start or after a \n
    feeds = np.flatnonzero(data == 0x0A)
    heads = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    heads = heads[heads < len(data)]
    tails = np.append(heads[1:], len(data))
    tails = tails - (data[tails - 1] == 0x0A) if len(heads) else tails
    tails = np.maximum(tails, heads)
    owner = np.searchsorted(offsets, heads, side="right") - 1
    # words of each line
    first_word, last = np.searchsorted(starts, heads), np.searchsorted(starts, tails)
    real = last > first_word
    heads, tails, owner, first_word, last = heads[real], tails[real], owner[real], first_word[real], last[real]
    out["n_dup_lines"] = np.zeros(n, np.int64)
    line_share = np.zeros(n)
    if len(heads):
        again, once = _repeated(_in_document(hasher.slices(data, heads, tails), owner))
        if len(again):
            sizes = tails - heads
            if not ((owner[again] == owner[once]) & (sizes[again] == sizes[once])).all() or not same_slices(data, heads[again], data, heads[once], sizes[again]).all():
                raise Collision
            so_far = np.concatenate([[0], np.cumsum(chars)])
            line_chars = np.bincount(owner[again], so_far[last[again]] - so_far[first_word[again]], n)
            out["n_dup_lines"] = np.bincount(owner[again[again != once]], None, n).astype(np.int64)
            line_share = line_chars / total
    out["dup_ngram_share"], out["dup_line_share"] = share, line_share
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_words_percent * out["n_words"])
    out["kept"] = ~(out["base_failed"] | broken | (line_share > rules.line_chars) | (out["n_symbols"] > rules.max_symbols_per_word * np.maximum(out["n_words"], 1)))
    return out


def quality_columns(docs: DataFrame, text: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """`docs` with the columns of FIELDS after its own; a clash gets an underscore before the new name.

    Null text counts as empty (no words: base_failed). Texts of any length are measured whole. Rows are
    independent of each other: repeated rows and ties change nothing, an empty table gives no rows.
    A line of white space alone isn't a line; a repeated line counts from its second occurrence on.
    """
    rules, names = rules or QualityRules(), []
    for name, _ in FIELDS:
        names.append(fresh_name([*docs.columns, *names], name))
    kinds = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.bool_(): T.BooleanType()}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kinds[kind]) for name, (_, kind) in zip(names, FIELDS))])
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_views(batch.column(k)):
                got = measure(data, offsets, rules)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[name], kind) for name, kind in FIELDS)], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, text: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """The rows of `docs` that quality_columns keeps, with the columns of `docs`."""
    verdict = fresh_name(docs.columns, "kept")
    return quality_columns(docs, text, rules).filter(F.col(f"`{verdict}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
