"""Shared plumbing of the operators: tables, shared storage, text buffers, rolling hashes modulo a prime."""

from __future__ import annotations

import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the numpy kernels hold at a time (one longer text is held alone).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where it is unset, a local session gets one of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a shared folder")
        found = f"file://{tempfile.gettempdir()}/skein_checkpoints"  # one machine: its own folder is shared
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/skein_{label}_{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(taken: list[str], name: str) -> str:
    """`name`, or with underscores before it until it clashes with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """fresh_name() of each, different from each other too."""
    out: list[str] = []
    for name in names:
        out.append(fresh_name([*taken, *out], name))
    return out


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to `limit` at most, or one row alone."""
    ends = np.cumsum(sizes)
    lo, n = 0, len(sizes)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def byte_views(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of slices of a string array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for lo, hi in slices(np.diff(offsets), limit):
        a, b = offsets[lo], offsets[hi]
        yield lo, hi, whole[a:b], offsets[lo : hi + 1] - a


PRIME = (1 << 61) - 1
_P61, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_U = np.uint64


def folded(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo 2**61 - 1."""
    x = (x & _P61) + (x >> _U(61))
    return np.minimum(x, x - _P61)  # below the prime the difference wraps round to a large value


def times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Products modulo 2**61 - 1 of values below it, in halves of 31 bits."""
    b = _U(b) if isinstance(b, int) else b
    with np.errstate(over="ignore"):
        ah, al, bh, bl = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
        middle = al * bh + ah * bl
        return folded(((ah * bh) << _U(1)) + (middle >> _U(30)) + ((middle & _LOW30) << _U(31)) + al * bl)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64).copy()
#: Slices of more bytes are hashed one by one, by a keyed BLAKE2b.
LONG_SLICE = 56


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as numbers; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))


def same_slices(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a[a_start : a_start + size] equals b[b_start : b_start + size], for each of many slices; exact."""
    va, vb = eights(a), eights(b)
    out, left, at = np.ones(len(sizes), bool), np.arange(len(sizes)), 0
    while len(left) and at < 64:
        mask = _MASKS[np.minimum(sizes[left] - at, 8)]
        equal = (va[a_starts[left] + at] & mask) == (vb[b_starts[left] + at] & mask)
        out[left[~equal]] = False
        at += 8
        left = left[equal & (sizes[left] > at)]
    for i in left.tolist():
        n = int(sizes[i])
        out[i] = bool(np.array_equal(a[a_starts[i] : a_starts[i] + n], b[b_starts[i] : b_starts[i] + n]))
    return out


class Hasher:
    """Rolling hashes: polynomials modulo the prime 2**61 - 1 at a base that no text can know.

    Two different slices of n blocks agree for n of the 2**61 bases at most. The base is drawn from `seed`, which is
    secret and new in each run; hashes of one seed can be compared.
    """

    def __init__(self, seed: int | None = None):
        self.seed = secrets.randbits(128) if seed is None else seed
        drawn = hashlib.blake2b(self.seed.to_bytes(16, "little"), digest_size=48).digest()
        self.key = drawn[:32]
        self.base = int.from_bytes(drawn[32:40], "little") % (PRIME - (1 << 32)) + (1 << 31)
        self.step = int.from_bytes(drawn[40:48], "little") % (PRIME - (1 << 32)) + (1 << 31)
        self.inverse = pow(self.step, -1, PRIME)
        self._p = self._i = np.ones(1, np.uint64)

    def slices(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of slices of bytes, in blocks of seven and with their lengths."""
        sizes, view = ends - starts, eights(data)
        h = folded(times(sizes.astype(np.uint64), self.base) + (view[starts] & _MASKS[np.clip(sizes, 0, 7)]))
        left, at = np.flatnonzero((sizes > 7) & (sizes <= LONG_SLICE)), 7
        while len(left):
            block = view[starts[left] + at] & _MASKS[np.minimum(sizes[left] - at, 7)]
            h[left] = folded(times(h[left], self.base) + block)
            at += 7
            left = left[sizes[left] > at]
        raw = memoryview(np.ascontiguousarray(data))
        for i in np.flatnonzero(sizes > LONG_SLICE).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, key=self.key).digest(), "little") % PRIME
        return h

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._p) < n:
            size = 1 << int(n - 1).bit_length()
            for name, b in (("_p", self.step), ("_i", self.inverse)):
                out = np.ones(size, np.uint64)
                done, power = 1, b
                while done < size:  # doubles: out[k + done] = out[k] * b**done
                    out[done : 2 * done] = times(out[:done], power)
                    power, done = power * power % PRIME, done * 2
                setattr(self, name, out)
        return self._p, self._i

    def windows(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, 64-bit hash) of each window of n words that lies in one document."""
        return self.of_sums(self.sums(hashes), doc, n)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Prefix sums of hashes times the powers of the step, from which windows of any length follow."""
        power, _ = self._powers(len(hashes) + 1)
        v = times(hashes, power[: len(hashes)])
        total = np.zeros(len(hashes) + 1, np.uint64)
        high = folded(np.cumsum(v >> _U(31), dtype=np.uint64))  # times 2**31 is a turn by 31 of 61 bits
        total[1:] = folded(np.cumsum(v & _LOW31, dtype=np.uint64) + (((high & _LOW30) << _U(31)) | (high >> _U(30))))
        return total

    def of_sums(self, total: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(max(0, len(doc) - n + 1))
        at = at[doc[at] == doc[at + n - 1]] if len(at) else at
        return at, mixed(times(folded(total[at + n] + (_P61 - total[at])), self._powers(len(total))[1][at]))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that close inputs give unrelated outputs."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of the words [^\\x20\\x09-\\x0D]+ of each document."""
    word = np.zeros(len(data) + 2, bool)
    np.logical_not(SEPARATORS[data], out=word[1:-1])
    begins, finishes = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = word[1:-1][cut]
    finishes[cut - 1] = word[1:-1][cut - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
