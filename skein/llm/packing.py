"""Packing of documents into training sequences by best-fit decreasing.

Overlong documents are first cut into full windows. The rest of each document, shorter than a window, goes
into the open window with the least room that still holds it: a segment tree indexed by remaining capacity
finds it. Pieces of one length are alike, so the plan places lengths with their counts, longest first: what
the driver holds is bounded by the window size, not by the documents. Tasks then look up their pieces by
length and rank, and no text or id is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import stored
from skein.llm.tokens import encoder, tokenizer_path

WINDOW, END_ID = 2048, 1


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which is the least one, of at least x, with an open window?"""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        k = self.leaves + capacity
        self.open[k] = is_open
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        k = self.leaves + least
        if self.open[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:  # to the right of here, lowest first
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


@dataclass
class Plan:
    """Runs of pieces: those of `size` with ranks from `rank` on go, `each` to a window, to windows from `window` on, at `offset`."""

    size: np.ndarray
    rank: np.ndarray
    window: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, offset in it) of pieces."""
        # runs stand by size, then rank; each size's first run has rank 0
        keys = self.size.astype(np.int64) * (1 << 48) + self.rank
        k = np.searchsorted(keys, size.astype(np.int64) * (1 << 48) + rank, side="right") - 1
        past = rank - self.rank[k]
        return self.window[k] + past // self.each[k], self.offset[k] + past % self.each[k] * size


def best_fit(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Best-fit decreasing of counts[size] pieces of each size, 1 <= size <= window.

    Placing one piece at a time gives the same windows: the window that takes a piece has the least room of
    those that can, so while it still has room for another of that size it stays the tightest.
    """
    tree, runs, opened, out = CapacityTree(window), {}, 0, []
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left > 0:
            room = tree.tightest(size)
            if room is None:
                room, first, many = window, opened, -(-left // (window // size))
                opened += many
            else:
                first, many = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // size
            full = min(many, left // each)
            done = []
            if full:
                out.append((size, rank, first, each, window - room))
                done.append((first, full, room - each * size))
                left, rank = left - full * each, rank + full * each
            if full < many and left > 0:  # the last pieces leave room in a window for more of them
                out.append((size, rank, first + full, left, window - room))
                done.append((first + full, 1, room - left * size))
                left, full = 0, full + 1
            if full < many:
                done.append((first + full, many - full, room))
            for start, n, room_left in done:
                if room_left:
                    runs.setdefault(room_left, []).append((start, n))
                    tree.set(room_left, True)
    out.sort()
    return Plan(*(np.array([r[i] for r in out], np.int64) for i in range(5)))


def _pieces(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, seen = TaskContext.get().partitionId(), encoder(path), np.zeros(window + 1, np.int64)
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, ids, offsets in enc.encode(batch.column(1).to_pylist()):
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                tokens = np.diff(offsets)
                many = -(-tokens // window)
                doc = np.repeat(np.arange(hi - lo), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * window
                length = np.minimum(tokens[doc] - start, window)
                raw, at = memoryview(ids.tobytes()), (offsets[doc] + start) * 4
                crcs = np.fromiter((zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (length * 4).tolist())), np.int64, len(doc))
                # rank among this partition's pieces of the same length
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.searchsorted(ordered, ordered)
                local = np.empty(len(doc), np.int64)
                local[order] = np.arange(len(doc)) - first + seen[ordered]
                seen += np.bincount(length, minlength=window + 1)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo).take(pa.array(doc)), *map(pa.array, (start, length, crcs, tokens[doc])), pa.array(np.full(len(doc), part, np.int32)), pa.array(local)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local"],
                )

    return run


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    A document's ids are those of its text and `end_id`; null text counts as empty and gives that id alone. The
    pieces of a sequence lie in it without gaps. `sequence_length` is what the sequence is padded to: its content
    where that is a power of two, else `window`. Repeated rows, and rows with a null doc_id, are documents of their
    own. An empty table gives no rows.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local long"
    pieces = stored(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_pieces(path, window, end_id), schema), "pieces")
    per_part = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece_counts")
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `window` rows at most
    plan = best_fit(counts, window)
    sequences = plan_lengths(plan, counts, window)
    sent = spark.sparkContext.broadcast((plan, sequences))
    before = per_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("earlier"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, (edges, padded) = sent.value
        for batch in batches:
            length, rank = np.array(batch.column(2)), np.array(batch.column(5))
            if not len(length):
                continue
            sequence, offset = plan.place(length, rank)
            pad = padded[np.searchsorted(edges, sequence, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), pa.array(pad)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"])

    # the counts grow with the partitions, so they are merged, never broadcast
    ranked = pieces.join(before.hint("merge"), ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("local") + F.col("earlier")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long")


def plan_lengths(plan: Plan, counts: dict[int, int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sequences of runs, padded lengths) of the sequences of a plan, as runs that share a content length."""
    if not len(plan.size):
        return np.zeros(1, np.int64), np.full(1, window, np.int64)
    same = np.append(plan.size[1:] == plan.size[:-1], False)
    until = np.where(same, np.append(plan.rank[1:], 0), np.array([counts[int(s)] for s in plan.size]))
    n = until - plan.rank
    first, last = plan.window, plan.window + -(-n // plan.each)
    edges = np.unique(np.concatenate([first, last]))
    change = np.zeros(len(edges) + 1, np.int64)
    added = np.minimum(plan.each, n) * plan.size  # every window of a run takes as much
    np.add.at(change, np.searchsorted(edges, first), added)
    np.add.at(change, np.searchsorted(edges, last), -added)
    content = np.cumsum(change)[: len(edges)]
    return edges, np.where((content > 0) & (content & (content - 1) == 0), content, window)
