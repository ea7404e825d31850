"""Numeric expressions: retention, fusion, grades, prices, durations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K, NOISE_FLOOR = 10, 0.05
# Prices in dollars per million tokens (input, cache write, cache read, output) by what a model's name, in lower case
# without dashes and underscores, matches; the first match wins, and the last row is for all others.
PRICES = (
    ("claudefable", 10.0, 12.50, 1.00, 50.0),
    ("claudeopus4(?!1)", 5.0, 6.25, 0.50, 25.0),
    ("claudeopus41|claudeopus3", 15.0, 18.75, 1.50, 75.0),
    ("claudesonnet", 3.0, 3.75, 0.30, 15.0),
    ("claudehaiku45", 1.0, 1.25, 0.10, 5.0),
    ("claudehaiku3", 0.25, 0.30, 0.03, 1.25),
    ("", 3.0, 3.75, 0.30, 15.0),
)
INPUT, CACHE_WRITE, CACHE_READ, OUTPUT = range(4)
# Least score of each grade.
GRADES = ((0.70, "A"), (0.50, "B"), (0.30, "C"), (0.10, "D"))


def retention(salience: Column, idle_seconds: Column, accesses: Column, decay: float = 0.02) -> Column:
    """salience * exp(-decay * days idle) * ln(e + accesses), from whole seconds, never from the future."""
    days = F.greatest(F.lit(0), idle_seconds) / 86400.0
    return salience * F.exp(-F.lit(decay) * days) * F.ln(F.lit(math.e) + accesses)


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    """Share of one list in a fused score; `rank` counts from 0."""
    return 1.0 / (rank + k + 1)


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for least, name in GRADES[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("F")


def price(model: Column, which: int) -> Column:
    """Price per token of INPUT, CACHE_WRITE, CACHE_READ or OUTPUT."""
    name, out = F.regexp_replace(F.lower(model), "[-_]", ""), None
    for pattern, *prices in PRICES:
        out = F.when(name.rlike(pattern), prices[which] / 1e6) if out is None else out.when(name.rlike(pattern), prices[which] / 1e6)
    return F.coalesce(out, F.lit(PRICES[-1][1 + which] / 1e6))


def rounded(x: Column, places: int) -> Column:
    """A double scaled, rounded to a whole number and scaled back, as the SQL does: what lies next to a tie is one when scaled, but not in the decimal form that F.round() goes by."""
    return F.round(x * 10.0**places) / 10.0**places


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine over the shorter length; 1 for an empty or zero vector."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    wide = lambda v: v.cast("double")
    dot = total(F.zip_with(x, y, lambda p, q: wide(p) * wide(q)))
    norm = F.sqrt(total(F.transform(x, lambda p: wide(p) * wide(p)))) * F.sqrt(total(F.transform(y, lambda p: wide(p) * wide(p))))
    return F.when((n == 0) | (norm == 0), 1.0).otherwise(1.0 - dot / norm)


def duration_seconds(c: Column) -> Column:
    """Seconds of `Nd`, `Nh` or `Nm`; null for anything else."""
    n = F.regexp_extract(c, "^([0-9]+)[dhm]$", 1)
    unit = F.regexp_extract(c, "^[0-9]+([dhm])$", 1)
    return F.when(n != "", F.try_to_number(n, F.lit("999999999")).cast("long") * F.when(unit == "d", 86400).when(unit == "h", 3600).otherwise(60))


def elapsed(seconds: Column) -> Column:
    """42s, or 1m07s from a minute on."""
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.format_string("%dm%02ds", F.floor(seconds / 60), (seconds % 60).cast("long")))


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 4).cast("long")


def osa_at_most(a: Column, b: Column, limit: int) -> Column:
    """Whether b is within `limit` edits of a, an edit being an insertion, deletion, substitution or one swap of neighbours.

    Levenshtein within the limit settles most; of the others a pair of equal length that differs by one swap is within 1.
    """
    near = F.levenshtein(a, b) <= limit
    swap = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == limit + 1)
    one = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.levenshtein(F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))), b) <= limit - 1)
    return near | (swap & one)


def osa_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours that lead from a to b, no part being edited twice: the table's rows are
    folded, each from the two before it."""
    at = lambda s, i: F.substring(s, i, F.lit(1))
    steps = lambda n: F.sequence(F.lit(1), n)
    first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: j.cast("int"))

    def row(state: Column, i: Column) -> Column:
        above, two = state["above"], state["two"]

        def cell(done: Column, j: Column) -> Column:
            same = at(a, i) == at(b, j)
            swap = F.when((i > 1) & (j > 1) & (at(a, i) == at(b, j - 1)) & (at(a, i - 1) == at(b, j)), F.get(two, j - 2) + 1)
            return F.array_append(done, F.least(F.get(done, j - 1) + 1, F.get(above, j) + 1, F.get(above, j - 1) + F.when(same, 0).otherwise(1), swap))

        return F.struct(F.aggregate(steps(F.length(b)), F.array(i.cast("int")), cell).alias("above"), above.alias("two"))

    whole = F.aggregate(steps(F.length(a)), F.struct(first.alias("above"), first.alias("two")), row, lambda s: F.get(s["above"], F.length(b)))
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(whole)
