"""Trimming of line streams: arrays of lines in, arrays of lines out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.operators.memory import compacted_json

#: Fixed value: what stands where lines were left out.
MARKER = "… (%d lines trimmed) …"
#: A result this many bytes longer than its input is given up.
ABANDON = 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def head(lines: Column, n: int) -> Column:
    return F.slice(lines, 1, n)


def tail(lines: Column, n: int) -> Column:
    size = F.size(lines)
    return F.when(size > n, F.slice(lines, size - n + 1, F.lit(n))).otherwise(lines)


def sandwich(lines: Column, first: int, last: int, over: int | None = None, marker: str | None = None) -> Column:
    """The first and last lines around a marker, where there are more than `over` (first + last if None)."""
    size = F.size(lines)
    between = F.lit(marker) if marker is not None else F.format_string(MARKER, size - (first + last))
    return F.when(size > (first + last if over is None else over), F.concat(F.slice(lines, 1, first), F.array(between), F.slice(lines, -last, last))).otherwise(lines)


def dropping(lines: Column, *patterns: str) -> Column:
    """Lines that match none of the patterns."""
    return F.filter(lines, lambda x: ~F.rlike(x, F.lit("|".join(f"(?:{p})" for p in patterns))))


def keeping(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda x: F.rlike(x, F.lit(pattern)))


def without_blanks(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~F.rlike(x, F.lit(r"(?U)^\s*$")))


def distinct(lines: Column) -> Column:
    return F.array_distinct(lines)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value found once however often f names it: lambdas don't share what stands outside them."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapsed(lines: Column) -> Column:
    """Runs of one line as `line (xN)`."""

    def runs(own: Column) -> Column:
        def of(at: Column) -> Column:
            n = lambda i, k: F.coalesce(F.get(at, k + 1), F.size(own) + 1) - i
            return F.transform(at, lambda i, k: F.when(n(i, k) > 1, F.format_string("%s (x%d)", F.get(own, i - 1), n(i, k))).otherwise(F.get(own, i - 1)))

        return bound(F.filter(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), lambda i: (i == 1) | (F.get(own, i - 1) != F.get(own, i - 2))), of)

    return F.when(F.size(lines) < 2, lines).otherwise(bound(lines, runs))


def has_scope_flag(args: Column, flags: tuple[str, ...]) -> Column:
    """Whether any argument is one of the flags, alone or with a value after `=`."""
    return F.exists(args, lambda a: F.coalesce(a.isin(*flags) | F.lit(False), F.lit(False)) | F.exists(F.array(*[F.lit(f"{f}=") for f in flags]), lambda f: F.startswith(a, f)))


# Arguments of an HTTP client whose output isn't a body alone.
BODY_SCOPE = ("-v", "--verbose", "-i", "--include", "-D", "--dump-header", "-o", "--output", "-O", "--remote-name", "--trace", "--trace-ascii")

Filter = Callable[[Column], Column]


def json_body(text: Column, args: Column) -> Column:
    """An HTTP response without white space, if it is a JSON object or array, that makes it shorter and no argument asks for more than a body."""
    body = text.rlike(r"^\s*[\[{]")
    return F.when(~has_scope_flag(args, BODY_SCOPE) & body, compacted_json(F.when(body, text))).otherwise(text)  # Python gets no other texts, whatever the branch


@dataclass
class Registry:
    """Filters by command and subcommand; the tightest match wins, then the highest priority, then the first registered."""

    rows: list[tuple[str, str | None, int, Filter]] = field(default_factory=list)

    def register(self, command: str, subcommand: str | None, apply: Filter, priority: int = 50) -> None:
        self.rows.append((command, subcommand, priority, apply))

    def find(self, command: str, subcommand: str | None) -> Filter | None:
        fits = [(s is not None, p, -i) for i, (cmd, s, p, _) in enumerate(self.rows) if cmd == command and s in (None, subcommand)]
        return self.rows[-max(fits)[2]][3] if fits else None

    def dispatch(self, command: Column, subcommand: Column, lines: Column) -> Column:
        """Each row's lines through its own filter; rows without one stay as they are."""
        out = F.when(F.lit(False), lines)
        for _, _, f in sorted(((-(s is not None), -p, i) for i, (_, s, p, _) in enumerate(self.rows))):
            cmd, sub, _, apply = self.rows[f]
            hit = (command == cmd) if sub is None else (command == cmd) & (subcommand == sub)
            out = out.when(hit, apply(lines))
        return out.otherwise(lines)


def trimmed(before: Column, after: Column) -> Column:
    """`after`, unless it is longer than `before` by more than ABANDON bytes."""
    size = lambda x: F.octet_length(F.array_join(x, "\n"))
    return F.when(size(after) > size(before) + ABANDON, before).otherwise(after)
