"""Built-in handlers of noisy commands: which lines of a command's output are worth keeping.

A handler belongs to a command and maybe a subcommand. It leaves an output alone if an argument says how much of it is wanted (its scope
flags), and in strict mode does no more than it can without loss.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.operators import lines as L

Filter = Callable[[Column], Column]
BLANK = r"(?U)^\s*$"

# Arguments that say how much of an output is wanted.
GIT_LOG_SCOPE = ("--reverse", "-n", "--max-count", "--all", "--follow", "--grep", "-p", "--patch")
GIT_DIFF_SCOPE = ("--stat", "--name-only", "--name-status", "--full-diff", "-U", "--unified")
GIT_STATUS_SCOPE = ("-v", "--verbose", "--porcelain", "-z", "--long")
GIT_BLAME_SCOPE = ("-L", "--reverse", "-p", "--porcelain")
GIT_SHOW_SCOPE = ("--stat", "--name-only", "-p", "--patch")
CARGO_SCOPE = ("--message-format", "-v", "--verbose", "-vv", "--nocapture", "--show-output")
CAT_SCOPE = ("-v", "-A", "-e", "-E", "--show-all")
GREP_SCOPE = ("-c", "--count", "-l", "--files-with-matches", "-L", "--files-without-match", "-m", "--max-count", "--json")
FIND_SCOPE = ("-maxdepth", "-mindepth", "-printf", "-fprint", "-fprintf")
NODE_SCOPE = ("-d", "--loglevel", "--verbose", "--silent", "--json", "--parseable")
PIP_SCOPE = ("-v", "-vv", "-vvv", "--verbose", "-q", "--quiet")

# Lines that say nothing.
GIT_HINT = r'^\s*\(use "git (add|restore|rm)'
CARGO_NOISE = r"^\s*(Compiling|Checking|Downloaded|Downloading|Updating|Blocking|Fresh|Documenting|Compiling)\b"
NODE_NOISE = (r"^npm (notice|WARN deprecated|fund|audit)", r"^(⠋|⠙|⠹|⠸|⠼|⠴|⠦|⠧|⠇|⠏)", r"^\s*$", r"^\[#+\s*\]", r"^Progress: resolved")
PIP_NOISE = (r"^\s*Requirement already satisfied:", r"^Collecting ", r"^Downloading ", r"^  Downloading ", r"^  Using cached ", r"^\s*$")
#: Fixed value: what follows the head of a file.
MORE = "… (%d more lines — use Read tool for full) …"


def stream_lines(text: Column) -> Column:
    """Lines of a stream; a line end at its end begins no further line, and an empty stream has none."""
    split = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)


def stream(lines: Column) -> Column:
    """Lines as a stream again, each with its line end."""
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def without_blanks(lines: Column) -> Column:
    return L.dropping(lines, BLANK)


def headed_diff(lines: Column) -> Column:
    """A header of 8 lines and the ends of what follows, where there are more than 150."""
    rest = F.slice(lines, F.lit(9), F.greatest(F.size(lines) - 8, F.lit(0)))
    return F.when(F.size(lines) > 150, F.concat(L.head(lines, 8), L.sandwich(rest, 80, 40))).otherwise(lines)


def file_head(lines: Column) -> Column:
    return F.when(F.size(lines) > 500, F.concat(L.head(lines, 500), F.array(F.format_string(MORE, F.size(lines) - 500)))).otherwise(lines)


def without_repeats(lines: Column) -> Column:
    """One line of each run of equal ones."""
    return L.bound(lines, lambda own: F.filter(own, lambda x, i: (i == 0) | (x != F.get(own, i - 1))))


@dataclass(frozen=True)
class Handler:
    """`loose` is what becomes of the lines, `strict` in strict mode; None leaves the output as it is, and so do scope flags. Where
    `rewrites` is false, an output that loses no line keeps its very bytes; `both` takes the error stream along."""

    command: str
    subcommand: str | None
    loose: Filter | None
    strict: Filter | None = None
    scope: tuple[str, ...] = ()
    priority: int = 50
    rewrites: bool = True
    both: bool = False

    def output(self, text: Column, args: Column, strict: Column) -> Column:
        def through(f: Filter | None) -> Column:
            if f is None:
                return text
            if self.rewrites:
                return L.bound(stream_lines(text), lambda lines: L.bound(f(lines), stream))
            return L.bound(stream_lines(text), lambda lines: L.bound(f(lines), lambda out: F.when(out == lines, text).otherwise(stream(out))))

        out = F.when(strict, through(self.strict)).otherwise(through(self.loose))
        return F.when(L.has_scope_flag(args, self.scope), text).otherwise(out) if self.scope else out


def _log(lines: Column) -> Column:
    return without_blanks(L.head(lines, 40))


def _diff(lines: Column) -> Column:
    return L.sandwich(lines, 120, 40)


def _status(lines: Column) -> Column:
    return L.dropping(lines, GIT_HINT)


def _blame(lines: Column) -> Column:
    return L.head(lines, 60)


def _cargo(lines: Column) -> Column:
    return without_blanks(L.dropping(lines, CARGO_NOISE))


def _listing(lines: Column) -> Column:
    return L.sandwich(lines, 80, 40, 200)


def _found(lines: Column) -> Column:
    return L.sandwich(lines, 200, 60, 300)


def _matches(lines: Column) -> Column:
    return _found(L.collapsed(lines))


def _node(lines: Column) -> Column:
    return L.dropping(lines, *NODE_NOISE)


def _pip(lines: Column) -> Column:
    return L.dropping(lines, *PIP_NOISE)


HANDLERS = (
    Handler("git", "log", _log, without_blanks, GIT_LOG_SCOPE),
    Handler("git", "diff", _diff, None, GIT_DIFF_SCOPE),
    Handler("git", "status", _status, _status, GIT_STATUS_SCOPE),
    Handler("git", "blame", _blame, None, GIT_BLAME_SCOPE),
    Handler("git", "show", headed_diff, None, GIT_SHOW_SCOPE),
    Handler("git", None, None, priority=0),
    *(Handler("cargo", s, _cargo, None, CARGO_SCOPE, both=True) for s in ("build", "check", "test", "clippy", "run")),
    Handler("cargo", None, None, priority=0),
    Handler("ls", None, _listing, rewrites=False),
    Handler("cat", None, file_head, None, CAT_SCOPE, rewrites=False),
    *(Handler(c, None, _matches, without_repeats, GREP_SCOPE, rewrites=False) for c in ("grep", "rg")),
    Handler("find", None, _found, None, FIND_SCOPE, rewrites=False),
    *(Handler(c, None, _node, None, NODE_SCOPE, both=True) for c in ("npm", "pnpm", "yarn")),
    *(Handler(c, None, _pip, None, PIP_SCOPE, both=True) for c in ("pip", "pip3")),
)


def of(*commands: str) -> tuple[Handler, ...]:
    """The built-in handlers of some commands: a smaller expression where others can't occur."""
    return tuple(h for h in HANDLERS if h.command in commands)


def handled(command: Column, subcommand: Column, args: Column, text: Column, strict: Column, handlers: tuple[Handler, ...] = HANDLERS, errors: bool = False) -> Column:
    """The output that a command's handler leaves: that of its subcommand before that of the command, the higher priority, then the first.

    `curl` compacts a JSON body. `errors` says that `text` is an error stream, which most handlers leave alone. Commands without a handler
    and null outputs stay as they are.
    """
    rows: dict[tuple, list[Handler]] = {}
    for h in sorted(handlers, key=lambda h: (h.subcommand is None, -h.priority)):  # what does the same is one branch
        rows.setdefault((h.subcommand is None, h.priority, h.loose, h.strict, h.scope, h.rewrites, h.both), []).append(h)
    out = F.when(F.lit(False), text)
    for same in rows.values():
        hit = F.lit(False)
        for h in same:
            hit = hit | (command == h.command if h.subcommand is None else (command == h.command) & (subcommand == h.subcommand))
        out = out.when(hit, text if errors and not same[0].both else same[0].output(text, args, strict))
    if not errors:
        out = out.when(command == "curl", L.json_body(F.when(command == "curl", text), args))
    return out.otherwise(text)


def captured(text: Column, cap: int = 100 << 20, warn: int = 10 << 20) -> Column:
    """(head, cut, warned): the first `cap` bytes of an output, whether there were more, and whether it passed `warn` bytes."""
    size = F.octet_length(text)
    return F.struct(F.substring(text.cast("binary"), 1, cap).alias("head"), (size > cap).alias("cut"), (size > warn).alias("warned"))
