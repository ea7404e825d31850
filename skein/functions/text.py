"""Text expressions: tokens, similarity, identifiers, normalisation. All are built-in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that say nothing about what a short text is about.
STOP_WORDS = ("when", "before", "after", "during", "while", "whenever", "the", "and", "for", "any", "all", "new", "old", "also", "not", "from", "with", "into", "onto", "out")
# Default patterns of symbol mentions; each has one group.
SYMBOL_PATTERNS = (r"fn\s+([A-Za-z_]\w*)", r"def\s+([A-Za-z_]\w*)", r"class\s+([A-Za-z_]\w*)", r"struct\s+([A-Za-z_]\w*)", r"function\s+([A-Za-z_]\w*)", r"func\s+([A-Za-z_]\w*)")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def recall_tokens(c: Column) -> Column:
    """Query tokens: runs of letters, digits, `_` and `:`, in lower case, of three bytes or more."""
    return F.filter(F.split(ascii_lower(c), r"[^\p{L}\p{N}_:]+"), lambda t: F.octet_length(t) >= 3)


def similarity_tokens(c: Column) -> Column:
    """Distinct ASCII words of three letters or more that are neither numbers nor stop words."""
    words = F.split(ascii_lower(c), "[^A-Za-z0-9_]+")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~t.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def last_segment(c: Column, separator: str = "::") -> Column:
    return F.element_at(F.split(c, separator), -1)


def module_of(c: Column) -> Column:
    """The part of an identifier before its last `::`; the whole where there is none."""
    return F.when(c.contains("::"), F.regexp_extract(c, "^(.*)::[^:]*$", 1)).otherwise(c)


def normalized(c: Column) -> Column:
    """Lower case, and white space as single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(c), r"[ \t\n\r\f\v]+", " "))


def without_ansi(c: Column) -> Column:
    """Terminal control sequences removed; incomplete ones stay."""
    return F.regexp_replace(c, "\x1b\\[[0-9;?]*[ -/]*[@-~]|\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)|\x1b[PX^_][^\x1b]*\x1b\\\\|\x1b[@-Z\\\\-_]", "")


def language_of(path: Column) -> Column:
    ext = F.regexp_extract(ascii_lower(path), r"\.([^./]+)$", 1)
    return F.when(ext == "rs", "rust").when(ext.isin("py", "pyi"), "python").when(ext.isin("js", "jsx", "mjs", "cjs"), "javascript").when(ext.isin("ts", "tsx", "mts", "cts"), "typescript").when(ext == "go", "go")


def is_source_file(path: Column) -> Column:
    return path.rlike(r"\.(rs|ts|tsx|js|jsx|py|go|java|c|cpp|h|hpp|rb|swift|kt)$")


def same_file(a: Column, b: Column) -> Column:
    """Equal but for a leading `./`, or one is the end of the other at a `/`, with a `/` of its own."""
    x, y = F.regexp_replace(a, r"^\./", ""), F.regexp_replace(b, r"^\./", "")
    ends = lambda long, short: long.endswith(F.concat(F.lit("/"), short)) & short.contains("/")
    return (x == y) | ends(x, y) | ends(y, x)


def path_matches(a: Column, b: Column) -> Column:
    """One path's components, without `.`, are the last components of the other."""
    parts = lambda c: F.concat(F.lit("/"), F.array_join(F.filter(F.split(c, "/"), lambda p: ~p.isin("", ".")), "/"))
    x, y = parts(a), parts(b)
    return x.endswith(y) | y.endswith(x)


def glob_at_ends(value: Column, glob: str) -> Column:
    """A glob that has `*` at its ends only; `*` alone matches all."""
    body = glob.strip("*")
    if glob and not body:
        return F.lit(True)
    if glob.startswith("*") and glob.endswith("*"):
        return value.contains(body)
    if glob.startswith("*"):
        return value.endswith(body)
    return value.startswith(body) if glob.endswith("*") else value == glob


def content_policy(c: Column) -> Column:
    """Why a short memory isn't worth keeping, or null: a session handoff, or a bare commit id, date or path without a reason in it."""
    text = F.trim(c)
    low = ascii_lower(text)
    bare = F.regexp_replace(text, r"[ \t\n\r.,:]", "")
    digits = F.regexp_replace(text, "[^0-9]", "")
    reasoned = F.lit(False)
    for word in ("always", "must", "never", "because", "so that"):
        reasoned = reasoned | low.contains(word)
    return (
        F.when(text == "", None)
        .when(low.rlike(r"^session 20[0-9]{2}-[0-9]{2}-[0-9]{2}[ \t]*shipped"), "session_handoff")
        .when(reasoned, None)
        .when(bare.rlike("^[0-9a-fA-F]{7,40}$") & bare.rlike("[a-fA-F]"), "commit_sha_only")
        .when((F.octet_length(text) <= 32) & (F.length(digits) == 8) & text.rlike("20[0-9]{2}-[0-9]{2}-[0-9]{2}"), "date_only")
        .when(~text.contains(" ") & text.contains("/") & text.contains("."), "path_only")
    )


def mentioned_symbols(c: Column, patterns: tuple[str, ...] = SYMBOL_PATTERNS) -> Column:
    """Names that match any of the patterns, each once, in order of pattern and place."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns])))


def spans_of_lines(c: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1 and both included, each with its line end."""
    lines = F.slice(F.split(c, "\n"), start, end - start + 1)
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def preview(c: Column, lines: int = 3) -> Column:
    """The first lines that aren't blank, trimmed."""
    return F.array_join(F.slice(F.filter(F.transform(F.split(c, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\v"))), lambda x: x != ""), 1, lines), " ⏎ ")


def truncated_path(c: Column, keep: int = 4) -> Column:
    """head/.../the last two components, where there are more than `keep`."""
    p = F.split(c, "/")
    return F.when(F.size(p) > keep, F.concat_ws("/", F.element_at(p, 1), F.lit("…"), F.element_at(p, -2), F.element_at(p, -1))).otherwise(c)
