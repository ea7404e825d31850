"""Queries over line-stream trimming and user filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import handlers as H
from skein.operators import lines as L
from skein.plans.registry import query

c = F.col
_LINES = "(SELECT doc_id, source, string_split(text, chr(10)) AS l FROM {documents})"


def lines(t):
    return t.documents.select("doc_id", "source", L.lines_of(c("text")).alias("l"))


def joined(x):
    return F.array_join(x, "\n").alias("body")


@query("l01_head_tail", f"SELECT doc_id, array_to_string(l[1:3], chr(10)) AS head, array_to_string(l[-2:], chr(10)) AS tail FROM {_LINES}")
def _(t):
    return lines(t).select("doc_id", F.array_join(L.head(c("l"), 3), "\n").alias("head"), F.array_join(L.tail(c("l"), 2), "\n").alias("tail"))


@query("l01_grep_out", f"SELECT doc_id, array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, 'the|les') AND trim(x) <> ''), chr(10)) AS body FROM {_LINES}")
def _(t):
    return lines(t).select("doc_id", joined(L.without_blanks(L.dropping(c("l"), "the", "les"))))


@query("l01_distinct_count", f"SELECT doc_id, CAST(len(list_distinct(l)) AS BIGINT) AS n FROM {_LINES}")
def _(t):
    return lines(t).select("doc_id", F.size(L.distinct(c("l"))).cast("long").alias("n"))


@query("l01_collapsed_runs", "SELECT user_id, string_agg(CASE WHEN n > 1 THEN concat(event_type, ' (x', n, ')') ELSE event_type END, ' ' ORDER BY run) AS body FROM (SELECT user_id, run, event_type, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM {events})) GROUP BY user_id, run, event_type) GROUP BY user_id")
def _(t):
    own = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("l"))
    return own.select("user_id", F.array_join(L.collapsed(c("l")), " ").alias("body"))


_BLANK = r"'^\s*$'"
# the words of each text, one a line, and two hints among them
_STREAM = """o AS (SELECT doc_id, concat('  (use "git add <file>..." to update)', chr(10), replace(text, ' ', chr(10)), chr(10), chr(10), '(use "git help" for more)', chr(10)) AS t FROM {documents}),
    w AS (SELECT doc_id, t, l[1:len(l) - 1] AS l FROM (SELECT doc_id, t, string_split(t, chr(10)) AS l FROM o))"""
_JOIN = "CASE WHEN len(%s) = 0 THEN '' ELSE concat(array_to_string(%s, chr(10)), chr(10)) END"


def _sandwich(l: str, first: int, last: int) -> str:
    return f"CASE WHEN len({l}) > {first + last} THEN list_concat({l}[1:{first}], [concat('… (', len({l}) - {first + last}, ' lines trimmed) …')], {l}[len({l}) - {last - 1}:len({l})]) ELSE {l} END"


def _dropped(l: str, *patterns: str) -> str:
    return f"list_filter({l}, lambda x: NOT ({' OR '.join(f'regexp_matches(x, {p})' for p in patterns)}))"


def _rejoined(l: str) -> str:
    return _JOIN % (l, l)


def streams(t):
    text = F.concat(F.lit('  (use "git add <file>..." to update)\n'), F.replace("text", F.lit(" "), F.lit("\n")), F.lit('\n\n(use "git help" for more)\n'))
    return t.documents.select("doc_id", text.alias("t"))


def _digest(body):
    return F.sha2(body, 256).alias("body")


_HINT = """'^\\s*\\(use "git (add|restore|rm)'"""
_NODE = tuple(f"'{p}'" for p in (r"^npm (notice|WARN deprecated|fund|audit)", "^(⠋|⠙|⠹|⠸|⠼|⠴|⠦|⠧|⠇|⠏)", r"^\s*$", r"^\[#+\s*\]", "^Progress: resolved"))
_PIP = tuple(f"'{p}'" for p in (r"^\s*Requirement already satisfied:", "^Collecting ", "^Downloading ", "^  Downloading ", "^  Using cached ", r"^\s*$"))


@query(
    "l02_dispatch",
    f"WITH {_STREAM} SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN {_rejoined(_dropped('l', _HINT))} WHEN 1 THEN {_rejoined(_dropped('l', *_NODE))} ELSE t END) AS body FROM w",
)
def _(t):
    command = F.when(c("doc_id") % 3 == 0, "git").when(c("doc_id") % 3 == 1, "npm").otherwise("other")
    return streams(t).select("doc_id", _digest(H.handled(command, F.lit("status"), F.array(F.lit("status")), c("t"), F.lit(False), H.of("git", "npm"))))


_LOG, _SHOW = _dropped("l[1:40]", _BLANK), f"CASE WHEN len(l) > 150 THEN list_concat(l[1:8], {_sandwich('l[9:len(l)]', 80, 40)}) ELSE l END"


@query(
    "l02_git",
    f"""WITH {_STREAM}, g AS (SELECT doc_id, t, l, doc_id % 5 AS sub, doc_id % 7 = 0 AS strict, doc_id % 11 = 0 AS scoped FROM w)
    SELECT doc_id, sha256(CASE WHEN scoped THEN t WHEN sub = 0 AND strict THEN {_rejoined(_dropped('l', _BLANK))} WHEN sub = 0 THEN {_rejoined(_LOG)} WHEN sub = 2 THEN {_rejoined(_dropped('l', _HINT))}
        WHEN strict THEN t WHEN sub = 1 THEN {_rejoined(_sandwich('l', 120, 40))} WHEN sub = 3 THEN {_rejoined('l[1:60]')} ELSE {_rejoined(_SHOW)} END) AS body FROM g""",
)
def _(t):
    """The five git handlers, by turns in strict mode and with one of their scope flags."""
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (c("doc_id") % 5 + 1).cast("int"))
    sub = pick("log", "diff", "status", "blame", "show")
    args = F.array(sub, F.when(c("doc_id") % 11 == 0, pick("--max-count=5", "--stat", "--porcelain", "-L", "--patch")).otherwise("--oneline"))
    return streams(t).select("doc_id", _digest(H.handled(F.lit("git"), sub, args, c("t"), c("doc_id") % 7 == 0, H.of("git"))))


_CARGO_TEXT = "concat('   Compiling a v1', chr(10), replace(text, ' ', concat(chr(10), '   Fresh ')), chr(10), chr(9), chr(10), 'Documenting x', chr(10), 'Compilingx stays', chr(10), 'Locking stays', chr(10), text)"
_CARGO = r"'^\s*(Compiling|Checking|Downloaded|Downloading|Updating|Blocking|Fresh|Documenting|Compiling)\b'"


@query(
    "l03_build_noise",
    f"""WITH o AS (SELECT doc_id, {_CARGO_TEXT} AS t FROM {{documents}}), w AS (SELECT doc_id, t, CASE WHEN ends_with(t, chr(10)) THEN l[1:len(l) - 1] ELSE l END AS l FROM (SELECT *, string_split(t, chr(10)) AS l FROM o))
    SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 3 OR doc_id % 5 = 0 THEN t ELSE {_rejoined(_dropped('l', _CARGO, _BLANK))} END) AS body FROM w""",
)
def _(t):
    rows = t.documents.select("doc_id", F.expr(_CARGO_TEXT.replace("chr(10)", r"'\n'").replace("chr(9)", r"'\t'")).alias("t"))
    sub = F.when(c("doc_id") % 4 == 3, "publish").otherwise("clippy")
    args = F.array(sub, F.when(c("doc_id") % 5 == 0, "--message-format=json").otherwise("--release"))
    return rows.select("doc_id", _digest(H.handled(F.lit("cargo"), sub, args, c("t"), F.lit(False), H.of("cargo"), errors=True)))


_RUNS = """x AS (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM w), y AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM v THEN 1 ELSE 0 END AS new FROM x),
    z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM y), r AS (SELECT doc_id, run, any_value(v) AS v, count(*) AS n FROM z GROUP BY doc_id, run),
    k AS (SELECT doc_id, list(CASE WHEN n > 1 THEN concat(v, ' (x', n, ')') ELSE v END ORDER BY run) AS c, list(v ORDER BY run) AS d FROM r GROUP BY doc_id)"""


def _over(l: str, least: int, kept: str) -> str:
    return f"CASE WHEN len({l}) > {least} THEN {_rejoined(kept)} ELSE t END"


@query(
    "l04_fs",
    f"""WITH {_STREAM}, {_RUNS}, q AS (SELECT *, doc_id % 4 AS cmd, doc_id % 7 = 0 AS strict FROM w JOIN k USING (doc_id))
    SELECT doc_id, sha256(CASE WHEN cmd = 2 AND strict THEN CASE WHEN d = l THEN t ELSE {_rejoined('d')} END WHEN strict THEN t
        WHEN cmd = 0 THEN {_over('l', 200, _sandwich('l', 80, 40))} WHEN cmd = 1 THEN {_over('l', 500, "list_concat(l[1:500], [concat('… (', len(l) - 500, ' more lines — use Read tool for full) …')])")}
        WHEN cmd = 3 THEN {_over('l', 300, _sandwich('l', 200, 60))} WHEN len(c) > 300 THEN {_rejoined(_sandwich('c', 200, 60))} WHEN c = l THEN t ELSE {_rejoined('c')} END) AS body FROM q""",
)
def _(t):
    """ls, cat, grep and find over the words of the texts, by turns in strict mode."""
    command = F.element_at(F.array(*[F.lit(v) for v in ("ls", "cat", "rg", "find")]), (c("doc_id") % 4 + 1).cast("int"))
    return streams(t).select("doc_id", _digest(H.handled(command, F.lit(None).cast("string"), F.array(F.lit("x")), c("t"), c("doc_id") % 7 == 0, H.of("ls", "cat", "rg", "find"))))


_PKG_TEXT = "concat('Collecting a', chr(10), 'npm WARN deprecated b', chr(10), 'npm notice c', chr(10), 'added 3 packages', chr(10), '[### ] 45%', chr(10), 'Progress: resolved 1', chr(10), '  Using cached d', chr(10), '⠋ idle', chr(10), text, chr(10), 'npm fund', chr(10), 'up to date')"


@query(
    "l05_packages",
    f"""WITH o AS (SELECT doc_id, {_PKG_TEXT} AS t FROM {{documents}}), w AS (SELECT doc_id, t, string_split(t, chr(10)) AS l FROM o)
    SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN t WHEN doc_id % 5 < 3 THEN {_rejoined(_dropped('l', *_NODE))} ELSE {_rejoined(_dropped('l', *_PIP))} END) AS body FROM w""",
)
def _(t):
    rows = t.documents.select("doc_id", F.expr(_PKG_TEXT.replace("chr(10)", r"'\n'")).alias("t"))
    command = F.element_at(F.array(*[F.lit(v) for v in ("npm", "pnpm", "yarn", "pip", "pip3")]), (c("doc_id") % 5 + 1).cast("int"))
    args = F.array(F.lit("install"), F.when(c("doc_id") % 11 == 0, F.when(c("doc_id") % 5 < 3, "--json").otherwise("-q")).otherwise("--save"))
    return rows.select("doc_id", _digest(H.handled(command, F.lit("install"), args, c("t"), c("doc_id") % 7 == 0, H.of("npm", "pnpm", "yarn", "pip", "pip3"))))


@query("l09_capture_cap", "SELECT doc_id, sha256(encode(text)[1:400]) AS head, strlen(text) > 400 AS cut, strlen(text) > 40 AS warned FROM {documents}")
def _(t):
    out = t.documents.select("doc_id", H.captured(c("text"), 400, 40).alias("o"))
    return out.select("doc_id", F.sha2("o.head", 256).alias("head"), "o.cut", "o.warned")


@query("l07_scope_flags", "SELECT doc_id, doc_id % 4 IN (1, 2) AS bypass FROM {documents}")
def _(t):
    args = F.array(F.lit("log"), F.when(c("doc_id") % 4 == 1, "--max-count=5").when(c("doc_id") % 4 == 2, "-n").otherwise("--name"))
    return t.documents.select("doc_id", L.has_scope_flag(args, ("-n", "--max-count")).alias("bypass"))


@query("l08_abandon_rule", f"SELECT doc_id, CASE WHEN strlen(array_to_string(list_concat(l, [repeat('x', CAST(doc_id % 200 AS BIGINT))]), chr(10))) > strlen(array_to_string(l, chr(10))) + 64 THEN 'kept' ELSE 'trimmed' END AS outcome FROM {_LINES}")
def _(t):
    longer = F.concat("l", F.array(F.expr("repeat('x', CAST(doc_id % 200 AS INT))")))
    return lines(t).select("doc_id", F.when(F.size(L.trimmed(c("l"), longer)) == F.size("l"), "kept").otherwise("trimmed").alias("outcome"))


@query("l10_trim_report", "SELECT doc_id, concat('before=', strlen(text), ' after=', least(strlen(text), 500), ' saved=', CAST(floor(100 - least(strlen(text), 500) * 100 / strlen(text)) AS BIGINT), '%') AS report FROM {documents}")
def _(t):
    """Of an empty text nothing is saved; what isn't known of a null text is left out, as the SQL does."""
    n = F.octet_length("text")
    after = F.least(n, F.lit(500))
    saved = F.when(n == 0, F.lit(0)).otherwise(F.floor(100 - after * 100 / n))
    known = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return t.documents.select("doc_id", F.concat(F.lit("before="), known(n), F.lit(" after="), known(after), F.lit(" saved="), known(saved), F.lit("%")).alias("report"))


@query("e01_user_filters", f"SELECT doc_id, array_to_string(CASE WHEN source = 'src1' THEN l[1:2] ELSE l[1:1] END, chr(10)) AS body FROM {_LINES} WHERE source IN ('src1', 'src2')")
def _(t):
    r = L.Registry()
    r.register("src1", None, lambda x: L.head(x, 1), priority=10)
    r.register("src1", "log", lambda x: L.head(x, 2), priority=1)
    r.register("src2", None, lambda x: L.head(x, 1))
    own = lines(t).filter(c("source").isin("src1", "src2"))
    return own.select("doc_id", joined(r.dispatch(c("source"), F.lit("log"), c("l"))))
