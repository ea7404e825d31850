"""Queries over code files, which are written from the parts table: Rust for odd parts, Python for even ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import code as K
from skein.plans.registry import query
from skein.sources.storage import written

c = F.col
_FILES = """SELECT CASE WHEN p_partkey % 2 = 1 THEN concat('crates/shop-', p_partkey % 3, '/src/p', p_partkey, '.rs') ELSE concat('py/p', p_partkey, '.py') END AS path,
  CASE WHEN p_partkey % 2 = 1 THEN concat('use crate::dep::f', p_partkey + 1, ';', chr(10), chr(10), '/// Makes ', p_size, ' of them.', chr(10), 'pub fn f', p_partkey, '(n: u64) -> Box', p_partkey, ' ', chr(123), chr(10), '    bus.emit("made", n);', chr(10), '    f', p_partkey + 1, '(n) // done(n)', chr(10), chr(125), chr(10), chr(10),
    'impl Show for Box', p_partkey, ' ', chr(123), chr(10), '    fn show(&self) -> u64 ', chr(123), ' f', p_partkey, '(2) ', chr(125), chr(10), chr(125), chr(10))
  ELSE concat('from dep import f', p_partkey + 1, ' as g', chr(10), 'TOPIC = "made"', chr(10), 'class C', p_partkey, '(Base):', chr(10), '    def run(self):', chr(10), '        \"\"\"Runs ', p_size, '.\"\"\"', chr(10), '        bus.on(TOPIC, g)', chr(10), '        return g(self)', chr(10)) END AS content, p_partkey AS k, p_size AS size FROM {part}"""
_SYMBOLS = """SELECT path, concat('p', k, '::f', k) AS fqn, 'Function' AS kind, 4 AS a, 7 AS b FROM f WHERE k % 2 = 1 UNION ALL SELECT path, concat('p', k, '::Box', k), 'Type', 9, 11 FROM f WHERE k % 2 = 1
  UNION ALL SELECT path, concat('p', k, '::Box', k, '::show'), 'Function', 10, 10 FROM f WHERE k % 2 = 1 UNION ALL SELECT path, concat('p', k, '::C', k), 'Type', 3, 7 FROM f WHERE k % 2 = 0 UNION ALL SELECT path, concat('p', k, '::C', k, '::run'), 'Function', 4, 7 FROM f WHERE k % 2 = 0"""


def files(t):
    return t.spark.sql(_FILES, part=t.part)


def rows(t):
    return K.parse_code(files(t))


def parsed(t, *tags):
    """Rows of these tags, written once: what reads them twice would parse twice."""
    return written(rows(t).filter(c("tag").isin(*tags)), "parsed")


@query("s05_code_symbols", f"WITH f AS ({_FILES}), s AS ({_SYMBOLS}) SELECT path, fqn, kind, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line FROM s")
def _(t):
    return rows(t).filter("tag = 'chunk'").select("path", c("a").alias("fqn"), "kind", "start_line", "end_line")


@query("k04_symbol_upsert", f"WITH f AS ({_FILES}), s AS ({_SYMBOLS}) SELECT fqn, max(CASE WHEN path LIKE '%.rs' THEN 'moved.rs' ELSE path END) AS path FROM s GROUP BY fqn")
def _(t):
    from skein.operators.relational import upsert

    have = parsed(t, "symbol").select(c("a").alias("fqn"), "path").distinct()
    changes = have.filter(c("path").endswith(".rs")).select("fqn", F.lit("moved.rs").alias("path"), F.lit(1).alias("seq"))
    return upsert(have, changes, ["fqn"], "seq")


@query("c07_module_paths", f"WITH f AS ({_FILES}) SELECT path, CASE WHEN k % 2 = 1 THEN concat('shop_', k % 3, CASE WHEN k % 3 = 0 THEN '_core' ELSE '' END, '::p', k) ELSE concat('p', k) END AS module FROM f")
def _(t):
    manifests = t.spark.createDataFrame([("crates/shop-0", "shop-0-core"), ("crates/shop-1", "shop-1"), ("crates/shop-2", "shop-2"), ("", "root")], "dir string, package string")
    return K.with_modules(files(t).select("path"), manifests)


@query("c08_import_aliases", f"WITH f AS ({_FILES}) SELECT path, CASE WHEN k % 2 = 1 THEN concat('f', k + 1) ELSE 'g' END AS local, concat(CASE WHEN k % 2 = 1 THEN 'crate::dep::f' ELSE 'dep::f' END, k + 1) AS target FROM f")
def _(t):
    return rows(t).filter("tag = 'alias'").select("path", c("a").alias("local"), c("b").alias("target"))


@query(
    "c09_calls",
    f"""WITH f AS ({_FILES}) SELECT concat('p', k, '::f', k) AS caller, 'bus::emit' AS callee FROM f WHERE k % 2 = 1 UNION ALL SELECT concat('p', k, '::f', k), concat('f', k + 1) FROM f WHERE k % 2 = 1 UNION ALL SELECT concat('p', k, '::Box', k, '::show'), concat('f', k) FROM f WHERE k % 2 = 1
    UNION ALL SELECT concat('p', k, '::C', k, '::run'), 'bus::on' FROM f WHERE k % 2 = 0 UNION ALL SELECT concat('p', k, '::C', k, '::run'), 'g' FROM f WHERE k % 2 = 0""",
)
def _(t):
    return rows(t).filter("tag = 'call'").select(c("a").alias("caller"), c("b").alias("callee"))


@query(
    "g13_code_edges",
    f"""WITH f AS ({_FILES}), e AS (SELECT concat('p', k, '::f', k) AS src, 'bus::emit' AS dst, 'calls' AS kind FROM f WHERE k % 2 = 1 UNION ALL SELECT concat('p', k, '::f', k), concat('crate::dep::f', k + 1), 'calls' FROM f WHERE k % 2 = 1
    UNION ALL SELECT concat('p', k, '::Box', k, '::show'), concat('p', k, '::f', k), 'calls' FROM f WHERE k % 2 = 1 UNION ALL SELECT concat('p', k), concat('crate::dep::f', k + 1), 'imports' FROM f WHERE k % 2 = 1
    UNION ALL SELECT concat('p', k, '::Box', k), 'Show', 'extends' FROM f WHERE k % 2 = 1 UNION ALL SELECT concat('p', k, '::Box', k), 'Show', 'references' FROM f WHERE k % 2 = 1 UNION ALL SELECT concat('p', k, '::f', k), concat('p', k, '::Box', k), 'references' FROM f WHERE k % 2 = 1
    UNION ALL SELECT concat('p', k, '::f', k), 'event::bus::made', 'emits' FROM f WHERE k % 2 = 1 UNION ALL SELECT 'event::bus::made', concat('dep::f', k + 1), 'subscribes' FROM f WHERE k % 2 = 0
    UNION ALL SELECT concat('p', k, '::C', k, '::run'), 'bus::on', 'calls' FROM f WHERE k % 2 = 0 UNION ALL SELECT concat('p', k, '::C', k, '::run'), concat('dep::f', k + 1), 'calls' FROM f WHERE k % 2 = 0
    UNION ALL SELECT concat('p', k), concat('dep::f', k + 1), 'imports' FROM f WHERE k % 2 = 0 UNION ALL SELECT concat('p', k, '::C', k), 'Base', 'extends' FROM f WHERE k % 2 = 0)
    SELECT src, dst, kind FROM e""",
)
def _(t):
    return K.code_edges(rows(t))


@query("j11_constant_folding", f"WITH f AS ({_FILES}) SELECT concat('p', k, '::C', k, '::run') AS owner, 'TOPIC' AS expression, 'made' AS topic FROM f WHERE k % 2 = 0")
def _(t):
    found = parsed(t, "const", "event")
    consts = found.filter("tag = 'const'").select("path", c("a").alias("expression"), c("b").alias("topic"))
    asked = found.filter("tag = 'event' AND kind LIKE '%?'").select("path", c("a").alias("owner"), c("b").alias("expression"))
    return asked.join(consts, ["path", "expression"]).select("owner", "expression", "topic")


@query(
    "g12_call_bridge",
    f"""WITH f AS ({_FILES}) SELECT concat('p', k, '::f', k, '#s6') AS src, concat('f', k + 1) AS dst FROM f WHERE k % 2 = 1 UNION ALL SELECT concat('p', k, '::f', k, '#s5'), 'bus::emit' FROM f WHERE k % 2 = 1
    UNION ALL SELECT concat('p', k, '::Box', k, '::show#s10'), concat('f', k) FROM f WHERE k % 2 = 1
    UNION ALL SELECT concat('p', k, '::C', k, '::run#s', n), 'g' FROM f, (VALUES (4), (5), (6), (7)) v(n) WHERE k % 2 = 0 AND n >= 6 UNION ALL SELECT concat('p', k, '::C', k, '::run#s6'), 'bus::on' FROM f WHERE k % 2 = 0""",
)
def _(t):
    found = parsed(t, "chunk", "call")
    chunks = found.filter("tag = 'chunk' AND kind = 'Function'").select(c("a").alias("fn"), "path", "start_line", "body")
    return K.call_bridges(K.body_statements(chunks), found.filter("tag = 'call'").select(c("a").alias("fn"), c("b").alias("callee")))


@query("r15_docstrings", f"WITH f AS ({_FILES}) SELECT path, concat(CASE WHEN k % 2 = 1 THEN 'Makes ' ELSE 'Runs ' END, size, CASE WHEN k % 2 = 1 THEN ' of them.' ELSE '.' END) AS doc FROM f")
def _(t):
    lines = F.split("content", "\n")
    body = F.when(c("path").endswith(".rs"), F.array_join(F.slice(lines, 3, 9), "\n")).otherwise(F.array_join(F.slice(lines, 4, 9), "\n"))
    return K.docstrings(files(t).select("path", F.lit(1).alias("start_line"), body.alias("body"))).select("path", "doc")
