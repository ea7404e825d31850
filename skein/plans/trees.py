"""Queries over ignore rules and plan paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators.paths import repaired
from skein.plans.registry import query
from skein.sources import ignores as I

c = F.col
# the files of a tree: a folder for each user's last digit, one below it for each type of event
_FILES = "SELECT DISTINCT concat('a', user_id % 5, '/', event_type, '/f', event_id % 97, CASE event_id % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.log' WHEN 2 THEN '.tmp' ELSE '.md' END) AS path FROM {events}"


@query(
    "s01_ignored_paths",
    f"""WITH f AS ({_FILES}) SELECT path FROM f WHERE split_part(path, '/', 2) = 'error' OR starts_with(path, 'a1/view/') OR (ends_with(path, '.log') AND NOT starts_with(path, 'a2/'))
    OR (starts_with(path, 'a2/') AND ends_with(path, '.tmp') AND path NOT IN ('a2/click/f6.tmp', 'a2/click/f70.tmp')) OR starts_with(path, 'a4/')""",
)
def _(t):
    """Nested ignore files: a deeper one brings back what a higher one leaves out, but nothing of an ignored folder."""
    files = t.spark.sql(_FILES, events=t.events)
    own = {".gitignore": "# built\n*.log\nerror/\n/a1/view", "a2/.gitignore": "!*.log\n*.tmp\n!error/f1.rs", "a2/click/.gitignore": "!f6.tmp\n!f70.tmp", "a4/.ignore": "*\n", "a4/view/.gitignore": "!*"}
    rules = I.rules(t.spark.createDataFrame(list(own.items()), "path string, text string"))
    return I.ignored_paths(files, rules)


_PLAN = """SELECT doc_id AS task, CASE doc_id % 7 WHEN 0 THEN concat(source, '/d', doc_id, '.md') WHEN 1 THEN concat('d', doc_id, '.md') WHEN 2 THEN concat('/ws/x/d', doc_id, '.md') WHEN 3 THEN concat('/other/d', doc_id, '.md:1-9')
    WHEN 4 THEN concat('new/z', doc_id, '.md') WHEN 5 THEN concat('/ws/', source, '/d', doc_id, '.md') ELSE concat(doc_id % 10, '.md') END AS path FROM {documents}"""


@query(
    "v03_path_repair",
    f"""WITH i AS (SELECT concat(source, '/d', doc_id, '.md') AS f FROM {{documents}}), p AS ({_PLAN}),
    q AS (SELECT task, path, regexp_replace(path, ':1-9$', '') AS bare, CASE WHEN starts_with(path, '/other') THEN NULL ELSE regexp_replace(regexp_replace(path, ':1-9$', ''), '^/ws/', '') END AS inside FROM p),
    e AS (SELECT query, count(*) AS n, min(f) AS f FROM (SELECT DISTINCT inside AS query FROM q WHERE inside IS NOT NULL) JOIN i ON ends_with(f, query) GROUP BY query),
    l AS (SELECT split_part(f, '/', -1) AS leaf, count(*) AS n, min(f) AS f FROM i GROUP BY leaf),
    r AS (SELECT q.*, inside IN (SELECT f FROM i) AS there, CASE WHEN e.n = 1 THEN e.f ELSE CASE WHEN l.n = 1 THEN l.f END END AS m FROM q LEFT JOIN e ON e.query = inside LEFT JOIN l ON l.leaf = split_part(bare, '/', -1))
    SELECT task, path, CASE WHEN starts_with(path, '/ws') THEN concat('/ws/', m) WHEN starts_with(path, '/') THEN concat('/ws/', m, ':1-9') WHEN there OR m IS NULL THEN concat('/ws/', bare) ELSE concat('/ws/', m) END AS new,
        CASE WHEN starts_with(path, '/ws') THEN concat('fuzzy:', inside, '→', m) WHEN starts_with(path, '/') THEN concat('fuzzy_filename:', split_part(bare, '/', -1), '→', m) WHEN there THEN 'relative→absolute'
             WHEN m IS NULL THEN 'relative→absolute(new file)' ELSE concat('relative+fuzzy:', bare, '→', m) END AS reason
    FROM r WHERE NOT (starts_with(path, '/') AND (coalesce(there, false) OR m IS NULL))""",
)
def _(t):
    index = t.documents.select(F.concat("source", F.lit("/d"), "doc_id", F.lit(".md")).alias("path"))
    return repaired(t.spark.sql(_PLAN, documents=t.documents), index, "/ws")
