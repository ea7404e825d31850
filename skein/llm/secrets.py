"""Secret scans with an incremental blob ledger.

Every historical version of a text is addressed by its content (SHA-256). Only pairs of blob and
rule version that the ledger doesn't hold yet are scanned; the ledger is a folder that each scan adds to.
Findings are then joined back to all paths that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import fresh_name, fresh_path
from skein.llm.dealt import attached

RULE_VERSION = "2026-11-1"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind: (pattern, group that must have so many characters, that many, RE2 pattern that any match contains)
BASE = {
    "assign": (f"({'|'.join(_either(w) for w in ('password', 'passwd', 'secret', 'token', 'api_?key'))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "(?i)password|passwd|secret|token|api_?key"),
    "access": ("AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12}"),
    "hex": ("[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
}
ADDED = {
    "private_key": ("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
    "code_host": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh[pousr]_[A-Za-z0-9]{36}"),
    "web_token": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, r"eyJ[A-Za-z0-9_-]{10}"),
    "chat": ("xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox[abprs]-"),
}
RULES = BASE | ADDED
_ORDER = {kind: i for i, kind in enumerate(RULES)}
_COMPILED = {kind: re.compile(re.sub(r"^\[0-9a-f\]\+$", "[0-9a-f]{32,}", p[0])) for kind, p in RULES.items()}

FINDING = "kind string, start int, end int"


def spans_of(text: str, kinds=tuple(RULES)) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed; leftmost and non-overlapping within a kind."""
    found = []
    for kind in kinds:
        _, group, least, _ = RULES[kind]
        found += [(kind, m.start(), m.end()) for m in _COMPILED[kind].finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda f: (f[1], _ORDER[f[0]]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        hits = {k: pc.match_substring_regex(batch.column(1), RULES[k][3]) for k in RULES}
        some = hits["assign"]
        for k in RULES:
            some = pc.or_(some, hits[k])
        out = [[] for _ in range(len(batch))]
        for i in pc.indices_nonzero(some).to_pylist():
            found = spans_of(batch.column(1)[i].as_py(), [k for k in RULES if hits[k][i].as_py()])
            out[i] = [{"kind": a, "start": b, "end": c} for a, b, c in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["blob", "findings"])


def blob_of(text: str = "text"):
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)


LEDGER = f"blob string, rule_version string, findings array<struct<{FINDING.replace(' string', ':string').replace(' int', ':int')}>>"
_FOUND = LEDGER.split("findings ")[1]


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, rule_version, findings) of a ledger's folder, a row for each blob and rule version; none where there is no ledger yet."""
    try:
        rows = spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)
    # two writers at once, or a job that ran again, may have added a pair twice; its findings are the same
    return rows.dropDuplicates(["blob", "rule_version"])


def scan_unseen(versions: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, findings) of all blobs of `versions` that `ledger` lacks for this rule version.

    Texts are scanned whole. One row of each unseen blob, that of the smallest path, is scanned; to find it the rows meet at their
    blob, so a text is exchanged once. Rows that repeat both path and text are scanned more than once.
    """
    named = versions.select(F.col(f"`{path}`").alias("path"), blob_of(text).alias("blob"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    firsts = named.groupBy("blob").agg(F.min("path").alias("first")).join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    one = named.join(firsts.withColumnRenamed("blob", "b"), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("first")), "left_semi")
    found = one.select("blob", "body").mapInArrow(_scan, f"blob string, findings {_FOUND}")
    return found.groupBy("blob").agg(F.first("findings").alias("findings")).select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def update_ledger(versions: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger in the folder `ledger` lacks of `versions`, add it there, and return the whole ledger.

    What is added is written before anything reads it; a run that fails adds nothing or all, and the next one goes on from there.
    """
    spark = versions.sparkSession
    scan_unseen(versions, read_ledger(spark, ledger), path, text, rule_version).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def scan_secrets(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """`versions` with a column `findings` (array of kind, start, end in code points; empty if none).

    `ledger` is the folder of the ledger of earlier scans, which this one reads and adds to; without one, the scan has a ledger of its
    own. Null text counts as empty, null paths are paths like others, repeated rows each get their blob's findings, an empty table
    gives no rows, and a column of `versions` named findings gets the result under _findings.
    """
    known = update_ledger(versions, ledger or fresh_path(versions.sparkSession, "blob_ledger"), path, text, rule_version)
    names: list[str] = []
    for name in ("blob", "found", "findings"):
        names.append(fresh_name([*versions.columns, *names], name))
    blob_, found_, out_ = names
    some = known.filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select(F.col("blob").alias(blob_), F.col("findings").alias(found_))
    # copies of one text are many tasks' work
    both = attached(versions.withColumn(blob_, blob_of(text)), blob_, path, some, "left")
    return both.select(*[F.col(f"`{c}`") for c in versions.columns], F.coalesce(F.col(found_), F.array().cast(_FOUND)).alias(out_))


def _joined(found, base: bool):
    kept = F.filter(found, lambda f: f["kind"].isin(*BASE)) if base else found
    return F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def span_columns(found) -> dict:
    """Digest columns of a findings column."""
    count = lambda kind: F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")
    return {"n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "base_sha256": F.sha2(_joined(found, True), 256), "spans": _joined(found, False)}


MASK = "[SECRET]"


def redact(df: DataFrame, text: str = "text", found: str = "findings", n_chars: str | None = None) -> DataFrame:
    """`df` with each finding of `text` replaced by MASK (overlapping ones by one), without `found`; `n_chars` follows if named."""
    c, f = F.col(f"`{text}`"), F.col(f"`{found}`")
    # folds the spans by start: what is done so far, and where it stopped in the text
    state = F.aggregate(
        f,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda s, x: F.when(x["end"] <= s["at"], s)
        .when((x["start"] < s["at"]), F.struct(s["done"].alias("done"), x["end"].alias("at")))
        .otherwise(F.struct(F.concat(s["done"], F.substring(c, s["at"] + 1, x["start"] - s["at"]), F.lit(MASK)).alias("done"), x["end"].alias("at"))),
        lambda s: F.concat(s["done"], F.substring(c, s["at"] + 1, F.length(c))),
    )
    out = df.withColumn(text, F.when(F.size(f) > 0, state).otherwise(c)).drop(found)
    return out.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast("long")) if n_chars else out


def digest(text: str | None) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans_of(text or "", tuple(BASE))).encode()).hexdigest()
