"""Joins with hot keys dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import fresh_name


def attached(rows: DataFrame, keys: str | list[str], other: str | list[str], table: DataFrame, how: str = "inner", parts: int = 256) -> DataFrame:
    """`rows` joined with `table` by `keys`; the rows of a key are dealt by the hash of `other` into `parts` parts.

    What `table` holds for a key is sent once for each part that has rows, `parts` times at most, so no task gets all rows of a key. `rows`
    is read twice. `how` is inner or left.
    """
    keys, other = ([c] if isinstance(c, str) else c for c in (keys, other))
    salt = fresh_name([*rows.columns, *table.columns], "salt")
    dealt = rows.withColumn(salt, F.pmod(F.hash(*other), F.lit(parts)))
    sent = dealt.select(*keys, salt).distinct().join(table, keys)
    return dealt.join(sent, [*keys, salt], how).drop(salt)
