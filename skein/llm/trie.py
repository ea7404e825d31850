"""Prefix trie of conversations by heavy-path decomposition.

Conversations meet in nodes by a hash of all their turns so far, a running exclusive-or of keyed hashes of (turn, depth). A node's
largest child continues its heavy path; the others begin light paths, each with half of its parent's members at most. Subtree sums are suffix
sums along paths, after every path's sum has climbed from light path to parent, in as many rounds as there are light edges above each
other: the logarithm of the number of conversations at most.

Nothing follows one conversation or one path in one task: positions come from ranges, and running values from blocks of BLOCK depths.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import stored
from skein.llm.dealt import attached

#: Turns or nodes of one conversation or path that one window holds.
BLOCK = 4096


def head_length(conv: Column) -> Column:
    """Turns that a conversation takes over from the first of its five."""
    return (F.crc32(conv.cast("string").cast("binary")) % 9).cast("long")


def _positions(turns: DataFrame) -> DataFrame:
    """(conv, pos, digest, bytes): turns numbered from 1 in each conversation.

    Rows are sorted in ranges of (conversation, turn, role, text), so a long conversation is several tasks' work; a range's rows are numbered
    by their places, and each conversation's count in earlier ranges is added.
    """
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("row").asc()]  # row parts equal rows
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text")), 256)
    ranged = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.select("conv", F.monotonically_increasing_id().alias("place"), F.unhex(digest).alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    placed = placed.withColumn("range", F.shiftright("place", 33))
    counts = placed.groupBy("conv", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("conv", "range", (F.col("first") - F.coalesce(earlier, F.lit(0))).alias("zero"))
    return placed.join(starts, ["conv", "range"]).select("conv", (F.col("place") - F.col("zero") + 1).alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rebuilt turns) of `turns` (conv, turn, role, text), without nulls but in turn.

    Conversations: (conv, n), n rebuilt turns. Rebuilt turns: (conv, depth, digest, bytes, last), depth from 1.
    """
    own = stored(_positions(turns), "positions")
    sizes = own.groupBy("conv").agg(F.max("pos").alias("size")).select("conv", "size", head_length(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    taken = F.least("h", F.coalesce("base_size", F.lit(0)))
    convs = stored(sizes.join(bases, "base", "left").select("conv", "base", "size", "h", taken.alias("taken"), (taken + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    last = F.col("depth") == F.col("n")
    heads = own.filter("pos <= 8").select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "digest", "bytes")
    first = convs.filter("taken > 0").join(heads, "base").filter("depth <= taken").select("conv", "depth", "digest", "bytes", last.alias("last"))
    # a long conversation meets its own record in blocks
    blocks = convs.select("conv", "h", "taken", "n", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("size") / BLOCK).cast("long"))).alias("block"))
    rest = own.withColumn("block", (F.col("pos") / BLOCK).cast("long")).join(blocks, ["conv", "block"]).filter("pos > h")
    rest = rest.withColumn("depth", F.col("pos") - F.col("h") + F.col("taken")).select("conv", "depth", "digest", "bytes", last.alias("last"))
    return convs.select("conv", "n"), first.unionByName(rest)


def _by_block(rows: DataFrame, keys: list[str], **folds: Column):
    """`rows` folded by keys and block, and the window of a key's earlier blocks, from which what they add up to follows."""
    own = rows.groupBy(*keys, "block").agg(*[f.alias(c) for c, f in folds.items()])
    return own, Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): (conv, depth, pconv, n_convs, bytes) of each node but the root, named by its smallest member and its depth; and (node's
    conv, depth, ids' digest) of each node that is some conversation's end."""
    keys = [F.lit(secrets.token_hex(16)) for _ in range(2)]
    marked = turns.select("conv", "depth", "bytes", "last", *[F.xxhash64(k, "digest", "depth").alias(f"e{i}") for i, k in enumerate(keys)]).withColumn("block", (F.col("depth") / BLOCK).cast("long"))
    marked = stored(marked, "turn_hashes")
    own, earlier = _by_block(marked, ["conv"], x0=F.bit_xor("e0"), x1=F.bit_xor("e1"))
    carried = own.select("conv", "block", *[F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (0, 1)]).filter("block > 0")
    so_far = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = marked.select("conv", "block", "depth", "bytes", "last", "e0", "e1", *[F.bit_xor(f"e{i}").over(so_far).alias(f"r{i}") for i in (0, 1)]).join(carried, ["conv", "block"], "left")
    key = lambda i: F.col(f"r{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0)))
    rows = stored(run.select("conv", "depth", "bytes", "last", *[key(i).alias(f"k{i}") for i in (0, 1)], *[key(i).bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (0, 1)]), "prefixes")
    met = stored(rows.groupBy("k0", "k1", "depth").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.first("p0").alias("p0"), F.first("p1").alias("p1")), "nodes_met")
    up = met.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("pconv"))
    under = attached(met.filter("depth > 1"), ["p0", "p1", "depth"], "conv", up)
    least = convs.agg(F.min("conv")).first()[0]
    tops = met.filter("depth = 1").withColumn("pconv", F.lit(least).cast("long"))
    named = stored(under.unionByName(tops).select("conv", "depth", "pconv", "n_convs", "bytes", "k0", "k1"), "nodes")
    ids = rows.filter("last").select("k0", "k1", "depth", "conv")
    digests = _id_digests(ids, ["k0", "k1", "depth"]).join(met.select("k0", "k1", "depth", "conv"), ["k0", "k1", "depth"]).select("conv", "depth", "ends_sha256")
    none = _id_digests(convs.filter("n = 0").select(F.lit(0).cast("long").alias("depth"), "conv"), ["depth"]).select(F.lit(least).cast("long").alias("conv"), "depth", "ends_sha256")
    return named.drop("k0", "k1"), digests.unionByName(none)


def _id_digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256): SHA-256 of each group's ids (conv), numerically ascending, comma-joined.

    Ids are sorted in ranges of (keys, id), where runs of them become strings; a group's digest then reads its strings in order, one at a
    time: of a group that many conversations share one task gets a row for each batch of ids.
    """
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]
            out, at = [], 0
            own = list(zip(*cols[:-1]))
            ids = cols[-1]
            for i in range(1, len(own) + 1):
                if i == len(own) or own[i] != own[at]:
                    out.append((*own[at], ids[at], ",".join(map(str, ids[at:i]))))
                    at = i
            arrays = [pa.array([r[i] for r in out], f.type) for i, f in enumerate([*batch.schema, pa.field("ids", pa.string())])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, schema = None, None, None
        for batch in batches:
            schema, out = [batch.schema.field(i) for i in range(len(keys))], []
            for i, own in enumerate(zip(*(batch.column(j).to_pylist() for j in range(len(keys))))):
                if own != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(memoryview(batch.column(len(keys) + 1)[i].as_buffer()))
            yield _rows(out, schema)
        if now is not None:
            yield _rows([(*now, state.hexdigest())], schema)

    def _rows(out: list, schema: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)), pa.array([r[-1] for r in out], pa.string())], names=[*keys, "ends_sha256"])

    named = ", ".join(f"{k} {t}" for k, t in zip(keys, kinds))
    runs = rows.select(*keys, "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInArrow(joined, f"{named}, first long, ids string")
    return runs.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashed, f"{named}, ends_sha256 string")


def _heavy_tops(nodes: DataFrame) -> DataFrame:
    """`nodes` (with `light`) and the top (tconv, tdepth) of each one's heavy path.

    The nodes of one smallest member are a chain of consecutive depths. Below a chain's first light edge the top lies in the chain; above it,
    it is the top of the node that the chain hangs from, found by doubling pointers between chains.
    """
    rows = nodes.withColumn("block", (F.col("depth") / BLOCK).cast("long")).withColumn("mark", F.when(F.col("light"), F.col("depth")))
    so_far = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own, earlier = _by_block(rows, ["conv"], own=F.max("mark"))
    carried = stored(own.select("conv", "block", F.max("own").over(earlier).alias("carried")), "chain_blocks")
    local = rows.withColumn("run", F.max("mark").over(so_far)).join(carried, ["conv", "block"]).withColumn("tdepth", F.coalesce("run", "carried"))
    local = stored(local.drop("run", "carried", "mark"), "chains")
    # chains that hang from another by a heavy edge; no two hang from one node
    hung = local.filter("pconv <> conv and not light").select(F.col("conv").alias("chain"), F.col("pconv").alias("up"), (F.col("depth") - 1).alias("udepth"))
    above = local.select(F.col("conv").alias("up"), F.col("depth").alias("udepth"), "tdepth")
    links = stored(hung.join(above, ["up", "udepth"]).select("chain", "up", "tdepth"), "links")
    while links.filter("tdepth is null").limit(1).count():
        further = links.select(F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("tdepth").alias("tdepth2"))
        step = links.filter("tdepth is null").select("chain", "up").join(further, "up").select("chain", F.col("up2").alias("up"), F.col("tdepth2").alias("tdepth"))
        links = stored(links.filter("tdepth is not null").unionByName(step), "links")
    known = local.filter("tdepth is not null").withColumn("tconv", F.col("conv"))
    open_ = local.filter("tdepth is null").drop("tdepth")
    by_block = open_.select("conv", "block").distinct().join(links.select(F.col("chain").alias("conv"), F.col("up").alias("tconv"), "tdepth"), "conv")
    return known.unionByName(open_.join(by_block, ["conv", "block"])).drop("block")


def _subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(conv, depth, values): sums over the subtree of each of `nodes` (conv, depth, pconv, tconv, tdepth, n_children, values)."""
    total = [F.sum(v).alias(v) for v in values]
    branching = stored(nodes.filter("n_children > 1").select(F.col("conv").alias("uconv"), F.col("depth").alias("udepth"), "tconv", "tdepth"), "branching")
    tops = nodes.filter("conv = tconv and depth = tdepth and depth > 0").select("tconv", "tdepth", F.col("pconv").alias("uconv"))
    tops = stored(tops, "path_tops")
    now, rounds = nodes.groupBy("tconv", "tdepth").agg(*total), []
    while True:
        # what each light path has goes to the node that it hangs from, and on with that node's path
        hung = stored(now.join(tops, ["tconv", "tdepth"]).groupBy("uconv", (F.col("tdepth") - 1).alias("udepth")).agg(*total), "attached")
        if not hung.limit(1).count():
            break
        rounds.append(hung)
        now = hung.join(branching, ["uconv", "udepth"]).groupBy("tconv", "tdepth").agg(*total)
    every = nodes.select("conv", "depth", "tconv", "tdepth", *values)
    if rounds:
        added = rounds[0]
        for more in rounds[1:]:
            added = added.unionByName(more)
        added = added.groupBy(F.col("uconv").alias("conv"), F.col("udepth").alias("depth")).agg(*[F.sum(v).alias(f"{v}_added") for v in values])
        every = every.join(added, ["conv", "depth"], "left").select("conv", "depth", "tconv", "tdepth", *[(F.col(v) + F.coalesce(f"{v}_added", F.lit(0))).alias(v) for v in values])
    rows = stored(every.withColumn("block", -(F.col("depth") / BLOCK).cast("long")), "path_values")
    own, earlier = _by_block(rows, ["tconv", "tdepth"], **{v: F.sum(v) for v in values})
    below = own.select("tconv", "tdepth", "block", *[F.sum(v).over(earlier).alias(f"{v}_below") for v in values]).filter(f"{values[0]}_below is not null")
    suffix = Window.partitionBy("tconv", "tdepth", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("conv", "depth", "tconv", "tdepth", "block", *[F.sum(v).over(suffix).alias(v) for v in values]).join(below, ["tconv", "tdepth", "block"], "left")
    return summed.select("conv", "depth", *[(F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values])


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Conversations are rebuilt first, from head_length() turns of the first of their five and what follows these in their own. A null role or text
    is empty. Turns are in the order of turn, null first, ties by role and then text; repeated rows are turns of their own. Rows without a
    conversation's id belong to none and take no part. Only the four named columns are read; an empty table gives no rows.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turns = conversations.filter(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    convs, rows = rebuilt(turns)
    nodes, ends = _nodes(rows, convs)
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    children = stored(nodes.groupBy("pconv", (F.col("depth") - 1).alias("udepth")).agg(F.count("*").alias("n_children"), F.min(F.struct((-F.col("n_convs")).alias("size"), "conv")).alias("largest")), "children")
    heavy = children.select(F.col("largest.conv").alias("conv"), (F.col("udepth") + 1).alias("depth"), F.lit(False).alias("light"))
    every = nodes.unionByName(root.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("pconv"), "n_convs", F.lit(0).cast("long").alias("bytes")))
    every = every.join(children.select(F.col("pconv").alias("conv"), F.col("udepth").alias("depth"), "n_children"), ["conv", "depth"], "left")
    every = every.join(heavy, ["conv", "depth"], "left").select(
        "conv", "depth", "pconv", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("light", F.lit(True)).alias("light"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    placed = stored(_heavy_tops(every), "heavy_paths")
    sums = _subtree_sums(placed, ["n_leaves", "saved_tokens"])
    out = placed.drop("n_leaves", "saved_tokens").join(sums, ["conv", "depth"]).join(ends, ["conv", "depth"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("pconv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), x AS (  -- CRC-32 of the decimal id, four bits at a time
  SELECT c, size, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [(ascii(s) & 15)::BIGINT, (ascii(s) >> 4)::BIGINT]))),
         lambda a, b: xor(a >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[(xor(a, b) & 15) + 1])), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT c, max(pos) AS size FROM t GROUP BY c)
), v AS (
  SELECT x.c, x.h, x.c - x.c % 5 AS b, least(x.h, coalesce(y.size, 0)) AS taken FROM x LEFT JOIN x y ON y.c = x.c - x.c % 5
), r AS (
  SELECT v.c, pos AS depth, role, text FROM v JOIN t ON t.c = v.b AND pos <= taken
  UNION ALL SELECT v.c, pos - h + taken, role, text FROM v JOIN t ON t.c = v.c AND pos > h
), p AS (
  SELECT c, depth, strlen(text) AS bytes, sha256(string_agg(sha256(strlen(role)::VARCHAR || ':' || role || ':' || text), '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS key FROM r
), k AS (SELECT *, lag(key, 1, '') OVER (PARTITION BY c ORDER BY depth) AS up FROM p),
n AS (
  SELECT key, depth, min(c) AS conv, count(*) AS n_convs, any_value(bytes) AS bytes, any_value(up) AS up FROM k GROUP BY key, depth
  UNION ALL SELECT '', 0, min(c), count(*), 0, NULL FROM v HAVING count(*) > 0
), w AS (
  SELECT n.*, (SELECT count(*) FROM n m WHERE m.up = n.key AND m.depth = n.depth + 1) AS n_children FROM n
), a AS (
  SELECT k.key AS top, k.depth AS d, w.n_children, w.n_convs, w.bytes FROM w JOIN k ON k.c = w.conv AND k.depth <= w.depth
  UNION ALL SELECT '', 0, n_children, n_convs, bytes FROM w
), s AS (
  SELECT top, d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM a GROUP BY top, d
), z AS (
  SELECT key, depth, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (
    SELECT v.c, coalesce(max_by(k.key, k.depth), '') AS key, coalesce(max(k.depth), 0) AS depth FROM v LEFT JOIN k ON k.c = v.c GROUP BY v.c
  ) GROUP BY key, depth
)
SELECT w.conv AS conv_id, w.depth::BIGINT AS depth, u.conv AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM w JOIN s ON s.top = w.key AND s.d = w.depth LEFT JOIN n u ON u.key = w.up AND u.depth = w.depth - 1 LEFT JOIN z ON z.key = w.key AND z.depth = w.depth
"""
