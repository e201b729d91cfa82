"""The trie of all beginnings of conversations: who shares which first turns, what it saves.

Every conversation is a sequence of turns, and every distinct beginning of one is a node.
Equal conversations are combined first. Their sequences are sorted over range partitions;
inside a partition union-find over the edges between neighbours, deepest common prefix
first, makes the nodes (``lcp_forest``). Nodes that hold a partition's first or last sequence
stay open: a partition's forest is contracted to these two sequences with the sums that hang
on them, and ``FAN`` neighbouring forests at a time are merged across their boundaries by the
same union-find, until one is left. No task holds more than a partition's sequences or the
contracted ends of ``FAN`` forests.

Turns are compared by 128 bits of a SHA-256 of role and text, so texts are read once and
never shuffled. Positions are running totals over the sorted rows, so a conversation of any
length is spread over tasks. It enters the trie in segments of ``SEGMENT`` turns: a segment
belongs to the group of those with equal earlier segments, and the tries of the groups are
made level by level from the last, whose roots' sums enter the ends of the segments above.
The ids that end at a node are sorted over range partitions, put into text in chunks, and the
chunks of a node are streamed through its digest.

Defined results: turns are ordered by ``turn``, null first, ties by the digest of role and
text; a null role or text is an empty one; a repeated row is a further turn; rows without a
``conv_id`` are left out; ``%`` keeps the sign of a negative id; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.lcp_forest import KEY_BYTES, Entry, Found, Sequence, forest
from panelforge.llm.tables import schema
from panelforge.operators.ordering import running_total
from panelforge.session import materialize

# A conversation begins with turns of the first one of its family.
FAMILY, MOST_BORROWED = 5, 8
# Turns of a segment.
SEGMENT = 4096
# Turns of the sequences in a partition, where the session's partitions would hold more.
TURNS_PER_TASK = 500_000
# Contracted forests that are merged at a time.
FAN = 64
# Ids in a chunk of text, copies of a row that are counted out together, rows of a batch.
CHUNK_IDS, CHUNK_COPIES, OUT_ROWS = 4096, 4096, 10_000
NOBODY = hashlib.sha256(b"").hexdigest()

SEGMENT_KEY = ["level", "s1", "s2", "c1", "c2"]
OUT = dict(
    kind="string",
    conv_id="bigint",
    depth="bigint",
    parent_conv_id="bigint",
    n_convs="bigint",
    n_children="bigint",
    n_leaves="bigint",
    saved_tokens="bigint",
    ends="string",
    run="string",
    side="int",
    s1="bigint",
    s2="bigint",
    part="bigint",
    data="binary",
)
NODES = dict(
    conv_id="bigint",
    depth="bigint",
    parent_conv_id="bigint",
    n_convs="bigint",
    n_children="bigint",
    n_leaves="bigint",
    saved_tokens="bigint",
    ends_sha256="string",
)

ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
ARROW_OUT = pa.schema([(name, ARROW[kind]) for name, kind in OUT.items()])

Batches = Iterator[pa.RecordBatch]


def _counted(copies: Column, at: str) -> tuple[Column, Column]:
    """Two steps that make one row per copy, without an array of all of them."""
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((copies - 1) / CHUNK_COPIES)))
    first = F.col(at) * CHUNK_COPIES
    last = F.least(copies, first + CHUNK_COPIES) - 1
    return chunks, F.explode(F.sequence(first, last))


def _placed(conversations: DataFrame) -> DataFrame:
    """Distinct turns with ``copies`` and ``before``: the rows sorted before all of them."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.substring(F.sha2(whole, 256), 1, 2 * KEY_BYTES).alias("key"),
            F.octet_length(text).cast("long").alias("size"),
        )
        .where(F.col("conv_id").isNotNull())
        .groupBy("conv_id", "turn", "key", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    order = ["conv_id", "turn", "key"]
    turns = running_total(materialize(turns, "turns"), order, F.col("copies"), "before")
    return materialize(turns, "placed")


def _conversations(placed: DataFrame) -> DataFrame:
    """Per conversation its first row, what it borrows from whom, and its rebuilt length."""
    own = placed.groupBy("conv_id").agg(
        F.min("before").alias("start"), F.sum("copies").alias("length")
    )
    own = materialize(
        own.withColumns(
            {
                "base": F.col("conv_id") - F.col("conv_id") % FAMILY,
                "cut": F.crc32(F.col("conv_id").cast("string")) % (MOST_BORROWED + 1),
            }
        ),
        "conversations",
    )
    lent = own.select(F.col("conv_id").alias("base"), F.col("length").alias("there"))
    borrowed = F.least("cut", F.coalesce("there", F.lit(0).cast("long")))
    rest = F.greatest(F.col("length") - F.col("cut"), F.lit(0).cast("long"))
    found = own.join(lent, "base", "left").withColumn("borrowed", borrowed)
    return materialize(
        found.withColumn("total", F.col("borrowed") + rest).drop("there"), "rebuilt"
    )


def _rebuilt(placed: DataFrame, members: DataFrame) -> DataFrame:
    """The turns of rebuilt conversations with their ``place`` from 0."""
    starts = members.select("conv_id", "start", "cut", "borrowed")
    own = placed.join(starts, "conv_id").withColumn("pos", F.col("before") - F.col("start"))
    chunks, copies = _counted(F.col("copies"), "chunk")
    rest = (
        own.withColumn("chunk", chunks)
        .withColumn("copy", copies)
        .withColumn("pos", F.col("pos") + F.col("copy"))
        .where(F.col("pos") >= F.col("cut"))
        .select(
            "conv_id",
            (F.col("pos") - F.col("cut") + F.col("borrowed")).alias("place"),
            "key",
            "size",
        )
    )
    last = F.least(F.col("pos") + F.col("copies"), F.lit(MOST_BORROWED)) - 1
    heads = (
        own.where(F.col("pos") < MOST_BORROWED)
        .where(F.col("conv_id") % FAMILY == 0)
        .select(
            F.col("conv_id").alias("base"),
            "key",
            "size",
            F.explode(F.sequence(F.col("pos"), last)).alias("place"),
        )
    )
    first = heads.join(members.select("conv_id", "base", "cut"), "base").where(
        F.col("place") < F.col("cut")
    )
    return rest.unionByName(first.select("conv_id", "place", "key", "size"))


def _segments(turns: DataFrame, members: DataFrame, length: int, levels: int) -> DataFrame:
    """Segments of all conversations; the last of each is shorter than ``length``.

    ``c1`` and ``c2`` are hashes of a segment, ``s1`` and ``s2`` of all that come before it.
    """
    one = F.struct((F.col("place") % length).alias("at"), "key", "size")
    filled = (
        turns.groupBy("conv_id", F.floor(F.col("place") / length).alias("level"))
        .agg(F.sort_array(F.collect_list(one)).alias("turns"))
        .select(
            "conv_id",
            "level",
            F.unhex(F.array_join("turns.key", "")).alias("keys"),
            F.col("turns.size").alias("sizes"),
        )
    )
    empty = members.where(F.col("total") % length == 0).select(
        "conv_id",
        F.floor(F.col("total") / length).alias("level"),
        F.unhex(F.lit("")).alias("keys"),
        F.array().cast("array<bigint>").alias("sizes"),
    )
    found = filled.unionByName(empty).withColumns(
        {"c1": F.xxhash64("level", "keys"), "c2": F.xxhash64("keys", "level")}
    )
    nothing = F.lit(0).cast("long")
    if levels == 1:
        return materialize(found.withColumns({"s1": nothing, "s2": nothing}), "segments")
    found = materialize(found, "segments")
    earlier = (
        Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = found.select(
        "conv_id",
        "level",
        *[
            F.coalesce(F.bit_xor(f"c{k}").over(earlier), nothing).alias(f"s{k}") for k in (1, 2)
        ],
    )
    before = materialize(before.where(F.col("level") > 0), "before")
    found = found.join(before, ["conv_id", "level"], "left")
    return materialize(found.fillna(0, ["s1", "s2"]), "chained")


def _digests(segments: DataFrame, length: int) -> DataFrame:
    """Per segment that ends conversations: the digest of their ids."""
    ids = segments.where(F.length("keys") < length * KEY_BYTES).select(*SEGMENT_KEY, "conv_id")
    order = [*SEGMENT_KEY, "conv_id"]
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def rows_of(batches: Batches) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    def chunks(batches: Batches) -> Batches:
        names = [*order, "ids"]
        key, own, out = None, [], []
        for *at, conv_id in rows_of(batches):
            if own and (at != key or len(own) == CHUNK_IDS):
                out.append((*key, own[0], ",".join(map(str, own))))
                own = []
            key = at
            own.append(conv_id)
            if len(out) == OUT_ROWS:
                yield _batch(out, names)
                out = []
        if own:
            out.append((*key, own[0], ",".join(map(str, own))))
        if out:
            yield _batch(out, names)

    def digests(batches: Batches) -> Batches:
        names = [*SEGMENT_KEY, "ends"]
        key, state, out = None, None, []
        for *at, _, text in rows_of(batches):
            if at == key:
                state.update(b"," + text.encode())
                continue
            if state:
                out.append((*key, state.hexdigest()))
            key, state = at, hashlib.sha256(text.encode())
            if len(out) == OUT_ROWS:
                yield _batch(out, names)
                out = []
        if state:
            out.append((*key, state.hexdigest()))
        if out:
            yield _batch(out, names)

    longs = dict.fromkeys(order, "bigint")
    made = ids.mapInArrow(chunks, schema(**longs, ids="string"))
    made = made.repartition(*SEGMENT_KEY).sortWithinPartitions(*order)
    longs.pop("conv_id")
    return made.mapInArrow(digests, schema(**longs, ends="string"))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def _written(found: Found, run: str, part: int, offset: int) -> Batches:
    """What a forest gave, as rows of one table."""

    def rows() -> Iterator[dict]:
        for name, depth, parent, n, children, leaves, saved, ends, at, side in found.nodes:
            yield dict(
                kind="node", conv_id=name, depth=depth + offset, parent_conv_id=parent,
                n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved,
                ends=ends or NOBODY, run=at, side=side,
            )
        for at, side, depth, name in found.names:
            yield dict(kind="name", run=at, side=side, depth=depth + offset, conv_id=name)
        for s1, s2, children, leaves, saved, ends in found.roots:
            yield dict(
                kind="root", s1=s1, s2=s2, n_children=children, n_leaves=leaves,
                saved_tokens=saved, ends=ends,
            )
        for side, sequence in enumerate(found.ends):
            yield dict(kind="end", part=part, side=side, run=run, data=pickle.dumps(sequence))

    out = []
    for row in rows():
        out.append(row)
        if len(out) == OUT_ROWS:
            yield pa.RecordBatch.from_pylist(out, ARROW_OUT)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, ARROW_OUT)


def _merger(name: str, fan: int, final: bool, root_nodes: bool, offset: int):
    """The function that merges the contracted forests of ``fan`` neighbours."""

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda row: (row["part"], row["side"]))
        part = rows[0]["part"] // fan
        sequences = [pickle.loads(row["data"]) for row in rows]
        found = forest(sequences, f"{name}-{part}", final, root_nodes)
        batches = _written(found, f"{name}-{part}", part, offset)
        return pa.Table.from_batches(batches, ARROW_OUT)

    return merge


def _forests(segments: DataFrame, level: int, length: int, parts: int) -> list[DataFrame]:
    """The written tables of all rounds: partitions first, then merges until one is left."""
    offset, root_nodes = level * length, level == 0
    order = ["s1", "s2", "keys"]
    dealt = segments.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    columns = [*order, "sizes", "n", "least", "ends", "n_children", "n_leaves", "saved_tokens"]

    def local(batches: Batches) -> Batches:
        part, sequences = TaskContext.get().partitionId(), []
        for batch in batches:
            for s1, s2, keys, sizes, n, least, ends, children, leaves, saved in zip(
                *(batch.column(c).to_pylist() for c in columns), strict=True
            ):
                end = Entry(n, least, children, leaves, saved, ends)
                sums = {len(keys) // KEY_BYTES: end}
                sequences.append(Sequence((s1, s2), keys, sizes, sums))
        run = f"{level}-0-{part}"
        yield from _written(forest(sequences, run, parts == 1, root_nodes), run, part, offset)

    tables = [materialize(dealt.select(*columns).mapInArrow(local, schema(**OUT)), "forests")]
    while parts > 1:
        parts = math.ceil(parts / FAN)
        ends = tables[-1].where(F.col("kind") == "end").select("part", "side", "data")
        merge = _merger(f"{level}-{len(tables)}", FAN, parts == 1, root_nodes, offset)
        merged = ends.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merge, schema(**OUT))
        tables.append(materialize(merged, "merged"))
    return tables


def _named(tables: list[DataFrame]) -> DataFrame:
    """All nodes; those whose parent was closed in a later round get its name from there."""
    made = reduce(DataFrame.unionByName, tables)
    nodes = made.where(F.col("kind") == "node")
    names = made.where(F.col("kind") == "name").select(
        "run", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("name")
    )
    known = nodes.where(F.col("run").isNull())
    open_ones = nodes.where(F.col("run").isNotNull()).join(names, ["run", "side", "depth"])
    open_ones = open_ones.withColumn("parent_conv_id", F.col("name")).select(known.columns)
    out = known.unionByName(open_ones).withColumnRenamed("ends", "ends_sha256")
    return out.select(*NODES)


def trie(
    conversations: DataFrame, segment: int = SEGMENT, turns_per_task: int = TURNS_PER_TASK
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    spark = conversations.sparkSession
    placed = _placed(conversations)
    members = _conversations(placed)
    size = members.agg(F.max("total").alias("longest"), F.sum("total").alias("turns")).first()
    if size["longest"] is None:
        return spark.createDataFrame([], schema(**NODES))
    levels = size["longest"] // segment + 1
    segments = _segments(_rebuilt(placed, members), members, segment, levels)
    distinct = segments.groupBy(*SEGMENT_KEY).agg(
        F.any_value("keys").alias("keys"),
        F.any_value("sizes").alias("sizes"),
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("least"),
    )
    distinct = distinct.join(_digests(segments, segment), SEGMENT_KEY, "left")
    distinct = materialize(distinct, "distinct")
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        math.ceil(size["turns"] / turns_per_task),
    )
    sums = ["n_children", "n_leaves", "saved_tokens"]
    tables: list[DataFrame] = []
    roots = None
    for level in reversed(range(levels)):
        here = distinct.where(F.col("level") == level)
        if roots is None:
            here = here.withColumns({name: F.lit(0).cast("long") for name in sums})
        else:
            below = roots.select(
                F.col("s1").alias("r1"), F.col("s2").alias("r2"), *sums, F.col("ends").alias("deep")
            )
            goes_on = F.length("keys") == segment * KEY_BYTES
            same = (
                goes_on
                & (F.col("s1").bitwiseXOR(F.col("c1")) == F.col("r1"))
                & (F.col("s2").bitwiseXOR(F.col("c2")) == F.col("r2"))
            )
            here = here.join(below, same, "left").fillna(0, sums)
            here = here.withColumn("ends", F.coalesce("ends", "deep"))
        found = _forests(here, level, segment, parts)
        roots = reduce(DataFrame.unionByName, found).where(F.col("kind") == "root")
        tables += found
    return _named(tables)


# The parent may be null, and a column of such numbers comes as doubles to who compares.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT i.range AS i, list_reduce([CAST(i.range AS BIGINT)] || list_value(0,0,0,0,0,0,0,0),
    lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) i
), ids AS (
  SELECT conv_id, count(*) AS own_turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc(conv_id, k, c) AS (
  SELECT conv_id, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT conv_id, k + 1, xor(c >> 8, v)
  FROM crc JOIN crc_table ON i = xor(c & 255, ascii(substr(CAST(conv_id AS VARCHAR), k + 1, 1)))
  WHERE k < length(CAST(conv_id AS VARCHAR))
), cuts AS (
  SELECT conv_id, own_turns, conv_id - conv_id % 5 AS base, xor(c, 4294967295) % 9 AS cut
  FROM crc JOIN ids USING (conv_id) WHERE k = length(CAST(conv_id AS VARCHAR))
), placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), parts AS (
  SELECT c.conv_id, 0 AS half, p.pos, p.role, p.text
  FROM cuts c JOIN placed p ON p.conv_id = c.base AND p.pos < c.cut
  UNION ALL
  SELECT c.conv_id, 1, p.pos, p.role, p.text
  FROM cuts c JOIN placed p ON p.conv_id = c.conv_id AND p.pos >= c.cut
), prefixes AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
    string_agg(sha256(concat(length(role), ':', role, text)), '') OVER w AS chain
  FROM parts
  WINDOW w AS (PARTITION BY conv_id ORDER BY half, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM ids
), lengths AS (
  SELECT conv_id, max(depth) AS total FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT chain, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = total), '')
      AS ids
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY chain, depth
), placed_nodes AS (
  SELECT n.*, p.chain AS parent_chain
  FROM nodes n LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id
  FROM placed_nodes n LEFT JOIN nodes p ON p.chain = n.parent_chain AND p.depth = n.depth - 1
), counted AS (
  SELECT l.conv_id, l.depth, l.chain, l.bytes, l.n_convs, count(k.chain) AS n_children
  FROM linked l LEFT JOIN linked k ON k.parent_chain = l.chain AND k.depth = l.depth + 1
  GROUP BY ALL
), subtrees AS (
  SELECT p.chain, p.depth, count(*) FILTER (n_children = 0) AS n_leaves,
    CAST(sum((n_convs - 1) * c.bytes) AS BIGINT) AS saved_tokens
  FROM counted c JOIN prefixes p ON p.conv_id = c.conv_id AND p.depth <= c.depth
  GROUP BY p.chain, p.depth
)
SELECT l.conv_id, l.depth, CAST(l.parent_conv_id AS DOUBLE) AS parent_conv_id, l.n_convs, c.n_children, s.n_leaves, s.saved_tokens,
  sha256(l.ids) AS ends_sha256
FROM linked l JOIN counted c USING (chain, depth) JOIN subtrees s USING (chain, depth)
"""
