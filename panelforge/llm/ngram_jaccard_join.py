"""Documents whose sets of word n-grams have a Jaccard similarity of at least 0.8.

Sets are compared by adaptive multi-match prefixes. In any common order of the tokens, two
sets that are similar enough share at least ``m`` tokens among their first
``n - ceil(0.8 n) + m``; so the longer the prefix, the more of it must be shared.

1. *Filter.* In hash order, each set's prefix for a tenth of its size is dealt out by token.
   A set stays if enough of its prefix occurs in another set as well. Most sets do not, and
   only the prefixes have moved.
2. *Order.* The tokens of what stays are counted and put in order of frequency. A set with
   less than four fifths of its tokens in another set goes.
3. *Prefix length.* Each set takes the ``m`` of least estimated cost: the lengths of the
   token lists that its prefix meets, plus verifying the candidates that can have ``m`` of
   its tokens. Pairs are found by one shared token of the shortest prefixes; before they are
   verified, prefixes as long as the lesser ``m`` of the two must share as many.
4. *Dense families.* Sets that meet the same first set most often form a family. Families
   are cut into blocks of bounded size with a few common members, and linked inside the
   blocks. Copies of one text by the thousand so become one component without their pairs.
5. *The rest.* Sets that share a prefix token and are not in one component yet are paired,
   unless its places, or bits of the sets, show that they share too little. A pair inside a component can add
   nothing and is never made: per token, only the sets outside its most frequent component
   meet all others.

Tokens and sets are told apart by 64-bit hashes (sets in the first place by 128 bits), the
filter by fewer: tokens by 48 bits, where a collision can only keep a set too many, and the
sets that share one by 40, where two that collide count as one and may miss the filter
together (about 1e-12 of the pairs of linked sets).

Defined results: a text without words has an empty set and no links; equal sets are linked
and compared once; rows with the same id are one document; a row without an id has the
component null and links with nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm import spans
from panelforge.llm.components import components
from panelforge.llm.tables import id_and_text, schema
from panelforge.session import materialize

SIZE = 5
# Similarity in hundredths.
LEAST = 80
# The filter asks for one shared token, and one more per so many tokens of a set.
FILTER_STEP = 10
TOKEN_BYTES, NODE_BYTES = 6, 5
TOKENS_PER_PART = 1 << 20
# Up to this many document ids are broadcast (two numbers and a key of 16 bytes each); more are
# joined by a shuffle.
BROADCAST_IDS = 1_000_000
# Cost of verifying a candidate, in entries of token lists.
VERIFY_COST = 16
BLOCK, DELEGATES = 256, 16
PARITY_BITS = 256
# Columns of the tables that one product of a block covers.
WIDTH = 8192


def need(n):
    """Tokens that a set of ``n`` shares with any similar one, at least."""
    return -(-LEAST * n // 100)


def token_sets(column: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its runs of ``size`` words."""
    data, bounds = spans.text_bytes(column, lower=True)
    words = spans.find_words(data, bounds)
    h = spans.hash_spans(data, words.begin, words.end)
    runs, _, row = spans.window_hashes(h, words, size, short=True)
    ends = np.searchsorted(row, np.arange(len(column) + 1)).tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield np.unique(runs[a:b])


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _packed(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row: the size of its set, the set's key and the packed prefix for the filter."""
    out = schema(doc_id="long", n_shingles="long", key="binary", node="long", prefix="binary")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.pieces(batch):
                n, keys, prefixes = [], [], []
                for tokens in token_sets(piece.column("text"), size):
                    k = len(tokens)
                    n.append(k)
                    keys.append(_key(tokens) if k else None)
                    first = tokens[: k - need(k) + 1 + k // FILTER_STEP] if k else tokens
                    short = first >> np.uint64(64 - 8 * TOKEN_BYTES)
                    prefixes.append(_packed(short, TOKEN_BYTES))
                nodes = [key and int.from_bytes(key[:8], "little", signed=True) for key in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(nodes, pa.int64()),
                        pa.array(prefixes, pa.binary()),
                    ],
                    out.names,
                )

    return docs.mapInArrow(made, out)


def _runs(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs in order of token, the place in a token's run and the run's length."""
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    new_token = np.ones(len(tokens), bool)
    new_token[1:] = tokens[1:] != tokens[:-1]
    fresh = new_token.copy()
    fresh[1:] |= nodes[1:] != nodes[:-1]
    tokens, nodes, new_token = tokens[fresh], nodes[fresh], new_token[fresh]
    starts = np.flatnonzero(new_token)
    lengths = np.diff(np.append(starts, len(tokens)))
    place = np.arange(len(tokens)) - np.repeat(starts, lengths)
    return tokens, nodes, place, np.repeat(lengths, lengths)


def shared_counts(made: DataFrame, tasks: int) -> DataFrame:
    """Per set (by ``short``, low bits of its node): prefix tokens that another set has too.

    A token that several sets of a batch have is sent for two of them, and counted for the
    others on the spot, so that a token of many sets is few rows. Copies spread over batches
    may be counted more than once, which keeps a set too many at most.
    """
    parts = 4 * tasks
    mask, blob = np.uint64((1 << 8 * NODE_BYTES) - 1), pa.binary()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                raw = rows.column("prefix").to_pylist()
                tokens = _unpacked(b"".join(raw), TOKEN_BYTES)
                nodes = rows.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
                nodes = np.repeat(nodes.view(np.uint64) & mask, [len(r) // TOKEN_BYTES for r in raw])
                tokens, nodes, place, _ = _runs(tokens, nodes)
                counted, times = np.unique(nodes[place > 1], return_counts=True)
                tokens, nodes = tokens[place < 2], nodes[place < 2]
                high = tokens >> np.uint64(8 * TOKEN_BYTES - 32)
                part = (high * np.uint64(parts)) >> np.uint64(32)
                names, starts = np.unique(part, return_index=True)
                ends = [*starts[1:].tolist(), len(tokens)]
                cuts = [slice(a, b) for a, b in zip(starts.tolist(), ends, strict=True)]
                turn += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*names.tolist(), (at + turn) % parts], pa.int32()),
                        pa.array([*(_packed(tokens[c], TOKEN_BYTES) for c in cuts), None], blob),
                        pa.array(
                            [*(_packed(nodes[c], NODE_BYTES) for c in cuts), counted.tobytes()], blob
                        ),
                        pa.array([*[None] * len(cuts), times.astype("<u8").tobytes()], blob),
                    ],
                    ["part", "tokens", "nodes", "times"],
                )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes = [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            for token, node, times in zip(*columns, strict=True):
                if times is None:
                    tokens.append(token)
                    nodes.append(node)
                elif times:
                    yield _counts(np.frombuffer(node, "<u8"), np.frombuffer(times, "<u8"))
        _, found, _, length = _runs(
            _unpacked(b"".join(tokens), TOKEN_BYTES), _unpacked(b"".join(nodes), NODE_BYTES)
        )
        yield _counts(*np.unique(found[length > 1], return_counts=True))

    return (
        made.where(F.col("n_shingles") > 0)
        .select("node", "prefix")
        .mapInArrow(dealt, schema(part="int", tokens="binary", nodes="binary", times="binary"))
        .repartition(tasks, "part")
        .mapInArrow(counted, schema(short="long", n="long"))
        .groupBy("short")
        .agg(F.sum("n").alias("shared"))
    )


def _counts(nodes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes.astype(np.int64)), pa.array(times.astype(np.int64))], ["short", "n"]
    )


def full_sets(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """``node``, ``n`` and all tokens of the chosen sets, each from one of its documents."""
    ids = chosen.select(F.col("rep").alias("doc_id"), "key", "node")
    if (wanted := ids.count()) <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    out = schema(node="long", n="long", tokens="array<long>")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in spans.pieces(batch):
                nodes, found = [], []
                keys, ids = piece.column("key").to_pylist(), piece.column("node").to_pylist()
                made_sets = token_sets(piece.column("text"), size)
                for tokens, key, node in zip(made_sets, keys, ids, strict=True):
                    # Rows of one id may differ, and repeat.
                    if node not in seen and len(tokens) and _key(tokens) == key:
                        seen.add(node)
                        nodes.append(node)
                        found.append(tokens.view(np.int64))
                n = [len(tokens) for tokens in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.cumsum([0, *n]), pa.int32()),
                            pa.array(np.concatenate([np.empty(0, np.int64), *found])),
                        ),
                    ],
                    out.names,
                )

    made_once = materialize(docs.join(ids, "doc_id").mapInArrow(made, out), "tokens")
    if made_once.count() > wanted:
        made_once = materialize(made_once.dropDuplicates(["node"]), "tokens")
    return made_once


def by_frequency(full: DataFrame) -> DataFrame:
    """``node``, ``n`` and ``rare``: (frequency, token) in order, of the tokens in other sets too.

    Tokens of one set only come before all of these and are left out: ``n`` counts them.
    The frequencies are written out so that Spark can split the rows of a frequent token.
    """
    tokens = full.select("node", "n", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    return (
        tokens.join(materialize(often, "frequencies"), "token")
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("rare"))
        .where(F.size("rare") * 100 >= F.col("n") * LEAST)
    )


def best_match_count(n: int, df: np.ndarray) -> int:
    """The number of shared prefix tokens to ask for, by the estimated cost of the prefix.

    A prefix for ``m`` meets lists of ``sum(df - 1)`` entries, and of these at most a share
    of ``1 / m`` are candidates. The unique tokens, which cost nothing, come first.
    """
    m = np.arange(1, need(n) + 1)
    ends = n - need(n) + m - (n - len(df))
    met = np.concatenate([[0], np.cumsum(df - 1)])[np.maximum(ends, 0)]
    return int(m[(met * (1 + VERIFY_COST / m)).argmin()])


def with_match_counts(finalists: DataFrame) -> DataFrame:
    """Add ``m``, the shared prefix tokens that a set asks for, and ``parity``.

    Bit i of the parity says whether the number of tokens that hash to i is odd. Two
    parities differ in at most as many bits as there are tokens in one of the sets only.
    """
    out = schema(
        node="long",
        n="long",
        m="int",
        rare="array<struct<df:long,token:long>>",
        parity="array<long>",
    )

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = batch.column("rare")
            ends = spans.offsets(rare).tolist()
            df = rare.values.field("df").to_numpy(zero_copy_only=False)
            token = rare.values.field("token").to_numpy(zero_copy_only=False)
            m, parity = [], []
            for n, a, b in zip(batch.column("n").to_pylist(), ends[:-1], ends[1:], strict=True):
                m.append(best_match_count(n, df[a:b]))
                odd = np.bincount(token[a:b] & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("n"),
                    pa.array(m, pa.int32()),
                    rare,
                    pa.array(parity, pa.list_(pa.int64())),
                ],
                out.names,
            )

    return finalists.mapInArrow(made, out)


def first_prefixes(finalists: DataFrame) -> DataFrame:
    """One row per set and token of its prefix for one shared token.

    ``place`` is the token's place from 0 in the set, where the first ``alone`` places are
    those of tokens in no other set. What similar sets share begins in both prefixes.
    """
    n, alone = F.col("n"), F.col("n") - F.size("rare")
    taken = F.greatest(n - F.ceil(n * LEAST / 100) + 1 - alone, F.lit(0)).cast("int")
    rows = finalists.select(
        "node", "n", alone.alias("alone"), "parity", F.posexplode(F.slice("rare", 1, taken))
    )
    place = (F.col("pos") + F.col("alone")).alias("place")
    return rows.select(F.col("col.token").alias("token"), "node", "n", "alone", place, "parity")


def families(rows: DataFrame) -> DataFrame:
    """``family``, ``block`` and ``node``: sets by the first set that they meet most often.

    The first set of a token list is its least node. A family's blocks hold about ``BLOCK``
    sets each, and all of them a few common ones, by hash; the first set is one of these.
    """
    firsts = rows.groupBy("token").agg(F.min("node").alias("family"), F.count(F.lit(1)).alias("c"))
    met = (
        rows.join(materialize(firsts.where(F.col("c") > 1).drop("c"), "firsts"), "token")
        .groupBy("node", "family")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("node")
        .agg(F.max(F.struct("times", "family")).alias("most"))
        .select(F.col("most.family").alias("family"), "node")
    )
    own = met.select("family", F.col("family").alias("node")).distinct()
    members = materialize(met.where("family <> node").unionByName(own), "families")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes.where(F.col("size") > 1), "sizes")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    spread = F.xxhash64("node")
    common = (F.col("node") == F.col("family")) | (
        F.pmod(spread, F.ceil(F.col("size") / F.lit(DELEGATES))) == 0
    )
    one = F.array(F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int"))
    placed = F.when(common, F.sequence(F.lit(0), blocks - 1)).otherwise(one)
    return members.join(sizes, "family").select(
        "family", F.explode(placed).alias("block"), "node"
    )


def similar(n: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
    """Which sets of a block are similar, as a matrix.

    Shared tokens are counted by products of 0/1 tables of ``WIDTH`` tokens at a time.
    """
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, column, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    often = count > 1
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(tokens), len(tokens)), np.float32)
    for start in range(0, int(often.sum()), WIDTH):
        a, b = np.searchsorted(column, [start, start + WIDTH])
        table = np.zeros((len(tokens), WIDTH), np.float32)
        table[row[a:b], column[a:b] - start] = 1
        both += table @ table.T
    both = np.rint(both).astype(np.int64)
    return 100 * both >= LEAST * (n[:, None] + n[None, :] - both)


def _linked_block(table: pa.Table) -> pa.Table:
    """Each set of a block with the least set of its component in the block."""
    node = table.column("node").to_numpy()
    node, first = np.unique(node, return_index=True)
    rare = table.column("rare").combine_chunks()
    ends = spans.offsets(rare).tolist()
    token = rare.values.field("token").to_numpy(zero_copy_only=False)
    tokens = [token[ends[i] : ends[i + 1]] for i in first.tolist()]
    linked = similar(table.column("n").to_numpy()[first], tokens)
    np.fill_diagonal(linked, True)
    label = np.arange(len(node))
    while True:
        least = np.where(linked, label[None, :], len(node)).min(1)
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(node))
    return pa.table({"a": node[moved], "b": node[label[moved]]})


def family_links(rows: DataFrame, finalists: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` that span the components found inside the blocks of families."""
    return (
        materialize(families(rows), "blocks")
        .join(finalists, "node")
        .select("family", "block", "node", "n", "rare")
        .groupBy("family", "block")
        .applyInArrow(_linked_block, schema(a="long", b="long"))
    )


def candidates(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of sets in different components with a common token in their first prefixes.

    A shared token bounds how much two sets can share: before it the fewer of the tokens
    that either has before it and not alone, after it the fewer of the tokens left. And they
    differ in all their alone tokens and at least as many others as bits of their parities.
    Where they can share too little, the token pairs nothing.
    """
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = materialize(rows, "rows")
    mixed = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = mixed.groupBy("token").agg(
        F.max(F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("labels")
    )
    mixed = mixed.where(F.col("labels") > 1).select("token", F.col("most.label").alias("top"))
    rows = materialize(rows.join(materialize(mixed, "mixed"), "token"), "rows")
    fields = ("node", "n", "place", "alone", "label", "parity")
    left = rows.where(F.col("label") != F.col("top"))
    left = left.select("token", *[F.col(c).alias(f"{c}_l") for c in fields])
    right = rows.select("token", "top", *[F.col(c).alias(f"{c}_r") for c in fields])
    before = F.least(F.col("place_l") - F.col("alone_l"), F.col("place_r") - F.col("alone_r"))
    most = before + F.least(F.col("n_l") - F.col("place_l"), F.col("n_r") - F.col("place_r"))
    apart = F.col("alone_l") + F.col("alone_r")
    for i in range(PARITY_BITS // 64):
        apart += F.bit_count(F.col("parity_l")[i].bitwiseXOR(F.col("parity_r")[i]))
    return (
        left.join(right, "token")
        .where(F.col("label_l") != F.col("label_r"))
        .where((F.col("label_r") == F.col("top")) | (F.col("node_l") < F.col("node_r")))
        .where(most * 100 >= (F.col("n_l") + F.col("n_r") - most) * LEAST)
        .where(apart * (100 + LEAST) <= (F.col("n_l") + F.col("n_r")) * (100 - LEAST))
        .select(
            F.least("node_l", "node_r").alias("a"), F.greatest("node_l", "node_r").alias("b")
        )
        .distinct()
    )


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _is_similar(a: tuple, b: tuple) -> bool:
    """Two sets, each given as size, asked matches and tokens in order, the alone ones left out.

    Only if their prefixes for the lesser of the asked matches share as many tokens are the
    whole sets compared.
    """
    asked = min(a[1], b[1])
    heads = [t[: max(0, len(t) - need(n) + asked)] for n, _, t in (a, b)]
    if _shared(*heads) < asked:
        return False
    both = _shared(a[2], b[2])
    return 100 * both >= LEAST * (a[0] + b[0] - both)


def verified(pairs: DataFrame, finalists: DataFrame) -> DataFrame:
    """The pairs that are similar."""
    arrays = finalists.select("node", "n", "m", F.col("rare.token").alias("tokens"))
    a, b = (arrays.toDF(side, f"n_{side}", f"m_{side}", f"tokens_{side}") for side in "ab")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in "ab":
                n, m = (batch.column(f"{c}_{side}").to_pylist() for c in "nm")
                tokens = batch.column(f"tokens_{side}")
                ends = spans.offsets(tokens).tolist()
                flat = tokens.values.to_numpy(zero_copy_only=False)
                own = [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
                sides.append(zip(n, m, own, strict=True))
            kept = [_is_similar(x, y) for x, y in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").mapInArrow(checked, schema(a="long", b="long"))


def linked_sets(docs: DataFrame, made: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """``node`` and ``label`` of the sets that are similar to another one."""
    spark = docs.sparkSession
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (3 * TOKENS_PER_PART))
    )
    short = F.col("node").bitwiseAND(F.lit((1 << 8 * NODE_BYTES) - 1))
    counts = shared_counts(made, tasks)
    asked = 1 + F.floor(F.ceil(F.col("n_shingles") * LEAST / 100) / FILTER_STEP)
    chosen = (
        classes.withColumn("short", short).join(counts, "short").where(F.col("shared") >= asked)
    )
    chosen = materialize(chosen.select("rep", "key", "node"), "chosen")
    finalists = with_match_counts(by_frequency(full_sets(docs, chosen, size)))
    finalists = materialize(finalists, "finalists")
    rows = materialize(first_prefixes(finalists), "prefixes")
    near = materialize(components(family_links(rows, finalists)), "near")
    links = verified(candidates(rows, near), finalists)
    link_ends = (
        links.join(near.toDF("a", "label_a"), "a", "left")
        .join(near.toDF("b", "label_b"), "b", "left")
        .select(
            F.coalesce("label_a", "a").alias("a"),
            F.coalesce("label_b", "b").alias("b"),
        )
    )
    merged = materialize(components(link_ends).toDF("label", "merged"), "merged")
    # Labels that merged, and sets that had no label and now have one.
    return (
        near.join(merged, "label", "left")
        .select("node", F.coalesce("merged", "label").alias("label"))
        .unionByName(
            merged.join(near, merged["label"] == near["node"], "left_anti").toDF("node", "label")
        )
    )


def join(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document: the size of its set and the least id that links reach from it."""
    docs = id_and_text(docs)
    made = materialize(sets(docs, size), "sets")
    known = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(
        known.groupBy("key", "node", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes"
    )
    labels = materialize(linked_sets(docs, known, classes, size), "labels")
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(named.select("key", "rep", "label"), "named")
    least = materialize(named.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    found = materialize(named.join(least, "label").select("key", "component_id"), "found")
    return (
        made.select("doc_id", "n_shingles", "key")
        .join(found, "key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias(
                "component_id"
            ),
        )
    )


def keep_one(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents without those that links connect to one with a smaller id.

    Rows of one id stay together, and rows without an id stay.
    """
    found = materialize(join(docs, size).select("doc_id", "component_id"), "components")
    least = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    gone = materialize(gone.join(least, "doc_id", "left_anti"), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


# Every pair with a common shingle, then all that links reach.
ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), runs AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS k
  FROM docs WHERE len(words) > 0
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], ' ') AS shingle FROM runs
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM docs
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM least LEFT JOIN sizes USING (doc_id)
"""
