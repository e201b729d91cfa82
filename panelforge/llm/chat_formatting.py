"""Conversations rendered for training, without snapshots that a longer log continues.

Chat logs are written again after every turn, so a conversation is often logged as all its
prefixes. Each turn gets the hash of all turns up to it; a conversation whose last such hash
is that of an inner turn of another is a prefix of it, and an anti-join takes it out. Of
equal conversations the one with the smallest id stays.

The hash up to a turn is a polynomial in the hashes of the turns, so it is a sum over turns
and made in two steps: within runs of ``RUN`` turns, and over the runs of a conversation.
No task holds all turns of a long conversation, and the rendered text comes in the same
runs: ``part`` 0, 1, ... of a conversation follow each other.

Defined results: turns are numbered anew from 0 in the order of ``turn``, then role and
text, so gaps and ties do no harm; a row repeated whole counts once; a null role or text is
an empty one; a null ``turn`` comes first; rows without a ``conv_id`` are left out; the
markers of the format are taken apart where a text holds them; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.ordering import running_total
from panelforge.session import materialize

RUN = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Moduli of the two hashes, primes below 2^31 so that products stay in 64 bits, and bases.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525)
# Bits of the number of a run.
RUN_BITS = 40


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with ``pos`` from 0: a running total over ranges of all sorted turns.

    A range is cut anywhere, also between turns with equal numbers, so no task holds all turns
    of a conversation.
    """
    rows = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .where(F.col("conv_id").isNotNull())
        .distinct()
    )
    order = ["conv_id", "turn", "role", "text"]
    placed = running_total(materialize(rows, "turns"), order, F.lit(1), "before")
    placed = materialize(placed, "placed")
    first = placed.groupBy("conv_id").agg(F.min("before").alias("first"))
    return placed.join(first, "conv_id").select(
        "conv_id", "role", "text", (F.col("before") - F.col("first")).alias("pos")
    )


def _power(base: int, modulus: int, exponent: Column) -> Column:
    """``base ** exponent`` modulo ``modulus`` by squaring."""
    squares = F.array(*[F.lit(pow(base, 1 << b, modulus)).cast("long") for b in range(RUN_BITS)])
    bits = F.sequence(F.lit(0), F.lit(RUN_BITS - 1))
    return F.aggregate(
        bits,
        F.lit(1).cast("long"),
        lambda at, b: F.when(
            F.call_function("shiftright", exponent, b).bitwiseAND(F.lit(1)) == 1,
            F.pmod(at * F.get(squares, b), F.lit(modulus)),
        ).otherwise(at),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` and the hashes ``h0``, ``h1`` of the turns up to ``pos``."""
    run, j = F.floor(F.col("pos") / RUN), F.pmod("pos", F.lit(RUN)).cast("int")
    terms, sums = {}, {}
    so_far = Window.partitionBy("conv_id", "run").orderBy("pos")
    for i, (p, base) in enumerate(zip(MODULI, BASES, strict=True)):
        powers = F.array(*[F.lit(pow(base, k, p)).cast("long") for k in range(RUN)])
        turn = F.pmod(F.xxhash64("role", "text", F.lit(i)), F.lit(p))
        terms[f"t{i}"] = F.pmod(turn * F.get(powers, F.col("j")), F.lit(p))
        sums[f"s{i}"] = F.pmod(F.sum(f"t{i}").over(so_far), F.lit(p))
    local = turns.withColumns({"run": run, "j": j}).withColumns(terms)
    local = local.select("conv_id", "pos", "run", *terms).withColumns(sums)
    local = materialize(local, "local_hashes")
    earlier = Window.partitionBy("own_id").orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy(F.col("conv_id").alias("own_id"), F.col("run").alias("own")).agg(
        *[F.pmod(F.sum(f"t{i}"), F.lit(p)).alias(f"t{i}") for i, p in enumerate(MODULI)]
    )
    shifts, befores = {}, {}
    for i, (p, base) in enumerate(zip(MODULI, BASES, strict=True)):
        shifts[f"shift{i}"] = _power(pow(base, RUN, p), p, F.col("own"))
        moved = F.pmod(F.col(f"t{i}") * F.col(f"shift{i}"), F.lit(p))
        befores[f"before{i}"] = F.coalesce(F.sum(moved).over(earlier), F.lit(0))
    runs = totals.withColumns(shifts).withColumns(befores)
    runs = materialize(runs.select("own_id", "own", *shifts, *befores), "runs")
    same = (F.col("conv_id") == F.col("own_id")) & (F.col("run") == F.col("own"))
    hashes = [
        F.pmod(F.col(f"before{i}") + F.col(f"s{i}") * F.col(f"shift{i}") % p, F.lit(p)).alias(f"h{i}")
        for i, p in enumerate(MODULI)
    ]
    return local.join(runs, same).select("conv_id", "pos", *hashes)


def maximal(hashes: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_turns`` of the conversations that no other one continues.

    Common first turns and repeated conversations are one row each before the anti-join.
    """
    lengths = hashes.groupBy("conv_id").agg((F.max("pos") + 1).alias("n_turns"))
    lengths = materialize(lengths, "lengths")
    marked = hashes.join(lengths, "conv_id").withColumn("n", F.col("pos") + 1)
    whole = marked.where(F.col("n") == F.col("n_turns"))
    whole = whole.groupBy("n", "h0", "h1").agg(F.min("conv_id").alias("conv_id"))
    inner = marked.where(F.col("n") < F.col("n_turns")).select("n", "h0", "h1").distinct()
    return whole.join(inner, ["n", "h0", "h1"], "left_anti").select(
        "conv_id", F.col("n").alias("n_turns")
    )


def _plain(text: Column) -> Column:
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("|", " ")))
    return text


def format_chats(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered in parts of up to ``RUN`` turns."""
    turns = materialize(_sorted_turns(conversations), "sorted")
    hashes = materialize(prefix_hashes(turns), "hashes")
    kept = materialize(maximal(hashes), "maximal")
    line = F.concat(
        F.lit(OPEN), _plain(F.col("role")), F.lit("\n"), _plain(F.col("text")), F.lit(CLOSE + "\n")
    )
    parts = (
        turns.join(kept, "conv_id")
        .groupBy("conv_id", F.floor(F.col("pos") / RUN).alias("part"), "n_turns")
        .agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    )
    return parts.select(
        "conv_id", "part", "n_turns", F.array_join(F.col("lines.line"), "").alias("text")
    )


ORACLE = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER w - 1 AS pos,
    string_agg(md5(concat(role, chr(1), text)), '') OVER w AS chain
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), lengths AS (
  SELECT conv_id, count(*) AS n_turns FROM turns GROUP BY conv_id
), whole AS (
  SELECT chain, min(conv_id) AS conv_id, min(n_turns) AS n_turns
  FROM placed JOIN lengths USING (conv_id) WHERE pos + 1 = n_turns GROUP BY chain
), kept AS (
  SELECT conv_id, n_turns FROM whole WHERE chain NOT IN (
    SELECT chain FROM placed JOIN lengths USING (conv_id) WHERE pos + 1 < n_turns)
)
SELECT conv_id, pos // {RUN} AS part, n_turns,
  string_agg(concat('{OPEN}', {{role}}, chr(10), {{text}}, '{CLOSE}', chr(10)), '' ORDER BY pos)
    AS text
FROM placed JOIN kept USING (conv_id)
GROUP BY conv_id, pos // {RUN}, n_turns
"""
for _name in ("role", "text"):
    _sql = _name
    for _mark in (OPEN, CLOSE):
        _sql = f"replace({_sql}, '{_mark}', '{_mark.replace('|', ' ')}')"
    ORACLE = ORACLE.replace("{" + _name + "}", _sql)
