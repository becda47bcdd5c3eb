"""Chat formatting: logged snapshots of growing conversations collapse to the longest, which are then rendered.

A log that stores the whole conversation at every turn holds each prefix of it
as a conversation of its own. Every conversation gets rolling hashes of its
turn prefixes; one whose last hash is a shorter prefix's hash of another is
dropped by an anti-join, as are all but the smallest id of equal conversations.

Turns are ordered by turn number, then role, then text, and numbered anew. The
rolling hash is the sum of a hash of each turn with its place, in two lanes of
64 bits, so a running sum over blocks of ``BLOCK`` turns gives it, and no
conversation, however long, has to fit in one task. Rendering makes one part
for each block of turns; the parts of a conversation in order are its text.

Defined cases: a null role or text differs from every string and renders as an
empty one; null turns come first; rows repeated wholly are turns of their own;
a null conversation id is one more conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.llm.common import join_groups, kept

#: Turns in a block; a rendered part has as many at most.
BLOCK = 64
TURN = ("<|", "|>\n", "\n<|end|>\n")


def _lane(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, role, text with ``conv`` (the id, null told apart), ``place`` from 1 and ``block``.

    Blocks are cut by turn number, whose counts give the first place of each.
    """
    named = turns.select(
        F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id")).alias("conv"), "turn", "role", "text",
        F.floor(F.col("turn") / BLOCK).alias("block"))
    counts = named.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("block"))) - F.col("n")
    offsets = counts.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv", "block").orderBy(
        F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    placed = named.withColumn("inside", inside).join(
        offsets, (F.col("conv") == F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block")))
    return placed.select("conv", "role", "text", "block", (F.col("before") + F.col("inside")).alias("place"))


def prefix_hashes(ordered: DataFrame) -> DataFrame:
    """``conv``, ``place`` and ``prefix``, the hash of the turns up to the place; ``ordered`` as above."""
    marks = [F.col(c).isNull() for c in ("role", "text")]
    lanes = {f"lane{k}": _lane(k, "place", *marks, "role", "text") for k in (1, 2)}
    hashed = ordered.select("conv", "block", "place", *[x.alias(name) for name, x in lanes.items()])
    sums = hashed.groupBy("conv", "block").agg(*[F.sum(name).alias(name) for name in lanes])
    earlier = Window.partitionBy("conv").orderBy(F.asc_nulls_first("block"))
    offsets = sums.select(
        F.col("conv").alias("_conv"), F.col("block").alias("_block"),
        *[(F.sum(name).over(earlier) - F.col(name)).alias(f"before_{name}") for name in lanes])
    running = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.select("conv", "block", "place", *[F.sum(name).over(running).alias(name) for name in lanes])
    whole = inside.join(offsets, (F.col("conv") == F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block")))
    return whole.select("conv", "place", F.struct(
        "place", *[(F.col(f"before_{name}") + F.col(name)).cast("decimal(38,0)").alias(name) for name in lanes]).alias("prefix"))


def maximal_conversations(ordered: DataFrame) -> DataFrame:
    """``conv`` and ``n_turns`` of the conversations that no longer one begins with, one for each content; ``n_snapshots`` equal ones."""
    prefixes = kept(prefix_hashes(ordered))
    lengths = kept(prefixes.groupBy("conv").agg(F.max("place").alias("n_turns")))
    # The last prefix of a conversation has its length; all others are proper prefixes of it.
    ends = join_groups(prefixes, lengths, ["conv"], "n_turns")
    whole = ends.where("place = n_turns").groupBy("prefix").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_snapshots"), F.first("n_turns").alias("n_turns"))
    proper = ends.where("place < n_turns").select("prefix").distinct()
    return whole.join(proper, "prefix", "left_anti").select("conv", "n_turns", "n_snapshots")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_snapshots and text of each maximal conversation; most have part 0 alone."""
    ordered = kept(ordered_turns(turns))
    best = kept(maximal_conversations(ordered))
    chosen = join_groups(ordered, best, ["conv"], "n_turns")
    line = F.concat(F.lit(TURN[0]), F.coalesce("role", F.lit("")), F.lit(TURN[1]), F.coalesce("text", F.lit("")), F.lit(TURN[2]))
    parts = chosen.withColumn("part", F.floor((F.col("place") - 1) / BLOCK)).groupBy("conv", "part", "n_turns", "n_snapshots").agg(
        F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))  # at most BLOCK turns
    return parts.select(
        F.col("conv.id").alias("conv_id"), "part", "n_turns", "n_snapshots", F.array_join("lines.line", "").alias("text"))
