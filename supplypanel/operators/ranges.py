"""Manifests that find a difference: hashes of key ranges in a tree, and the rows behind them.

A key's range is the first bits of its hash, a node of the tree the range of
fewer bits. Each node has the number of its rows and two lanes of summed row
hashes. Two manifests are compared from the root: below nodes that agree nothing
is looked at, and of tables written by range only the files of ranges that
differ are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the leaves, and bits that a level adds; written tables are cut by ``FILE_BITS``.
LEAF_BITS, STEP_BITS, FILE_BITS = 12, 4, 4
RANGE = "key_range"


def leaf_of(keys, bits: int = LEAF_BITS) -> Column:
    """The leaf of a key, 0 to 2^bits - 1; null keys have leaves as well."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits).cast("int")


def tree_manifest(df: DataFrame, keys, bits: int = LEAF_BITS) -> DataFrame:
    """level (bits of the node), node, row_count, lane_a, lane_b for every node that holds rows."""
    columns = [F.col(c) for c in sorted(df.columns)]
    lane = lambda *seed: F.sum(F.xxhash64(*seed, *columns).cast("decimal(38,0)"))
    leaves = df.groupBy(leaf_of(keys, bits).alias("leaf")).agg(
        F.count(F.lit(1)).alias("row_count"), lane().alias("lane_a"), lane(F.lit("second lane")).alias("lane_b"))
    levels = F.explode(F.array(*[F.lit(b) for b in range(0, bits + 1, STEP_BITS)]))
    node = F.expr(f"cast(shiftright(leaf, {bits} - level) as int)")
    return leaves.withColumn("level", levels).groupBy("level", node.alias("node")).agg(
        *[F.sum(c).cast(t).alias(c) for c, t in (("row_count", "long"), ("lane_a", "decimal(38,0)"), ("lane_b", "decimal(38,0)"))])


def differing_leaves(left: DataFrame, right: DataFrame, bits: int = LEAF_BITS) -> DataFrame:
    """The leaves in which two manifests differ, found level by level below nodes that differ."""
    open_ = None
    for level in range(0, bits + 1, STEP_BITS):
        sides = [m.where(F.col("level") == level) for m in (left, right)]
        if open_ is not None:
            parent = F.shiftright(F.col("node"), STEP_BITS)
            sides = [s.join(open_, parent == open_["above"], "left_semi") for s in sides]
        a, b = (s.select("node", F.struct("row_count", "lane_a", "lane_b").alias(n)) for s, n in zip(sides, ("_a", "_b")))
        open_ = a.join(b, "node", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.col("node").alias("above"))
    return open_.select(F.col("above").alias("leaf"))


def write_by_range(df: DataFrame, path: str, keys, bits: int = FILE_BITS) -> None:
    """Writes the rows with one folder for each range of ``bits`` bits, all columns kept."""
    df.withColumn(RANGE, leaf_of(keys, bits)).repartition(RANGE, *keys).write.mode("overwrite").partitionBy(RANGE).parquet(path)


def changed_rows(spark: SparkSession, old: str, new: str, keys, leaves: DataFrame, bits: int = LEAF_BITS) -> DataFrame:
    """keys, change (added, removed, changed) and the changed columns, from two tables that ``write_by_range`` wrote.

    Files of other ranges are not read. There are 2^bits leaves at most, whose
    list goes into the filter. Rows that repeat a key are paired by their content.
    """
    found = sorted(r.leaf for r in leaves.collect())
    ranges = sorted({leaf >> (bits - FILE_BITS) for leaf in found})
    sides = []
    for path in (old, new):
        table = spark.read.parquet(path)
        rows = table.where(F.col(RANGE).isin(ranges)).drop(RANGE)
        sides.append(rows.where(leaf_of(keys, bits).isin(found)))
    columns = [c for c in sides[0].columns if c not in keys]
    # Equal rows cancel out; of a key there is then what only one side has.
    marked = [
        s.groupBy(*s.columns).agg(F.lit(sign).cast("long").alias("_sign"), F.count(F.lit(1)).alias("_n"))
        for s, sign in zip(sides, (-1, 1))
    ]
    left = marked[0].unionByName(marked[1]).groupBy(*sides[0].columns).agg(F.sum(F.col("_sign") * F.col("_n")).alias("_net"))
    own = F.struct(*columns) if columns else F.lit(None)
    per_key = left.where("_net <> 0").groupBy(*keys).agg(
        F.max(F.when(F.col("_net") < 0, own)).alias("_old"), F.max(F.when(F.col("_net") > 0, own)).alias("_new"))
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return per_key.select(
        *keys, change.alias("change"), F.when(change == "changed", differing).otherwise(F.array().cast("array<string>")).alias("columns"))
