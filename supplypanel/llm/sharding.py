"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number for the key, and the record goes to the shard with
the highest draw. A draw depends on the key and on that shard's number alone,
so a shard that is added takes records only into itself, about its share of
the weights, and one that is removed gives up only its own. A shard's draw is
``-weight / ln(u)``, with u uniform from the hash; the chance to be the highest
is the shard's share of the weights.

Hashes are 32 bits of the md5 of ``key:block``, four shards to a block: the
same on every engine and version. Equal draws go to the lower shard.

Defined cases: a null key counts as the empty string, a null text as empty;
rows of one key share a shard; an empty table gives an empty result; weights
are positive, and a weight of zero leaves its shard without records. Columns of
the caller are not looked at, except key and text; ``write_shards`` writes all of
them, and there a column with the name of the shard column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.llm.common import kept, let
from supplypanel.llm.ranks import numbered

#: Shards whose draws come from one hash: md5 has 32 hexadecimal digits, a draw takes 8.
PER_HASH, DIGITS = 4, 8
#: Bytes that a record takes beside its text.
OVERHEAD = 16
#: Bytes of records that one file of a written shard should hold.
FILE_BYTES = 256 << 20


def draws(key: Column, weights: Sequence[float]) -> Column:
    """Each shard's draw for a key, as an array."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("shards need weights of zero or more, not all zero")
    blocks = -(-len(weights) // PER_HASH)
    text = F.coalesce(key.cast("string"), F.lit(""))
    hashes = F.concat(*[F.md5(F.concat(text, F.lit(f":{b}"))) for b in range(blocks)])

    def drawn(digits: Column) -> Column:
        return F.array(*[
            F.lit(-float(w)) / F.log(
                (F.conv(F.substring(digits, DIGITS * s + 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**32))
            for s, w in enumerate(weights)
        ])

    return let(hashes, drawn)


def _highest(drawn: Column) -> Column:
    """The place of the highest draw, of equal ones the first."""
    return (F.array_position(drawn, F.array_max(drawn)) - 1).cast("int")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, from 0."""
    return let(draws(key, weights), _highest)


def shard_and_grown(key: Column, weights: Sequence[float], added: float) -> Column:
    """Struct of the shard and of the shard there would be with one more, of weight ``added``; the draws are shared."""
    return let(draws(key, [*weights, added]), lambda d: F.struct(
        _highest(F.slice(d, 1, len(weights))).alias("shard"), _highest(d).alias("grown_shard")))


def shard_plan(docs: DataFrame, weights: Sequence[float], added: float = 1.0) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, shard, slot, grown_shard.

    ``slot`` numbers the documents of a shard from 0 without gaps, by doc_id
    (nulls last), then size and checksum. Only these few numbers are shuffled, no text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = shard_and_grown(F.col("doc_id"), weights, added)
    placed = kept(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        found.alias("_found"),
    ).select("doc_id", "size", "text_crc32", "_found.shard", "_found.grown_shard"))
    slots = numbered(placed, [F.asc_nulls_last("doc_id"), "size", "text_crc32"], ["shard"], "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, folder: str, weights: Sequence[float], name: str = "shard") -> None:
    """Writes all columns of ``docs`` below ``folder/<name>=0``, ``<name>=1`` …

    A shard is cut into files of about ``FILE_BYTES`` by a hash of the whole row's
    place, so a large shard is written by many tasks. What the folder held is replaced.
    """
    sharded = docs.withColumn(name, shard_of(F.col("doc_id"), weights))
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(OVERHEAD)
    total = docs.agg(F.sum(size)).first()[0] or 0
    largest = max(weights) / sum(weights)
    files = max(1, -(-int(total * largest) // FILE_BYTES))
    # Rows are dealt by shard and by their own number, not by key, since one key may hold very many of them.
    dealt = F.struct(F.col(name), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)))
    sharded.withColumn("_deal", dealt).repartition(files * len(weights), "_deal").drop("_deal").write.mode(
        "overwrite").partitionBy(name).parquet(folder)
