"""Importance resampling towards a target distribution, over hashed runs of words.

Features are all runs of 1 to ``runs`` consecutive words, repeats counted. A
feature's bucket is the CRC-32 of its bytes modulo ``buckets``. A bucket's gain
is the log ratio of its shares in the target and in the documents, in
thousandths; a document's weight is the mean gain of its features. Gumbel noise
seeded by the document's id turns weights into a draw without replacement: the
highest sums are taken.

The vocabulary is in two parts. The head, words and pairs that each hold more
than 1/``HEAD_SHARE`` of all their occurrences (so fewer than that many), is
counted over all documents and broadcast: CRC states for the words, which also
start the CRC of a pair, and buckets for the pairs. Any other feature takes its
CRC directly. Both feed the same exact totals; the head decides only the speed.

Defined cases: null and empty texts have no features, weight 0, and are never
drawn while ``least_words`` is above 0; a null id counts as the empty string
for the noise and ranks last; rows of one id share the noise and are drawn one by
one; ties go to the smaller id, then to fewer features and the smaller weight; an
empty table gives an empty result, an empty target is a target without counts.
Columns other than doc_id and text are not looked at. Texts are taken in pieces,
so that a very long one needs little memory beside itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from supplypanel.llm.common import kept, ship_package, small_batches
from supplypanel.llm.ranks import numbered

RUNS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: A word or pair of the head holds more than one in so many occurrences, and is not longer than ``HEAD_BYTES``.
HEAD_SHARE, HEAD_BYTES = 20_000, 64
#: Entries of a task's counts before they are handed on, and bytes of text that are cut into words at once.
COUNTED, PIECE_BYTES = 200_000, 1 << 20
#: A-Z become small, other bytes that stand in no word become spaces.
FOLDED = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20
    for b in range(256)
)


def word_lists(text: bytes, runs: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text piece by piece, each piece after the last ``runs - 1`` words before it, and their number."""
    flat, at, words = text.translate(FOLDED), 0, []
    while at < len(flat):
        end = flat.find(b" ", at + PIECE_BYTES)
        end = len(flat) if end < 0 else end
        before = words[1 - runs :] if runs > 1 else []
        words = before + flat[at:end].split()
        yield words, len(before)
        at = end


def runs_of(words: list[bytes], before: int, length: int) -> Iterator[tuple[bytes, ...]]:
    """Runs of ``length`` words that end after the first ``before`` words."""
    words = words[max(0, before - length + 1) :]
    return zip(*[words[i:] for i in range(length)])


class _States(dict):
    """CRC states of the head's words; any other word's is computed and not stored."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class Head:
    """What the tasks get of the vocabulary: states of frequent words and buckets of frequent pairs."""

    def __init__(self, words: list[bytes], pairs: list[bytes], buckets: int):
        self.states = {w: crc32(w) for w in words}
        self.pairs = {tuple(p.split(b" ")): crc32(p) % buckets for p in pairs}
        self.buckets = buckets

    def features(self, text: bytes, runs: int) -> Iterator[tuple[np.ndarray, int]]:
        """The buckets of a text's features, piece by piece, and the number of new words."""
        states = _States(self.states)
        for words, before in word_lists(text, runs):
            crcs = np.fromiter(map(states.__getitem__, words), np.int64, len(words))
            found = [crcs[before:] % self.buckets]
            if runs > 1:
                known = self.pairs.get
                found.append(np.fromiter(
                    (crc32(b" " + b, states[a]) % self.buckets if (k := known((a, b))) is None else k
                     for a, b in runs_of(words, before, 2)), np.int64))
            for length in range(3, runs + 1):
                found.append(np.fromiter(
                    (crc32(b" ".join(run)) % self.buckets for run in runs_of(words, before, length)), np.int64))
            yield np.concatenate(found), len(words) - before


def _texts(batch: pa.RecordBatch, place: int) -> Iterator[bytes]:
    for text in batch.column(place).cast(pa.binary()):
        yield text.as_py() or b""


def frequent(docs: DataFrame, length: int) -> list[bytes]:
    """The head's runs of ``length`` words, from counts over all documents; fewer than ``HEAD_SHARE``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["run", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in _texts(batch, 0):
                for words, before in word_lists(text, length):
                    held.update(words if length == 1 else map(b" ".join, runs_of(words, before, length)))
                    if len(held) > COUNTED:
                        yield rows()
        yield rows()

    counts = kept(docs.select("text").mapInArrow(counted, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    head = counts.where((F.col("n") * HEAD_SHARE > total) & (F.octet_length("run") <= HEAD_BYTES))
    return [bytes(r.run) for r in head.select("run").collect()]


def fit_head(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> Head:
    ship_package(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return Head(frequent(docs, 1), frequent(docs, 2) if runs > 1 else [], buckets)


def bucket_totals(texts: DataFrame, head: Head, runs: int = RUNS) -> np.ndarray:
    """Features of each bucket over all of ``texts`` (text); a task hands on one number for each bucket."""
    spark, shared = texts.sparkSession, texts.sparkSession.sparkContext.broadcast(head)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, totals = shared.value, np.zeros(shared.value.buckets, np.int64)
        for batch in batches:
            for text in _texts(batch, 0):
                for found, _ in own.features(text, runs):
                    totals += np.bincount(found, minlength=own.buckets)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], names=["bucket", "n"])

    ship_package(spark)
    with small_batches(spark):
        found = texts.select("text").mapInArrow(summed, "bucket long, n long").groupBy("bucket").agg(
            F.sum("n").alias("n")).collect()  # a row for each bucket at most
    totals = np.zeros(head.buckets, np.int64)
    for row in found:
        totals[row.bucket] = row.n
    return totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's smoothed log ratio of target to corpus, in thousandths and rounded down."""
    n = len(corpus)
    all_corpus, all_target = float(int(corpus.sum()) + n), float(int(target.sum()) + n)
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * all_corpus / (float(s + 1) * all_target)))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def weighted(docs: DataFrame, head: Head, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((head, gain))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, worth = shared.value
        for batch in batches:
            out = []
            for text in _texts(batch, 1):
                n_words = n = total = 0
                for found, new in own.features(text, runs):
                    n_words, n, total = n_words + new, n + len(found), total + int(worth[found].sum())
                out.append((n_words, n, total // n if n else 0))
            numbers = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in numbers]],
                names=["doc_id", "n_words", "n_features", "weight"])

    schema = StructType([docs.schema["doc_id"], *[StructField(x, LongType()) for x in ("n_words", "n_features", "weight")]])
    ship_package(spark)
    with small_batches(spark):
        return kept(docs.select("doc_id", "text").mapInArrow(scored, schema))


def resampled(
    docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row for each document: doc_id, n_words, n_features, weight, score, rank (null where not drawn).

    ``docs`` has doc_id and text, ``target`` text. Of the documents with at
    least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down.
    """
    head = fit_head(docs, runs, buckets)
    gain = gains(bucket_totals(docs, head, runs), bucket_totals(target, head, runs))
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**32)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")
    scored = kept(weighted(docs, head, gain, runs).withColumn("score", F.col("weight") + noise))
    rank = F.col("position") + 1
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    ranked = numbered(eligible, order).withColumn("rank", F.when(rank <= drawn, rank)).drop("position")
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others)


def drawn_documents(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, with all columns, whose id was drawn; where rows repeat an id, all of its rows."""
    chosen = resampled(docs, target, **parameters).where("rank is not null").select(
        F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_drawn_id"]), "left_semi")
