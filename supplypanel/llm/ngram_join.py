"""N-gram Jaccard join: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1. Each row gets a 128-bit key of its word sequence and MinHash band hashes.
   Rows of one key are copies; one of them goes on with the number of copies.
2. Keys that share a band hash are linked to the smallest key of the bucket, and
   connected components of these links collect everything that can be similar.
   A component is a set of candidates; it is not a result.
3. Full shingle sets are made again for the components of two or more keys and
   compared inside them in blocks: a component of more than ``BLOCK`` keys is
   dealt into blocks, and each task compares two blocks. Pairs that share a band
   are verified on the full sets. A task returns, for each text, how many
   documents it is linked to and one link to the smallest key of its part, never the pairs.
4. Components over verified links are the classes.

The band and row counts come from the target recall at the threshold. Words are
what stands between white space; a text of fewer than five words is one shingle
of all its words. Defined cases: null, empty and blank texts have no shingle, no
links and a class of their own; copies count as links; null and repeated ids are
allowed (a class is named by its smallest id that is not null, or null); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplypanel.llm.common import join_groups, kept, retained, ship_package

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: Keys in a block; a task holds the shingle sets of two blocks.
BLOCK = 256


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = 128) -> tuple[int, int]:
    """The most selective banding that finds a pair at the threshold with the target recall.

    More rows in a band let fewer dissimilar pairs through; the bands then follow from the recall.
    """
    found = (1, 1)
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= most_hashes:
            found = (bands, rows)
    return found


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_801)
    return (rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(
        0, 1 << 63, n, dtype=np.uint64)


class Shingler:
    """Hashes of words, with a bounded store, and of shingles."""

    def __init__(self, words: int, stored: int = 300_000):
        self.words, self.stored, self.seen = words, stored, {}

    def word_hashes(self, text: str) -> np.ndarray:
        words = text.encode().split()  # ASCII white space, as the word definition has it
        seen = self.seen
        if len(seen) > self.stored:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    def shingles(self, hashes: np.ndarray) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the runs of five words."""
        if not len(hashes):
            return hashes
        n = max(1, len(hashes) - self.words + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(self.words, len(hashes))):
            out = _mixed(out ^ hashes[k : k + n])
        return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step; each word passes through it in turn, so that order counts."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    a, b = _multipliers(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=least)
    least = least.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = _mixed(out ^ least[:, r])
    return out.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, key (null without words) and band hashes of each row of ``docs``."""
    ship_package(docs.sparkSession)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            keys, hashes = [], []
            for text in batch.column(1).to_pylist():
                of_words = shingler.word_hashes(text or "")
                if len(of_words):
                    keys.append(xxhash.xxh3_128_digest(of_words.tobytes()))
                    hashes.append(band_hashes(shingler.shingles(of_words), bands, rows))
                else:
                    keys.append(None)
                    hashes.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()),
                 pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "key", "bands"])

    return _named(docs).mapInArrow(signed, "doc_id long, text_hash long, key binary, bands array<long>")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))


def components(links: DataFrame) -> DataFrame:
    """key and component (its smallest key) of every key in ``links`` (a, b), a graph without directions.

    Alternating large and small stars: each round joins every key's larger
    neighbours, then its smaller ones, to the smallest it knows. Rounds grow with
    the logarithm of the longest path. Each round is a checkpoint, and a key
    with many neighbours is joined by broadcast.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before, now = None, mark(edges)
    while now != before:
        before, n = now, now[0]
        both = edges.toDF("u", "v").union(edges.select("b", "a"))
        larger = kept(_starred(both, True, n), n)
        edges = kept(_starred(larger.toDF("u", "v"), False, n).distinct(), n)
        now = mark(edges)
    return edges.select(F.col("a").alias("key"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())


def _starred(pairs: DataFrame, larger: bool, rows: int) -> DataFrame:
    """Links (a, b), a above b, from each key's larger (or smaller and own) neighbours to its smallest neighbour."""
    least = kept(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), rows)
    joined = join_groups(pairs, least, ["u"], "n")
    out = joined.select(F.col("v").alias("a"), F.col("m").alias("b"), "u")
    if larger:
        out = out.where("a > u")
    else:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"), "u"))
    return out.where("a > b").select("a", "b")


def candidate_links(reps: DataFrame) -> DataFrame:
    """Links from each key (with ``bands``) to the smallest key that shares one of its band hashes."""
    shared = reps.select("key", F.explode("bands").alias("bucket"))
    least = kept(shared.groupBy("bucket").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_groups(shared, least, ["bucket"], "n").select(F.col("key").alias("a"), "b")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """key, component, blocks, block, n_docs and the sorted shingle hashes of each wanted key, from its first document's text."""
    columns = "key binary, component binary, n_docs long, blocks int, block int, shingles binary"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.shingles(shingler.word_hashes(t)).tobytes() for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sets, pa.binary())], names=names)

    names = [c.split()[0] for c in columns.split(", ")]
    texts, first = _named(docs).alias("d"), wanted.alias("w")
    found = texts.join(first, (F.col("d.text_hash") == F.col("w.text_hash"))
                       & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    return found.select(*[f"w.{c}" for c in names[:5]], "d.text").mapInArrow(made, columns)


def _block_links(keys: list[bytes], sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray,
                 similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text its linked documents and the place of the smallest key it is connected with.

    ``side`` is 0 or 1 where only pairs between two blocks count, else -1 for all.
    Shingles of one text alone are left out; the others make a 0/1 matrix, in
    slices, whose product with itself has the sizes of the intersections.
    """
    n = len(keys)
    sizes = np.array([len(x) for x in sets], np.float64)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    useful = count > 1
    place = np.cumsum(useful) - 1
    chosen = useful[column]
    row, column = row[chosen], place[column[chosen]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common, width = np.zeros((n, n), np.float32), 4096
    for at in range(0, int(useful.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    common = common.astype(np.float64)
    linked = common / (sizes[:, None] + sizes[None, :] - common) >= similarity
    linked &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
    np.fill_diagonal(linked, False)
    by_key = sorted(range(n), key=keys.__getitem__)
    least = np.empty(n, np.int64)
    least[by_key] = np.arange(n)  # each text's rank among the keys
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], n).min(axis=1))
        if (new == least).all():
            return linked @ weights, np.array(by_key)[least]
        least = new


def verified_links(sets: DataFrame, similarity: float) -> DataFrame:
    """key, n_links (documents linked in one comparison) and least (a key it is connected with), one row a comparison."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("_other", other).select(
        "component", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"),
        "block", "key", "n_docs", "shingles")
    group = ["component", "i", "j"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        name = None

        def links() -> list[tuple]:
            if len(held) < 2:
                return []
            keys = list(held)
            blocks, weights = np.array([held[k][0] for k in keys]), np.array([held[k][1] for k in keys], np.int64)
            side = (blocks == name[2]).astype(int) if name[1] != name[2] else np.full(len(keys), -1)
            counts, least = _block_links(
                keys, [np.frombuffer(held[k][2], np.uint64) for k in keys], weights, side, similarity)
            return [(k, int(c), keys[m]) for k, c, m in zip(keys, counts, least) if c]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            key, count, least = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.binary()), pa.array(count, pa.int64()), pa.array(least, pa.binary())],
                names=["key", "n_links", "least"])

        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != name:
                    out += links()
                    name, held = row[:3], {}
                held[row[4]] = (row[3], row[5], row[6])
            yield batch_of(out)
        yield batch_of(links())

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        compared, "key binary, n_links long, least binary")


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, class_id, n_links, n_copies, kept.

    class_id is the smallest id of the class, n_links the number of other
    documents at or above the similarity, copies among them; one document of
    each class is kept, where rows that share id and text are one document.
    """
    bands, rows = bands_and_rows(similarity, recall)
    prints = kept(signatures(docs, words, bands, rows))
    worded, n = prints.where("key is not null"), prints.count()
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    reps = kept(worded.groupBy("key").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("n_docs"), F.first("bands").alias("bands")), n)
    candidates = kept(components(candidate_links(reps)), n)
    sizes = kept(candidates.groupBy("component").agg(F.count(F.lit(1)).alias("size")), n)
    blocks = F.ceil(F.col("size") / block).cast("int")
    wanted = join_groups(candidates, sizes, ["component"], "size").join(reps, "key").select(
        "key", "component", "n_docs", blocks.alias("blocks"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"),
        "first.doc_id", "first.text_hash")
    links = kept(verified_links(shingle_sets(docs, wanted, words), similarity))

    totals = links.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    classes = kept(components(links.select(F.col("key").alias("a"), F.col("least").alias("b"))), n)
    named = classes.join(reps.select("key", "first"), "key")
    class_first = kept(named.groupBy("component").agg(
        F.min("first").alias("class_first"), F.count(F.lit(1)).alias("size")), n)
    in_class = join_groups(classes, class_first, ["component"], "size").select("key", "class_first")
    keys = reps.drop("bands").join(totals, "key", "left").join(in_class, "key", "left").select(
        "key", "n_docs", (F.coalesce("n_links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
        F.coalesce("class_first", "first").alias("first"))
    joined = join_groups(worded, kept(keys, n), ["key"], "n_docs").select(
        "doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), "n_links", F.col("n_docs").alias("n_copies"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("kept"))
    alone = prints.where("key is null").select(
        "doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("kept"))
    return joined.unionByName(alone)


def without_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each class; all columns as they were."""
    named = docs.withColumn("text_hash", F.xxhash64("text"))
    return retained(named, near_duplicates(docs, **settings), ["doc_id", "text_hash"]).drop("text_hash")
