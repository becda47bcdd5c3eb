"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Words and pairs of neighbouring words are hashed to ``BUCKETS`` buckets. Over
the trusted documents and over all documents the bucket counts make two
multinomials; a document's score is the mean over its n-grams of the log of
their ratio, in millionths, as whole numbers, so that sums are exact and the
threshold gives the same answer everywhere. Equal texts (the same words) count
once in both multinomials, and as trusted if one of their documents is, so the
number of copies decides no verdict.

Defined cases: null or empty texts have no words and fail the base rule;
documents without labels, empty tables and repeated or null ids are allowed
(a repeated id is trusted in all its rows if it is labelled good); with no
trusted document every ratio is 1 and the base rule alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.llm.common import kept, let, sampled, words_of

#: Buckets of the multinomials; bounds the table that each task gets.
BUCKETS = 16384
#: About so many labelled documents make the trusted multinomial, if there are more.
TRUSTED_ROWS = 20_000
#: Added to a bucket's trusted count and to the count that its raw share lets one expect, so
#: that buckets with few counts, which small corpora have many of, say little.
PRIOR = 20.0
#: Least mean log ratio of a document that stays, in millionths.
THRESHOLD = -60_000
SYMBOLS = "#*$%&|<>"
#: Cells of text hashes; those that hold a repeated text are grouped text by text. Bounds what each task gets.
TEXT_CELLS = 1 << 20
#: Bits for a window's place in its document.
PLACE_BITS = 26


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text holds twice or more.

    Most texts hold no window twice, which the windows' hashes tell. For the others each
    window is one long, some of its hash's bits above its place, and the longs
    are sorted. Only windows beside another of the same bits can be repeated; those
    are sorted by their words, so equal ones are neighbours whatever else shares the
    bits. Texts with more words than there are places sort all windows so. Each
    repeated window then adds the words that the one before it did not cover.
    """
    places = F.lit((1 << PLACE_BITS) - 1).cast("long")

    def hashes(w: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(every, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def marked(w: Column, hashed: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(w) - 3)

        def key(x: Column, i: Column) -> Column:
            return F.shiftleft(x, PLACE_BITS).bitwiseOR(i.cast("long"))

        def alike(x: Column, y: Column) -> Column:  # null beside an end, which is no match
            return F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0

        def window(i: Column) -> Column:
            a, b, c = (F.get(w, i + k) for k in range(3))
            return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), i.alias("place"))

        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))

        beside = let(F.sort_array(F.transform(hashed, key)), lambda s: F.transform(
            F.filter(s, lambda x, i: F.coalesce(alike(x, F.get(s, i - 1)) | alike(x, F.get(s, i + 1)), F.lit(False))),
            lambda x: x.bitwiseAND(places).cast("int")))
        likely = F.when(F.size(w) <= 1 << PLACE_BITS, beside).otherwise(every)
        repeated = let(F.sort_array(F.transform(likely, window)), lambda s: F.filter(
            s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))
        ))
        starts = F.sort_array(F.transform(repeated, lambda x: x.place))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(x - F.get(p, i - 1), F.lit(3)))),
            F.lit(0).cast("long"), lambda total, x: total + x,
        ))

    none = F.lit(0).cast("long")
    return let(words, lambda w: F.when(F.size(w) < 4, none).otherwise(let(hashes(w), lambda hashed: F.when(
        F.size(F.array_distinct(hashed)) == F.size(hashed), none).otherwise(marked(w, hashed)))))


def base_counts(words: Column, text: Column) -> dict[str, Column]:
    """The base rule's columns; ``text`` has no nulls."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeated = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": repeated.cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def grams(words: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of the words and of the pairs of neighbours."""
    bucket = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")
    return let(words, lambda w: F.concat(
        F.transform(w, lambda x: bucket(x)),
        F.transform(F.slice(w, 2, F.size(w)), lambda x, i: bucket(F.get(w, i), x)),
    ))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids labelled good and not toxic: all of them, or about ``rows`` chosen by hash; the size is so bounded."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    share = min(1.0, rows / max(1, good.count()))
    return good.where(sampled(F.col("doc_id"), share))


def distinct_texts(docs: DataFrame, trusted: DataFrame, cells: int = TEXT_CELLS) -> DataFrame:
    """One row for each different text: its words and ``_trusted``, which is null where no document of it is trusted.

    Texts alone in their cell of hashes are not shuffled. The others are grouped by
    the words themselves, so a hash decides only which way a text goes; equal texts
    of a task are one row before the shuffle.
    """
    body = F.array_join(words_of(F.col("text")), " ").alias("_body")
    cell = lambda hashed: F.pmod(hashed, F.lit(cells)).cast("int").alias("_cell")
    repeated = docs.select(body).groupBy(F.xxhash64("_body").alias("_hash")).count().where("count > 1")
    shared = F.broadcast(kept(repeated.select(cell(F.col("_hash"))).distinct()))
    flagged = docs.join(F.broadcast(trusted.withColumn("_trusted", F.lit(1))), "doc_id", "left").select(body, "_trusted")
    placed = flagged.withColumn("_cell", cell(F.xxhash64("_body")))
    alone = placed.join(shared, "_cell", "left_anti").select("_body", "_trusted")
    grouped = placed.join(shared, "_cell", "left_semi").groupBy("_body").agg(F.max("_trusted").alias("_trusted"))
    words = F.array_remove(F.split("_body", " "), "")  # one space stands between words, and no other blank is left
    return alone.unionByName(grouped).select(words.alias("words"), "_trusted")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: an array with each bucket's log of trusted share over raw share, in millionths.

    Counts cover the texts of all documents, each once, and are summed in each task before the shuffle.
    """
    counts = distinct_texts(docs, trusted).select(
        F.explode(grams(F.col("words"), buckets)).alias("bucket"), "_trusted",
    ).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("good"))
    filled = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(
        counts, "bucket", "left"
    ).na.fill(0)
    # One row of two sorted arrays of ``buckets`` numbers.
    arrays = filled.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("c"),
                        F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    expected = lambda x: x.raw * F.col("n_good") / F.greatest(F.col("n_raw"), F.lit(1))
    ratio = lambda x: F.round(1e6 * F.log((x.good + PRIOR) / (expected(x) + PRIOR))).cast("long")
    return arrays.select(F.transform("c", ratio).alias("ratios"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: int = THRESHOLD,
    rows: int = TRUSTED_ROWS,
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Columns of these names in ``docs`` are replaced. Score is in millionths, null without words.
    """
    ratios = log_ratios(docs.select("doc_id", "text"), trusted_ids(labels, rows), buckets).scalar()
    words, text = F.col("_words"), F.coalesce("text", F.lit(""))
    total = let(F.col("_ratios"), lambda table: F.aggregate(
        grams(words, buckets), F.lit(0).cast("long"), lambda total, g: total + F.get(table, g)
    ))
    prepared = docs.withColumns({"_words": words_of(F.col("text")), "_ratios": ratios})
    counted = prepared.withColumns(base_counts(words, text) | {"_sum": total})
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    return counted.withColumns({
        "base_failed": failed,
        "score": F.when(n_grams > 0, F.round(F.col("_sum") / n_grams).cast("long")),
        "kept": ~failed & (F.col("_sum") >= threshold * n_grams),
    }).drop("_words", "_ratios", "_sum")
