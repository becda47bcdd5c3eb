"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4
from zipfile import ZipFile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]+"

#: A key that holds more than one row in so many is joined by broadcast; there are fewer than this many such keys.
HEAVY_SHARE = 1000
#: Rows of a small table (ids, links, labels) that make a partition of its own.
PART_ROWS = 100_000
#: Values that a fold which appends takes at once.
FOLD = 256


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one below the warehouse where that is unset."""
    own = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/")
    return spark.conf.get("spark.checkpoint.dir", None) or f"{own}/checkpoints"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with ZipFile(archive, "w") as out:
        for file in package.rglob("*.py"):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves the file to every executor
    _SHIPPED.add(context.applicationId)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of fewer rows while whole texts or payloads go to Python and back; both sides hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder that does not exist yet, inside the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def kept(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that later steps neither compute them again nor hang on one executor.

    ``rows``, about how many there are, sets the number of partitions: small
    tables that many steps read and write would else be a file for each shuffle partition.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // PART_ROWS)))
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sampled(key: Column, share: float) -> Column:
    """Whether a key is of a sample of about ``share``, by its hash as a number of 63 bits.

    The share of a bounded sample gets small as a table grows; with 63 bits it does not become none.
    """
    low, high = 20, 43
    hashed = F.xxhash64(key)
    number = F.pmod(hashed, F.lit(1 << low)) * F.lit(1 << high) + F.pmod(F.shiftright(hashed, low), F.lit(1 << high))
    return number < F.lit(min((1 << 63) - 1, max(1, int(share * (1 << 63)))))


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def in_blocks(values: Column, folded: Callable[[Column], Column]) -> Column:
    """``folded`` of each ``FOLD`` values of an array in turn, as an array; of none where there are none.

    A fold that appends copies what it has for each value. In blocks that is work in
    proportion to the values, where over all at once it would be to their square.
    """
    last = F.greatest(F.ceil(F.size(values) / F.lit(FOLD)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: folded(F.slice(values, b * FOLD + 1, F.lit(FOLD))))


def totals_before(values: Column) -> Column:
    """For each number of an array the sum of those before it; for blocks, of which there are few."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda done, x: F.struct(
        (done.at + x).alias("at"), F.concat(done.out, F.array(done.at)).alias("out"))).out


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as structs of start, end and the matched text.

    Places count code points. What lies between matches comes from a split by
    the same pattern; lengths add up to places. ``keep`` thins the spans out.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def spans_of(lengths: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(lengths, start, lambda done, x: F.struct(
            (done.at + x.gap + x.length).alias("at"),
            F.concat(done.out, F.array(F.struct(
                (done.at + x.gap).alias("start"), (done.at + x.gap + x.length).alias("end"), x.match.alias("match"),
            ))).alias("out"),
        ))

    def located(gaps: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.struct(
            F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("length"), m.alias("match"),
        ))
        return let(lengths, lambda all_: let(in_blocks(all_, spans_of), lambda blocks: let(
            totals_before(F.transform(blocks, lambda b: b.at)), lambda before: F.flatten(F.transform(
                blocks, lambda b, i: F.transform(b.out, lambda s: F.struct(
                    (s.start + before[i]).alias("start"), (s.end + before[i]).alias("end"), s.match.alias("match"),
                )))))))

    # Bound once: inside a lambda the split would be made anew for each match.
    spans = let(F.split(text, pattern), lambda gaps: located(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    if keep is not None:
        spans = keep(spans)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Each row with its group's columns; ``groups`` has one row for each key and in ``size`` its number of rows.

    A key with more than 1/1000 of all rows is joined by broadcast. There are
    fewer than 1000 of those whatever the data, and their rows are not
    shuffled; so no task of the shuffled join gets more than that share.
    ``rows`` is read twice and ``groups`` four times; both should be checkpoints.
    Rows without a group are dropped.
    """
    keys = list(keys)
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * HEAVY_SHARE > total
    heavy = F.broadcast(groups.where(large))
    by_shuffle = rows.join(F.broadcast(groups.where(large).select(*keys)), keys, "left_anti").join(
        groups.where(~large), keys
    )
    return rows.join(heavy, keys).unionByName(by_shuffle)


def retained(docs: DataFrame, decisions: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keeps, found by the columns ``names``.

    ``decisions`` has a row with ``kept`` for each row of ``docs``. Rows of one
    name are the same document; where it is kept, one of them stays. Names may hold nulls.
    """
    names = list(names)
    known = kept(decisions.groupBy(*names).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("_n")))

    def joined(which: DataFrame, how: str) -> DataFrame:
        other = which.select(*[F.col(c).alias(f"_other_{c}") for c in names])
        same = F.lit(True)
        for c in names:
            same = same & docs[c].eqNullSafe(other[f"_other_{c}"])
        return docs.join(other, same, how)

    out = joined(known.where("not kept or _n > 1"), "left_anti")
    repeated = known.where("kept and _n > 1")
    if repeated.isEmpty():
        return out
    return out.unionByName(joined(repeated, "left_semi").dropDuplicates(names))
