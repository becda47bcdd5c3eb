"""Audit of how sources of a language differ in the terms they use.

Each source of a language, and the language as a whole, gives each kept term a
share p of a thousand million; f = floor((p - q)² / q) is a term's part of the
chi-squared distance from shares q. Reported are the distances between all
sources of a language, and for each source the terms it uses more than its
language does, the largest f first. All arithmetic is on whole numbers.

Counting. A task gathers texts to chunks of about ``CHUNK_BYTES``, finds the terms
as runs of letter bytes in the chunk's buffer, and deals them to buckets by
length: up to 8 bytes are one unsigned 64-bit word, up to 16 two, both sorted by
a radix sort over 16-bit digits; up to 64 bytes are fixed-width byte strings
sorted as bytes; longer ones a sorted list. Sorts are stable, so the documents of
a run of equal terms are in order, and run lengths give counts as well as numbers
of documents. Spark adds up the runs.

Defined cases: null text, lang and source count as ''; a source without kept terms
gives each the smallest share; a language without kept terms has distances of 0;
copies and repeated ids are documents of their own; an empty table gives an empty
result. Columns other than text, lang and source are not looked at. A text longer
than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplypanel.llm.common import join_groups, kept, ship_package, small_batches

SCALE = 1_000_000_000
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
CHUNK_BYTES = 8 << 20
#: Shares that a comparison holds at once (terms x sources), and sources that it compares with all others.
CELLS, SOURCE_BLOCK = 1 << 18, 256
#: Bytes of the longest term that is sorted at a fixed width; buffers end in so many zeros.
WIDEST = 64
#: A-Z become small, other letter bytes stay, all else is 0.
FOLDED = np.array(
    [b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0 for b in range(256)], np.uint8)


# --- Terms of a chunk -------------------------------------------------------------


def term_places(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of each term of a folded buffer whose texts end at ``ends``; no term crosses an end."""
    inside = buffer != 0
    if not len(inside):
        none = np.empty(0, np.int64)
        return none, none, none
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = ends[(ends > 0) & (ends < len(buffer))]
    opens[cut] |= inside[cut]
    closes[cut - 1] |= inside[cut - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1 - starts, np.searchsorted(ends, starts, side="right")


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by several keys, the first one most significant, from 16-bit digits.

    numpy sorts 16-bit numbers stably by radix. Digits that are the same everywhere are passed over.
    """
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 8 * key.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(changed: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and number of different texts of the runs that begin where ``changed``."""
    first = np.flatnonzero(changed)
    other = changed.copy()
    other[1:] |= texts[1:] != texts[:-1]
    return first, np.diff(np.append(first, len(changed))), np.add.reduceat(other.astype(np.int64), first)


def _strings(cells: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of bytes, each as long as told, as a string array."""
    flat = np.ascontiguousarray(cells[np.arange(cells.shape[1]) < lengths[:, None]])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def counted_terms(buffer: np.ndarray, ends: np.ndarray, groups: np.ndarray) -> Iterator[tuple]:
    """Group, term, count and number of texts, as arrays for each length bucket.

    ``buffer`` holds the texts end to end and ``WIDEST`` zeros; ``groups`` has each text's group number.
    """
    folded = FOLDED[buffer]
    starts, lengths, texts = term_places(folded[: len(folded) - WIDEST], ends)
    group_of = groups.astype(np.uint32)

    def view(kind: str, at: np.ndarray) -> np.ndarray:
        """Values of a kind that begin at any byte."""
        width = np.dtype(kind).itemsize
        return np.ndarray((len(folded) - width + 1,), kind, folded.data, strides=(1,))[at]

    low = 0
    for words in (1, 2):
        held = np.flatnonzero((lengths > low) & (lengths <= 8 * words))
        low = 8 * words
        if not len(held):
            continue
        at, size, text = starts[held], lengths[held], texts[held]
        keys = []
        for w in range(words):
            value = view(">u8", at + 8 * w).astype(np.uint64)
            spare = (8 * np.clip(8 * (w + 1) - size, 0, 7)).astype(np.uint64)  # bits behind the term's end
            keys.append(value >> spare << spare)
        order = radix_order([group_of[text], *keys])
        keys, text, size = [k[order] for k in keys], text[order], size[order]
        group = group_of[text]
        changed = np.ones(len(order), bool)
        changed[1:] = group[1:] != group[:-1]
        for key in keys:
            changed[1:] |= key[1:] != key[:-1]
        first, count, n_texts = _runs(changed, text)
        packed = np.stack([k[first] for k in keys], axis=1).astype(">u8")
        yield group[first], _strings(packed.view(np.uint8), size[first]), count, n_texts

    for width in (32, 64):
        held = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        if not len(held):
            continue
        at, size, text = starts[held], lengths[held], texts[held]
        cells = view(f"V{width}", at).view(np.uint8).reshape(len(held), width).copy()
        cells[np.arange(width) >= size[:, None]] = 0
        terms = cells.view(f"S{width}").ravel()
        order = np.argsort(terms, kind="stable")
        order = order[radix_order([group_of[text[order]]])]
        terms, text, size = terms[order], text[order], size[order]
        group = group_of[text]
        changed = np.ones(len(order), bool)
        changed[1:] = (group[1:] != group[:-1]) | (terms[1:] != terms[:-1])
        first, count, n_texts = _runs(changed, text)
        yield group[first], _strings(cells[order][first], size[first]), count, n_texts

    held = np.flatnonzero(lengths > WIDEST)
    if len(held):
        raw = folded.tobytes() if len(held) > 64 else folded.data
        long = sorted(
            (int(group_of[t]), bytes(raw[s : s + n]), int(t))
            for s, n, t in zip(starts[held].tolist(), lengths[held].tolist(), texts[held].tolist()))
        changed = np.array([True, *[a[:2] != b[:2] for a, b in zip(long, long[1:])]])
        first, count, n_texts = _runs(changed, np.array([x[2] for x in long]))
        terms = pa.array([long[i][1] for i in first], pa.large_binary()).view(pa.large_string())
        yield np.array([long[i][0] for i in first], np.uint32), terms, count, n_texts


# --- Counts over all documents ----------------------------------------------------


def source_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs (documents that have the term), over whole texts."""
    ship_package(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        texts: list[memoryview] = []
        groups: list[int] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            buffer = np.frombuffer(b"".join([*texts, bytes(WIDEST)]), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            langs, sources = (pa.array([k[i] for k in names], pa.large_string()) for i in (0, 1))
            for group, terms, count, n_texts in counted_terms(buffer, ends, np.array(groups)):
                at = pa.array(group)
                yield pa.RecordBatch.from_arrays(
                    [x.cast(pa.string()) for x in (langs.take(at), sources.take(at), terms)]
                    + [pa.array(count), pa.array(n_texts)], names=["lang", "source", "term", "n", "docs"])
            names.clear(), texts.clear(), groups.clear()

        for batch in batches:
            of = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for text, group in zip(batch.column(0).cast(pa.binary()), of):
                buffer = text.as_buffer()
                texts.append(memoryview(buffer))
                groups.append(names.setdefault(group, len(names)))
                held += buffer.size
                if held >= CHUNK_BYTES:
                    yield from rows()
                    held = 0
        if texts:
            yield from rows()

    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    with small_batches(docs.sparkSession):
        return kept(
            filled.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), in decimals, as counts times SCALE may pass 64 bits."""
    scaled = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, total.cast("decimal(20,0)")).cast("long") + 1


def term_shares(counts: DataFrame, occurring: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The shares of the kept terms that a source has, and one row for each source.

    The first: lang, source, term, p, and q of the language. The second: lang,
    source, place (from 0 in its language), sources and kept terms of the
    language, and p0, the share of a term that the source has not.
    """
    entry = F.struct("source", "n")
    terms = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.collect_list(entry).alias("entries"))
    # A term's entries are one for each source at most.
    found = kept(terms.where(F.col("docs") >= least).select("lang", "term", "n_lang", F.inline("entries")))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("n_source"), F.count(F.lit(1)).alias("entries"))
    of_lang = Window.partitionBy("lang")
    by_lang = found.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("n_all"))
    known = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_source", "entries", "terms", "n_all")]
    sources = occurring.join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left").select(
        "lang", "source", *known)
    sources = kept(sources.select(
        "*", (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"),
        F.count(F.lit(1)).over(of_lang).alias("sources"),
        F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("n_source") + F.col("terms"))).alias("p0"),
    ))
    shares = join_groups(found, sources.where("entries > 0"), ["lang", "source"], "entries").select(
        "lang", "source", "term", "place", "sources", "terms",
        _share(F.col("n"), F.col("n_source") + F.col("terms")).alias("p"),
        _share(F.col("n_lang"), F.col("n_all") + F.col("terms")).alias("q"))
    return kept(shares), sources


# --- Distances --------------------------------------------------------------------


def pair_distances(shares: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value, the summed f over all kept terms.

    Terms are cut into slices of at most about ``CELLS`` shares; a task sets up the
    dense shares of a slice and compares each source of a block with all others.
    So neither a pair nor a term without occurrences is ever a row.
    """
    slices = F.greatest(F.ceil(F.col("terms") * F.col("sources") / F.lit(CELLS)), F.lit(1))
    blocks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("sources") / F.lit(SOURCE_BLOCK)).cast("int") - 1))
    entries = shares.select("lang", "term", "place", "p", F.pmod(F.xxhash64("term"), slices).alias("slice"), "sources").select(
        "lang", "term", "place", "p", "slice", blocks.alias("block"))
    # Slice 0 is there even without terms; the terms that no source of the block has are known from those of the slice.
    # A name of its own: Spark prunes the second side's column where both sides have it from one lineage.
    cut = sources.select("lang", "source", F.col("place").alias("position"), "p0", "sources",
                         F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))
    cut = cut.select("lang", "source", "position", "p0", "slice", blocks.alias("block"))
    keys = ["lang", "slice", "block"]

    def compared(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lang, block = key[0], int(key[2])
        right = right.sort_values("position")
        names = right["source"].tolist()
        sums = np.zeros((min(SOURCE_BLOCK, len(names) - block * SOURCE_BLOCK), len(names)), np.int64)
        own = range(block * SOURCE_BLOCK, block * SOURCE_BLOCK + len(sums))
        if len(left):
            terms = pd.factorize(left["term"])[0]
            q = np.repeat(right["p0"].to_numpy(np.int64)[:, None], terms.max() + 1, axis=1)
            q[left["place"].to_numpy(), terms] = left["p"].to_numpy(np.int64)
            for row, g in enumerate(own):
                gap = q[g] - q
                sums[row] = (gap * gap // q).sum(axis=1)
        out = [(lang, names[g], item, int(v)) for row, g in enumerate(own) for item, v in zip(names, sums[row]) if item != names[g]]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    parts = entries.groupBy(*keys).cogroup(cut.groupBy(*keys)).applyInPandas(
        compared, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def over_used_terms(shares: DataFrame) -> DataFrame:
    """lang, source, item (a term used more than in the language) and value."""
    gap = F.col("p") - F.col("q")
    value = F.call_function("div", gap * gap, F.col("q"))
    return shares.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of ``docs`` (text, lang, source)."""
    occurring = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    shares, sources = term_shares(source_counts(docs), occurring, least)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_distances(shares, sources).withColumn("rank", rank)
    terms = over_used_terms(shares).withColumn("rank", rank).where(F.col("rank") <= top)
    columns = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return pairs.select(*columns("pair")).unionByName(terms.select(*columns("term")))
