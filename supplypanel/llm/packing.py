"""Best-fit packing of token pieces into sequences of a fixed length, bettered by swaps.

Pieces are dealt by hash into groups of about ``GROUP_PIECES``. Each group is
packed best fit, longest piece first; then a local search takes the emptiest
sequences and moves a piece out, or exchanges one for one, two for one or one
for two with another sequence that has room, always so that the sum of squared
fills grows, until sequences become empty or the lower bound is met. The
emptiest sequences of each group, with at most an eighth of its pieces, go into
the next round, which has an eighth of the groups; the last round is one group
of bounded size. So no task sees more than a group, at any size of input.

Defined cases: a null or empty text is its end id alone; repeated rows and
repeated or null ids are packed row by row; an empty table gives an empty
result; only texts of more than a sequence are cut, whole sequences first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplypanel.llm.common import kept, ship_package
from supplypanel.llm.word_tokens import encoder, tokenizer_path

SEQUENCE = 2048
END_ID = 0
GROUP_PIECES = 8192
#: Groups of one round that make a group of the next, and the share of pieces that goes on.
FAN = 8
#: Tries of the local search in a group.
TRIES = 1500


def token_pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) for each piece of each row of ``docs``."""
    ship_package(docs.sparkSession)
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, piece, start, size, content = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoder(path).encode(text), np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    which.append(i), piece.append(k), start.append(at), size.append(len(part))
                    content.append(part.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(content, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Places of the pieces in each sequence; the longest first, each where least room is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set where some sequence has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins


class Swaps:
    """Local search over sequences: each step makes the sum of squared fills larger."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int, tries: int = TRIES):
        self.lengths, self.capacity, self.tries = lengths, capacity, tries
        self.bins = [list(b) for b in bins]
        self.fills = np.array([int(lengths[b].sum()) for b in self.bins], np.int64)
        self.home = np.zeros(len(lengths), np.int64)
        for b, members in enumerate(self.bins):
            self.home[members] = b

    def _put(self, out: list[int], back: list[int], donor: int, other: int) -> None:
        """Pieces ``out`` go from the donor to the other sequence, ``back`` the other way."""
        for i in out:
            self.bins[donor].remove(i), self.bins[other].append(i)
        for i in back:
            self.bins[other].remove(i), self.bins[donor].append(i)
        self.home[out], self.home[back] = other, donor
        gained = int(self.lengths[out].sum() - self.lengths[back].sum())
        self.fills[other] += gained
        self.fills[donor] -= gained

    def _exchange(self, out: list[int], donor: int) -> bool:
        """Gives ``out`` to the sequence that gains most by it: for nothing, for one piece, or for two."""
        size = int(self.lengths[out].sum())
        room = self.capacity - self.fills
        # The sum of squares grows where the other sequence ends fuller than the donor began.
        floor = self.fills[donor] - self.fills
        whole = (room >= size) & (floor < size) & (self.fills > 0)
        whole[donor] = False
        if whole.any():
            self._put(out, [], donor, int(np.argmin(np.where(whole, room, self.capacity + 1))))
            return True
        gain = size - self.lengths
        good = (gain > 0) & (gain <= room[self.home]) & (gain > floor[self.home]) & (self.home != donor)
        best = int(np.argmax(np.where(good, gain, 0))) if len(gain) else 0
        if len(gain) and good[best]:
            self._put(out, [best], donor, int(self.home[best]))
            return True
        if len(out) > 1:
            return False
        pair = self._pair(size, room, np.maximum(floor, 0), donor)
        if pair:
            self._put(out, pair, donor, int(self.home[pair[0]]))
        return bool(pair)

    def _pair(self, size: int, room: np.ndarray, floor: np.ndarray, donor: int) -> list[int]:
        """Two pieces of one sequence, shorter than ``size`` by more than its floor and by its room at most; of all
        sequences, the one with most room. For each first piece the second is looked up among sorted lengths."""
        ends = room > floor
        ends[donor] = False
        firsts = np.flatnonzero(ends[self.home] & (self.lengths < size))
        if not len(firsts):
            return []
        home, lengths = self.home[firsts], self.lengths[firsts]
        keys = home * (self.capacity + 1) + lengths
        order = np.argsort(keys, kind="stable")
        firsts, home, lengths, keys = firsts[order], home[order], lengths[order], keys[order]
        least = np.maximum(size - room[home] - lengths, 0)
        most = size - floor[home] - 1 - lengths
        base = home * (self.capacity + 1)
        # Pieces before the first one in this order would give the same pairs.
        low = np.maximum(np.searchsorted(keys, base + least), np.arange(len(keys)) + 1)
        high = np.where(most >= 0, np.searchsorted(keys, base + np.maximum(most, 0), side="right"), 0)
        found = np.flatnonzero(low < high)
        if not len(found):
            return []
        first = found[np.argmax(room[home[found]])]
        return [int(firsts[first]), int(firsts[low[first]])]

    def _lighten(self, donor: int) -> bool:
        members = sorted(self.bins[donor], key=lambda i: -self.lengths[i])
        pairs = [[i, j] for x, i in enumerate(members[:8]) for j in members[x + 1 : 8]]
        for out in [[i] for i in members] + pairs:
            self.tries -= 1
            if self.tries < 0 or self._exchange(out, donor):
                return self.tries >= 0
        return False

    def run(self) -> list[list[int]]:
        least = -(-int(self.lengths.sum()) // self.capacity)
        stuck = np.zeros(len(self.bins), bool)
        while np.count_nonzero(self.fills) > least and self.tries > 0:
            waiting = np.where((self.fills > 0) & ~stuck, self.fills, self.capacity)
            donor = int(np.argmin(waiting))
            if waiting[donor] == self.capacity:
                break
            if self._lighten(donor):
                stuck[:] = False  # what changed may make room for others
                stuck[donor] = self.fills[donor] == 0
            else:
                stuck[donor] = True
        return [b for b in self.bins if b]


def packed(lengths: np.ndarray, capacity: int = SEQUENCE) -> list[list[int]]:
    """The sequences of one group, as places of pieces."""
    return Swaps(lengths, best_fit(lengths, capacity), capacity).run() if len(lengths) else []


def _packer(capacity: int, pass_on: int, turn: int):
    """A function that packs one group's table; the emptiest sequences of at most ``pass_on`` pieces are not done."""

    def packed_group(table):
        lengths = table.column("length").to_numpy().astype(np.int64)
        group = table.column("_group")[0].as_py()
        order = np.argsort(table.column("_row").to_numpy())  # the shuffle's order must not matter
        bins = [[int(order[i]) for i in b] for b in packed(lengths[order], capacity)]
        bins.sort(key=lambda b: int(lengths[b].sum()))
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        done, passed_on = np.ones(len(lengths), bool), 0
        for k, members in enumerate(bins):
            sequence[members] = -1 - ((group * 16 + turn) * (1 << 16) + k)
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
            passed_on += len(members)
            if passed_on <= pass_on:
                done[members] = False
        for name, values in (("sequence_id", sequence), ("offset", offset), ("_done", done)):
            table = table.append_column(name, pa.array(values))
        return table

    return packed_group


def pack(pieces: DataFrame, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (any columns, with a long ``length`` from 1 to ``capacity``) with sequence_id and offset.

    Columns of these two names are replaced.
    """
    ship_package(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset")
    rows = kept(pieces.withColumn("_row", F.monotonically_increasing_id()))
    columns = [F.col(c) for c in pieces.columns]
    place = [F.col("sequence_id"), F.col("offset")]
    whole = rows.where(F.col("length") >= capacity)
    done = [whole.select(*columns, F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = rows.where(F.col("length") < capacity)
    groups, turn = max(1, -(-rest.count() // group_pieces)), 0
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in (
        ("_group", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("_done", T.BooleanType())))])

    while True:
        last = groups == 1
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(groups)).cast("long"))
        placed = kept(dealt.groupBy("_group").applyInArrow(_packer(capacity, 0 if last else group_pieces // FAN, turn), schema))
        done.append(placed.where("_done").select(*columns, *place))
        if last:
            break
        rest = placed.where("not _done").select(*columns, "_row")
        groups, turn = max(1, groups // FAN), turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def packed_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As ``packed_documents``, with ids_crc32 in place of the ids, which so stay out of every shuffle."""
    return pack(token_pieces(docs, path).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every piece of ``docs`` with its ids, its sequence and its offset there."""
    return pack(token_pieces(docs, path))
