"""SentencePiece encoding by Gumbel top-k: distinct sampled segmentations of each text, and decoding.

A text's lattice has all ways to cut it into pieces of the model. A
segmentation's probability is proportional to the product of its pieces'
weights; the model holds merge ranks instead of probabilities, so a piece's
weight follows Zipf's law over its rank. A backward pass gives each edge's
probability among the edges of its node, so paths are drawn node by node.

The k segmentations are those with the k largest Gumbel-perturbed
log-probabilities, that is a sample without replacement in that order. They are
found by a best-first (A-star) search over sets of paths: the set of all paths
has a Gumbel at its log mass 0, which its best path inherits; the other paths
fall into sets that leave that path at one of its edges, each with a Gumbel at
its log mass cut off at the parent's value, which bounds every path in it. The
set with the largest value is opened next. The value of the next set unopened
is the threshold from which each sample's inclusion probability follows,
1 - exp(-exp(log p - threshold)).

Pieces never join across the start of a run of spaces or a line feed, so words
have lattices of their own, kept in a bounded store; the text's lattice is
their chain. The random numbers of a row come from its key and the seed alone.

Defined cases: a null or empty text has one segmentation, the empty one, with
probability 1; a text with fewer than k segmentations yields all it has;
repeated keys draw alike; a null key draws as one more key; an empty table gives
an empty result. Characters without a piece become their bytes' pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import exp, inf, log

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplypanel.llm.common import ship_package

MODEL = "piece_bpe_32k.model"
SAMPLES = 2
#: Words whose lattices are held; characters above which a word's is made by itself.
STORED, LONG = 300_000, 64
#: Multipliers of the table's hash, and its size.
ROLL, SPREAD, TABLE_BITS = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 18
SPACE = "▁"
CHUNKS = re.compile(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n")


def model_path() -> str:
    return public_tokenizers.path(MODEL)


#: Steps of the random streams.
STEP, WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Ids, log probability, perturbed value and log inclusion probability.
Sample = tuple[np.ndarray, float, float, float]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64; a stream is its key plus multiples of ``STEP``, mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, both excluded."""
    return ((_mixed(keys) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _mixed_int(key: int) -> int:
    return int(_mixed(np.array([key & (1 << 64) - 1], np.uint64))[0])


def _uniform_int(key: int) -> float:
    return float(_uniform(np.array([key], np.uint64))[0])


class _Path:
    """A segmentation as edges, the word of each edge, and its perturbed value."""

    def __init__(self, edges: np.ndarray, owner: np.ndarray, value: float):
        self.edges, self.owner, self.value = edges, owner, value

    def before(self, at: int, share: np.ndarray) -> float:
        return float(np.log(share[self.edges[:at]]).sum())


@lru_cache(maxsize=2)
def sampler(path: str) -> Sampler:
    return Sampler(path)


class Sampler:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        ranks = {i: r for r, i in enumerate(sorted(plain, key=lambda i: -model.get_score(i)))}
        total = log(sum(1 / (r + 2) for r in range(n)))
        self.weights = {model.id_to_piece(i): (i, -log(r + 2) - total) for i, r in ranks.items()}
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_weight = -log(n + 2) - total
        self.longest = max(map(len, self.weights))
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.content = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i)
                        else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.content_bytes = np.frombuffer(b"".join(self.content), np.uint8)
        self.content_end = np.cumsum([len(c) for c in self.content])
        self.content_start = self.content_end - [len(c) for c in self.content]
        self._index()
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        # Nodes: first edge. Edges, sorted by node: cumulated and own probability, target (-1: the word's end), id.
        self.first = array("i")
        self.reached, self.share, self.target, self.piece = array("d"), array("d"), array("i"), array("i")

    def _index(self) -> None:
        """A hash table of the pieces, for whole arrays of candidates: open addressing, linear probing."""
        self.slots = np.zeros(1 << TABLE_BITS, np.uint64)
        self.slot_id, self.slot_weight = np.zeros(1 << TABLE_BITS, np.int32), np.zeros(1 << TABLE_BITS)
        for piece, (i, w) in self.weights.items():
            h = 0
            for c in piece:
                h = (h * int(ROLL) + ord(c) + 1) & (1 << 64) - 1
            at = (h * int(SPREAD) & (1 << 64) - 1) >> 64 - TABLE_BITS
            while self.slots[at]:
                at = (at + 1) % (1 << TABLE_BITS)
            self.slots[at], self.slot_id[at], self.slot_weight[at] = h, i, w
        self.lone = {piece for piece in self.weights if len(piece) == 1}

    def _edges(self, word: str) -> tuple[list[list[tuple[int, int, float]]], list[int]]:
        """For each node its edges as (target, id, log weight), and an order in which targets come before sources.

        Nodes are the places before the characters, then those between the bytes
        of characters without a piece; target -1 is the word's end.
        """
        n, weights = len(word), self.weights
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        order: list[int] = []
        for i in range(n - 1, -1, -1):
            after = i + 1 if i + 1 < n else -1
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if found := weights.get(word[i:j]):
                    out[i].append((j if j < n else -1, *found))
            if word[i] not in weights:
                content, at, chain = word[i].encode(), i, []
                for b in content[:-1]:
                    out[at].append((len(out), self.byte_ids[b], self.byte_weight))
                    at = len(out)
                    out.append([])
                    chain.append(at)
                out[at].append((after, self.byte_ids[content[-1]], self.byte_weight))
                order += chain[::-1]
            order.append(i)
        return out, order

    def _add(self, word: str) -> int:
        edges, order = self._edges(word)
        mass, base = [0.0] * (len(edges) + 1), len(self.first)  # log mass to the end; the last, for target -1, is 0
        for at in order:
            sums = [w + mass[t] for t, _, w in edges[at]]
            top = max(sums)
            mass[at] = top + log(sum([exp(s - top) for s in sums])) if len(sums) > 1 else top
        for at, own in enumerate(edges):
            self.first.append(len(self.reached))
            total = 0.0
            for t, i, w in own:
                p = exp(w + mass[t] - mass[at])
                total += p
                self.reached.append(total)
                self.share.append(p)
                self.target.append(-1 if t < 0 else base + t)
                self.piece.append(i)
            self.reached[-1] = inf  # the last edge takes what rounding leaves
        return base

    def _found(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = (h * SPREAD >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out, open_ = np.full(len(h), -1), np.arange(len(h))
        while len(open_):
            held = self.slots[at[open_]]
            hit = held == h[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (held != 0)]
            at[open_] = (at[open_] + 1) & (1 << TABLE_BITS) - 1
        return out

    def _add_all(self, words: list[str]) -> None:
        """The lattices of many words at once; long words and those with characters without a piece one by one."""
        alone = {w for w in words if len(w) > LONG}
        for c in set("".join(words)) - self.lone:
            alone |= {w for w in words if c in w}
        for w in alone:
            self.places[w] = self._add(w)
        plain = [w for w in words if w not in alone]
        if not plain:
            return
        codes = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        begin = np.cumsum(sizes) - sizes
        end = np.repeat(begin + sizes, sizes)
        n, live = len(codes), np.arange(len(codes))
        h, source, goal, slot = np.zeros(n, np.uint64), [], [], []
        for length in range(1, self.longest + 1):
            live = live[live + length <= end[live]]
            h[live] = h[live] * ROLL + codes[live + length - 1]
            found = self._found(h[live])
            hit = found >= 0
            source.append(live[hit]), goal.append(live[hit] + length), slot.append(found[hit])
        source, goal, slot = map(np.concatenate, (source, goal, slot))
        # Masses from the ends of the words to their beginnings, all words together.
        order = np.argsort(source, kind="stable")  # sorted runs, one for each length
        by_node = source[order], goal[order], slot[order]
        order = np.argsort((end[by_node[0]] - by_node[0]).astype(np.uint8), kind="stable")
        source, goal, slot = (x[order] for x in by_node)
        to_end, weight = end[source] - source, self.slot_weight[slot]
        mass, last = np.zeros(n + 1), goal == end[source]
        cuts = np.searchsorted(to_end, np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            heads = np.flatnonzero(np.diff(source[a:b], prepend=-1))
            sums = weight[a:b] + np.where(last[a:b], 0.0, mass[goal[a:b]])
            top = np.maximum.reduceat(sums, heads)
            spread = np.repeat(top, np.diff(np.append(heads, b - a)))
            mass[source[a:b][heads]] = top + np.log(np.add.reduceat(np.exp(sums - spread), heads))
        (source, goal, slot), last = by_node, by_node[1] == end[by_node[0]]
        weight = self.slot_weight[slot]
        share = np.exp(weight + np.where(last, 0.0, mass[goal]) - mass[source])
        heads = np.flatnonzero(np.diff(source, prepend=-1))
        total = np.cumsum(share)
        reached = total - np.repeat(total[heads] - share[heads], np.diff(np.append(heads, len(source))))
        reached[np.append(heads[1:] - 1, len(source) - 1)] = inf  # the last edge takes what rounding leaves
        base, edge = len(self.first), len(self.reached)
        self.first.frombytes((heads + edge).astype("i").tobytes())
        self.reached.frombytes(reached.tobytes())
        self.share.frombytes(share.tobytes())
        self.target.frombytes(np.where(last, -1, goal + base).astype("i").tobytes())
        self.piece.frombytes(self.slot_id[slot].astype("i").tobytes())
        self.places.update(zip(plain, (begin + base).tolist()))

    @staticmethod
    def chunks(text: str) -> list[str]:
        return CHUNKS.findall(SPACE + text.replace(" ", SPACE))

    def prepare(self, texts: list[str | None]) -> list[np.ndarray]:
        """The first nodes of the words of each text; the lattices of new words are made in one go."""
        if len(self.places) > STORED:
            self._clear()
        places, cut = self.places, [self.chunks(t) if t else [] for t in texts]
        found = [list(map(places.get, chunks)) for chunks in cut]
        gaps = [[i for i, at in enumerate(own) if at is None] if None in own else () for own in found]
        missing = {chunks[i] for chunks, own in zip(cut, gaps) for i in own}
        if missing:
            self._add_all(list(missing))
            for chunks, own, at in zip(cut, found, gaps):
                for i in at:
                    own[i] = places[chunks[i]]
        return [np.array(own, np.int64) for own in found]

    def _draw(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path from each node to its word's end: the edges and the row of ``nodes`` of each, in order.

        Each row draws from its own key, so rows of many texts can go together.
        """
        first, reached, target = (np.frombuffer(x, x.typecode) for x in (self.first, self.reached, self.target))
        rows, steps, found = np.arange(len(nodes)), [], []
        while len(rows):
            at = first[nodes]
            keys = keys + STEP
            u = _uniform(keys)
            more = np.flatnonzero(u >= reached[at])
            while len(more):
                at[more] += 1
                more = more[u[more] >= reached[at[more]]]
            found.append(at)
            steps.append(rows)
            nodes = target[at]
            on = np.flatnonzero(nodes >= 0)
            rows, nodes, keys = rows[on], nodes[on], keys[on]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        edges, owner = np.concatenate(found).astype(np.int64), np.concatenate(steps)
        order = np.argsort(owner, kind="stable")
        return edges[order], owner[order]

    def _leave(self, path: _Path, at: int, gone: tuple[int, ...], u: float) -> tuple[int, int, int]:
        """Another edge than those ``gone`` at a place of a path: the edge, its word, its target (-1: the word's end)."""
        first = np.frombuffer(self.first, self.first.typecode)
        node = int(np.searchsorted(first, first.dtype.type(path.edges[at]), "right")) - 1
        end = int(first[node + 1]) if node + 1 < len(first) else len(self.target)
        choice = [e for e in range(int(first[node]), end) if e not in gone]
        u *= sum(self.share[e] for e in choice)
        for pick in choice:
            u -= self.share[pick]
            if u < 0:
                break
        return pick, int(path.owner[at]), self.target[pick]

    def _branch(self, path: _Path, heap: list, number: int, since: int, gone: tuple[int, ...], key: int, k: int) -> None:
        """Puts on the heap the best sets of paths that leave this one at an edge from ``since`` on.

        A set's value is a Gumbel at its log mass, cut off at the path's value.
        """
        edges, share = path.edges[since:], np.frombuffer(self.share, "d")
        size = 256  # log masses fall along the path; what is far below the first ones is out of reach
        while True:
            own = share[edges[:size]]
            logs, left = np.log(own), 1 - own
            if gone:
                left[0] -= sum(self.share[e] for e in gone)
            there = np.flatnonzero(left > 1e-12)
            mass = (np.cumsum(logs) - logs)[there] + np.log(left[there])
            if size >= len(edges) or (len(mass) > k + 1 and mass.max() - 45 > logs.sum()):
                break
            size *= 4
        if not len(mass):
            return
        if len(mass) > k + 1:  # what is below the precision of the whole cannot be told from nothing
            near = mass >= min(mass.max() - 45, np.partition(mass, -k - 1)[-k - 1])
            there, mass = there[near], mass[near]
        draws = -np.log(_uniform(np.uint64(key) + np.arange(1, len(mass) + 1, dtype=np.uint64) * STEP))
        values = -np.logaddexp(-path.value, np.log(draws) - (mass + path.before(since, share)))
        for b in np.argsort(-values, kind="stable")[: k + 1].tolist():
            at = since + int(there[b])
            heapq.heappush(heap, (-float(values[b]), number, at, (*(gone if at == since else ()), int(path.edges[at]))))

    def sample(self, starts: list[np.ndarray], keys: list[int], k: int = SAMPLES) -> list[list[Sample]]:
        """At most k segmentations of each text, best first.

        ``starts`` comes from the last call of ``prepare``, ``keys`` seed the
        texts. All texts go in step, a segmentation of each at a time, so that
        paths are drawn for all together; a text's draws depend on its key alone.
        """
        share, piece = (np.frombuffer(x, x.typecode) for x in (self.share, self.piece))
        heaps: list[list[tuple]] = [[] for _ in starts]
        paths: list[list[_Path]] = [[] for _ in starts]
        for turn in range(k):
            # For each text that has a set left: what stands before the fresh draws, and their first nodes.
            opened = []
            for d, nodes in enumerate(starts):
                if not len(nodes):
                    continue
                key = _mixed_int(keys[d] + 2 * turn * int(STEP))
                if turn == 0:
                    opened.append((d, None, 0, (), -log(-log(_uniform_int(key))), [], [], nodes, np.arange(len(nodes)), key))
                elif heaps[d]:
                    value, number, at, gone = heapq.heappop(heaps[d])
                    parent = paths[d][number]
                    pick, word, target = self._leave(parent, at, gone, _uniform_int(key))
                    later, own = nodes[word + 1 :], np.arange(word + 1, len(nodes))
                    if target >= 0:
                        later, own = np.append(target, later), np.append(word, own)
                    opened.append((d, parent, at, gone, -value, [pick], [word], later, own, key))
            if not opened:
                break
            sizes = [len(o[7]) for o in opened]
            streams = [np.uint64(o[9]) ^ (o[8].astype(np.uint64) + np.uint64(1)) * WORD for o in opened]
            edges, rows = self._draw(np.concatenate([o[7] for o in opened]), _mixed(np.concatenate(streams)))
            cuts = np.searchsorted(rows, np.cumsum([0, *sizes]))
            for (d, parent, at, gone, value, pick, word, _, own, key), a, b, base in zip(
                    opened, cuts[:-1], cuts[1:], np.cumsum([0, *sizes])):
                fresh, owner = edges[a:b], own[rows[a:b] - base] if b > a else rows[a:b]
                if parent:
                    fresh = np.concatenate([parent.edges[:at], pick, fresh]).astype(np.int64)
                    owner = np.concatenate([parent.owner[:at], word, owner]).astype(np.int64)
                path = _Path(fresh, owner, value)
                paths[d].append(path)
                self._branch(path, heaps[d], len(paths[d]) - 1, at, gone, _mixed_int(key + 1), k)
        out = []
        for found, heap in zip(paths, heaps):
            threshold = -heap[0][0] if heap else -inf
            logs = [float(np.log(share[p.edges]).sum()) for p in found]
            out.append([(piece[p.edges], q, p.value, _log_inclusion(q - threshold) if heap else 0.0)
                        for p, q in zip(found, logs)] or [(np.empty(0, np.int32), 0.0, 0.0, 0.0)])
        return out

    def decode_all(self, sequences: list[np.ndarray]) -> Iterator[bytes]:
        """``decode`` of many sequences at once, as UTF-8: the pieces' bytes are gathered for all together."""
        ids = np.concatenate([np.empty(0, np.int64), *sequences])
        sizes = self.content_end[ids] - self.content_start[ids]
        ends = np.cumsum(sizes)
        flat = self.content_bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.content_start[ids] - (ends - sizes), sizes)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, sequences)])].tolist()
        for a, b in zip(cuts, cuts[1:]):
            text = flat[a:b].tobytes()
            yield text[1:] if text.startswith(b" ") else text

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids."""
        content = self.content
        text = b"".join([content[i] for i in ids.tolist()]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    return x if x < -30 else log(-np.expm1(-exp(min(x, 700.0))))


def row_key(key: int | None, seed: int) -> int:
    """The random generator's seed for a row."""
    return zlib.crc32(f"{seed} {key}".encode()) << 32 | zlib.crc32(f"{key} {seed} row".encode())


def segmentations(docs: DataFrame, k: int = SAMPLES, seed: int = 0, path: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, sample (from 0), n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, decodes and, unless left out, ids.

    ``ids_crc32`` is over the ids as little-endian signed 32-bit numbers, ``decodes`` tells whether they give the text back.
    """
    ship_package(docs.sparkSession)
    path = path or model_path()
    names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "decodes"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sampler(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows, found = batch.slice(at, 256), [], []
                texts = part.column(1).to_pylist()
                ids_of = part.column(0).to_pylist()
                sampled = model.sample(model.prepare(texts), [row_key(key, seed) for key in ids_of], k)
                read = model.decode_all([own for samples in sampled for own, *_ in samples])
                for key, text, samples in zip(ids_of, texts, sampled):
                    wanted = (text or "").replace(SPACE, " ").encode()
                    for n, (own, p, g, inclusion) in enumerate(samples):
                        same = next(read) == wanted
                        rows.append((key, n, len(own), p, g, inclusion, zlib.crc32(own.astype("<i4").tobytes()), same))
                        if ids:
                            found.append(own)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                if ids:
                    columns.append(pa.array(found, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * ids)

    schema = ("doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, "
              "ids_crc32 long, decodes boolean" + ", ids array<int>" * ids)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(drawn, schema)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` (with ``ids`` and any other columns) with ``decoded``, the text of the ids; null ids give null."""
    ship_package(rows.sparkSession)
    path = path or model_path()
    names = [c for c in rows.columns if c != "decoded"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sampler(path)
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rows.select(*names).mapInArrow(read, rows.select(*names).withColumn("decoded", F.lit("")).schema)
