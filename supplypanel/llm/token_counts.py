"""Edit-aware token counts: trees of pre-tokens that edits update in place.

A document's pre-tokens, in runs of ``LEAF``, are the leaves of a segment tree
that holds code points and tokens of every subtree. An edit (start, end,
replacement, in code points of the text before any of the edits) touches the
leaves that it overlaps; these and one leaf of context on the left are cut and
encoded again, and on the right as many more until a new pre-token begins where
an old leaf begins. From there the text and so its pre-tokens are as before: the
pattern looks one character ahead and never behind. Subtree sums above the
changed leaves are added up anew; the rest of the text is not read.

Defined cases: a null text is empty and has one empty leaf; edits may touch each
other and are taken by start; an edit that overlaps an earlier one, or lies
beyond the text, is cut to what is left; null edits are none; an empty table
gives an empty result; repeated rows are counted each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplypanel.llm.common import match_spans, ship_package

#: Pre-tokens in a leaf.
LEAF = 32
STORED = 300_000
RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def ranks_path() -> str:
    return public_tokenizers.path(RANKS)


class Counter:
    """Tokens of pre-tokens, with a bounded store."""

    def __init__(self, path: str):
        from base64 import b64decode

        with open(path, "rb") as file:
            ranks = {b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def tokens(self, pieces: list[str]) -> int:
        known = self.known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > STORED:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = len(self.encoding.encode_ordinary(p))
            return sum(map(known.__getitem__, pieces))

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Code points and tokens of the leaves of a text."""
        pieces = self.pattern.findall(text)
        runs = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        return [sum(map(len, r)) for r in runs], [self.tokens(r) for r in runs]


class TokenTree:
    """Leaves, and above them levels of pairwise sums up to one root."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = [list(chars)], [list(tokens)]
        self._build(0)

    def _build(self, first: int) -> None:
        """Sums above the leaves, for the pairs from leaf ``first`` on; those to its left stand."""
        for levels in (self.chars, self.tokens):
            k, at = 0, first
            while len(levels[k]) > 1:
                below, at = levels[k], at // 2
                if k + 1 == len(levels):
                    levels.append([])
                del levels[k + 1][at:]
                levels[k + 1] += [sum(below[j : j + 2]) for j in range(2 * at, len(below), 2)]
                k += 1
            del levels[k + 1 :]

    @property
    def total(self) -> int:
        return self.tokens[-1][0]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point, from the root down, and the leaf's first code point."""
        k, start = 0, 0
        for level in self.chars[-2::-1]:
            k *= 2
            while k + 1 < len(level) and k % 2 == 0 and start + level[k] <= place:
                start += level[k]
                k += 1
        return k, start

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Puts new leaves in place of the leaves from ``first`` to before ``last``."""
        if len(chars) == last - first:  # the same shape: only the paths to the root change
            self.chars[0][first:last], self.tokens[0][first:last] = chars, tokens
            for levels in (self.chars, self.tokens):
                lo, hi = first, last
                for k in range(1, len(levels)):
                    lo, hi, below = lo // 2, (hi + 1) // 2, levels[k - 1]
                    levels[k][lo:hi] = [sum(below[2 * j : 2 * j + 2]) for j in range(lo, hi)]
        else:
            self.chars[0][first:last], self.tokens[0][first:last] = chars, tokens
            self._build(first)


def edited(text: str, tree: TokenTree, edits: list[tuple[int, int, str]], count: Counter) -> tuple[str, int]:
    """The text after the edits and the code points that were encoded again; the tree is changed to fit it."""
    shift, again, done = 0, 0, 0
    for start, end, put in edits:
        start, end = min(max(start, done), len(text) - shift), min(max(end, start, done), len(text) - shift)
        done = end
        start, end = start + shift, end + shift
        text = text[:start] + put + text[end:]
        again += _update(text, tree, start, end, len(put) - (end - start), count)
        shift += len(put) - (end - start)
    return text, again


def _update(text: str, tree: TokenTree, start: int, end: int, grown: int, count: Counter) -> int:
    first, at = tree.find(max(0, start - 1))
    if first:  # one leaf of context, whose last pre-token may have looked at what changed
        first -= 1
        at -= tree.chars[0][first]
    last, bound = tree.find(end)
    leaves, pieces, place, stop = tree.chars[0], [], at, len(tree.chars[0])
    bound += grown  # where leaf ``last`` begins in the new text
    for m in count.pattern.finditer(text, at):
        while bound < m.start() and last < len(leaves):
            bound += leaves[last]
            last += 1
        if bound == m.start() >= end + grown and last > first:
            stop = last
            break
        pieces.append(m[0])
        place = m.end()
    runs = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)]
    if not runs and first == 0 and stop == len(tree.chars[0]):
        runs = [[]]
    tree.replace(first, stop, [sum(map(len, r)) for r in runs], [count.tokens(r) for r in runs])
    return place - at


_LEVELS = T.ArrayType(T.ArrayType(T.IntegerType()))


def token_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (with ``text`` and any other columns) with n_tokens and the tree: tree_chars and tree_tokens, levels from the leaves up."""
    ship_package(docs.sparkSession)
    path = path or ranks_path()
    rest = [c for c in docs.columns if c not in ("n_tokens", "tree_chars", "tree_tokens")]
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField("n_tokens", T.LongType()),
                           T.StructField("tree_chars", _LEVELS), T.StructField("tree_tokens", _LEVELS)])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in _slices(batches):
            trees = [TokenTree(*count.leaves(t or "")) for t in part.column("text").to_pylist()]
            yield _with_trees(part.select(rest), trees, {})

    return docs.mapInArrow(built, schema)


def apply_edits(trees: DataFrame, edits: str = "edits", path: str | None = None) -> DataFrame:
    """``trees`` with the edits of each row done: text, tree and n_tokens are the edited text's.

    ``edits`` names an array of structs start, end, text. Adds n_encoded: code points that were encoded again.
    """
    ship_package(trees.sparkSession)
    path = path or ranks_path()
    rest = [c for c in trees.columns if c not in ("text", "n_tokens", "tree_chars", "tree_tokens", "n_encoded", edits)]
    schema = T.StructType([
        *[trees.schema[c] for c in rest], T.StructField("text", T.StringType()), T.StructField("n_encoded", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("tree_chars", _LEVELS), T.StructField("tree_tokens", _LEVELS)])

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in _slices(batches):
            out, texts, encoded = [], [], []
            columns = [part.column(c).to_pylist() for c in ("text", "tree_chars", "tree_tokens", edits)]
            for text, chars, tokens, wanted in zip(*columns):
                tree = TokenTree.__new__(TokenTree)
                tree.chars, tree.tokens = chars, tokens
                steps = sorted((e["start"], e["end"], e["text"] or "") for e in wanted or [] if e)
                text, again = edited(text or "", tree, steps, count)
                out.append(tree), texts.append(text), encoded.append(again)
            yield _with_trees(part.select(rest), out, {
                "text": pa.array(texts, pa.string()), "n_encoded": pa.array(encoded, pa.int64())})

    return trees.mapInArrow(changed, schema)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _with_trees(part: pa.RecordBatch, trees: list[TokenTree], more: dict[str, pa.Array]) -> pa.RecordBatch:
    levels = pa.list_(pa.list_(pa.int32()))
    added = more | {
        "n_tokens": pa.array([t.total for t in trees], pa.int64()), "tree_chars": pa.array([t.chars for t in trees], levels),
        "tree_tokens": pa.array([t.tokens for t in trees], levels)}
    return pa.RecordBatch.from_arrays([*part.columns, *added.values()], names=[*part.schema.names, *added])


#: Personal data that the redaction edits replace: e-mail addresses, long hexadecimal runs, long numbers with separators.
PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[0-9a-f]{24,}|\+?[0-9][0-9 ().-]{6,}[0-9]"


def redactions(text: Column, mark: str = "[REDACTED]") -> Column:
    """Edits that replace personal data by a mark."""
    return F.transform(match_spans(F.coalesce(text, F.lit("")), PERSONAL), lambda x: F.struct(
        x.start.alias("start"), x.end.alias("end"), F.lit(mark).alias("text")))
