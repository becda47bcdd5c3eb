"""Token ids of whole texts, with each word and pre-token encoded once per Python worker.

The tokenizer drops white space and never joins across it, so a text's ids are
those of its words in order. In text of printable characters below U+0130 only words not met
before are cut into pre-tokens, and of these only those not met before go to the model; a word with
any other character goes through the whole tokenizer. Strings of special tokens in a text are
ordinary text. Of neighbouring texts encoded together, each different word is looked up once.
Memory is bounded: the store has two generations; what is met again
moves to the young one, and when that is full the old one is dropped. So frequent
words are never encoded twice, however many rare ones there are.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, pairwise
from operator import attrgetter
from unicodedata import category

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Words with their pre-tokens, and odd words, that a generation of the store holds.
STORED = 200_000
#: Characters of a text that are cut at once, up to the next space or line end.
CUT_CHARACTERS = 1 << 20
#: Bytes of neighbouring texts, about, whose words are looked up together.
SHARED_BYTES = 1 << 21
DEFAULT = "word_bpe_49k.json"
#: Characters whose case, composition or kind is left to the tokenizer itself; white space is that between words.
ODD = re.compile("[^\t-\r\x20-\x7e\xa1-\xac\xae-\u012f]")


def _pre_tokens() -> re.Pattern:
    """The tokenizer's own cut into pre-tokens, with its classes of letters and numbers written out below U+0130."""
    of = {k: "".join(re.escape(chr(c)) for c in range(0x130) if category(chr(c))[0] == k) for k in "LN"}
    # The endings that are pre-tokens of their own.
    return re.compile(f"[{of['L']}]+|'(?:s|t|re|ve|m|ll|d)|[{of['N']}]|[^\\s{of['L']}{of['N']}]+")


PRE_TOKENS = _pre_tokens()
#: What may end a plain word after its last letter or number, where a pre-token always begins.
MARKS = "".join(chr(c) for c in range(0x130) if category(chr(c))[0] in "PS")
TOKEN_ID = attrgetter("id")
SPACE = re.compile("[ \t-\r]")
#: The ASCII characters that are not odd.
PRINTED = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F)])


def tokenizer_path() -> str:
    return public_tokenizers.path(DEFAULT)


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    return WordEncoder(path)


def release() -> None:
    """Gives back the memory of the worker's encoders."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its stores refer to each other


def _is_odd(text: str) -> bool:
    """Whether a text has a character that is left to the tokenizer."""
    return bool(text.encode().translate(None, PRINTED) if text.isascii() else ODD.search(text))


def _visible_bytes() -> list[str]:
    """The character for each byte: printable ones stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class _Store(dict):
    """Ids as bytes by pre-token or word; ``encode`` makes those that neither generation holds."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(self) >= STORED:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.table = {i: c for i, c in enumerate(_visible_bytes())}
        self.pieces, self.words = _Store(self._piece), _Store(self._word)

    def _piece(self, word: str) -> bytes:
        """The ids of a plain word in small letters; a pre-token is the word whose only pre-token it is."""
        if not word.isalpha():
            found = PRE_TOKENS.findall(word)
            if len(found) > 1:
                return b"".join(map(self.pieces.__getitem__, found))
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return array(self.code, map(TOKEN_ID, self.tokenizer.model.tokenize(shown))).tobytes()

    def _word(self, word: str) -> bytes:
        return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))

    def _part(self, text: str) -> bytes:
        """The ids of a text that begins and ends between words, as bytes."""
        if not _is_odd(text):
            return self._plain(text)
        words = (w.decode() for w in text.encode().split())
        return b"".join(
            b"".join(map(self.words.__getitem__, run)) if odd else self._plain(" ".join(run))
            for odd, run in groupby(words, key=_is_odd))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text as unsigned 32-bit numbers; none for null."""
        return np.frombuffer(b"".join(map(self._part, _cut(text or ""))), self.code).astype(np.uint32)

    def _parted(self, word: str) -> bytes:
        """The ids of a plain word in small letters, or of an empty one; marks behind letters are looked up by themselves."""
        if word.isalpha():
            return self.pieces[word]
        head = word.rstrip(MARKS)
        if head.isalpha():
            return self.pieces[head] + self.pieces[word[len(head):]]
        return self.pieces[word] if word else b""

    def _shared(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of some plain texts, in the tokenizer's own width; each different word is looked up once."""
        if not len(texts):
            return []
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = words.values.dictionary_encode()
        found = list(map(self._parted, coded.dictionary.to_numpy(zero_copy_only=False)))
        ids = pa.array(found, pa.binary()).take(coded.indices)  # their bytes lie end to end
        _, offsets, content = ids.buffers()
        ends = np.frombuffer(offsets, np.int32)[words.offsets.to_numpy()] // array(self.code).itemsize
        whole = np.frombuffer(content, self.code, ends[-1]) if ends[-1] else np.empty(0, self.code)
        return [whole[a:b] for a, b in pairwise(ends.tolist())]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order, as ``encode`` gives them.

        Neighbours of together about ``SHARED_BYTES`` are in memory at once. A text with
        characters that are left to the tokenizer, or of more than a cut, is encoded alone.
        """
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts)
        turns = np.cumsum(sizes.to_numpy()) // SHARED_BYTES
        for start, stop in pairwise([0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(texts)]):
            part = texts.slice(start, stop - start)
            alone = pc.or_(pc.match_substring_regex(part, ODD.pattern),
                           pc.greater(sizes.slice(start, stop - start), CUT_CHARACTERS))
            shared = iter(self._shared(part.filter(pc.invert(alone))))
            pa.default_memory_pool().release_unused()
            for i, own in enumerate(alone.to_pylist()):
                yield self.encode(part[i].as_py()) if own else next(shared).astype(np.uint32)


def _cut(text: str) -> Iterator[str]:
    """A text in parts of about ``CUT_CHARACTERS`` that end at white space; a longer word is not cut."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + CUT_CHARACTERS)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end
