"""Token ids by the tokenizers library, with the ids of recent words kept at hand."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from matchloom.llm import common

#: Words whose ids one task keeps; more than these are encoded again.
CACHED_WORDS = 500_000
#: Bytes of text that are looked up at once, unless one text has more.
ENCODED_BYTES = 4 << 20
#: Kinds of bytes: where both vocabularies form pre-tokens, a letter, a digit, a sign (but the apostrophe, which contractions begin with)
#: and a line's end part; words with other bytes stay whole, as do those with several line ends in a row.
LETTER, DIGIT, SIGN, LINE, BLANK, OTHER = range(6)
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = SIGN
KIND[0x0A], KIND[0x20] = LINE, BLANK
WHITE = np.zeros(256, np.bool_)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Second bytes of Latin-1 letters, whose first is 0xC3.
LATIN = np.zeros(256, np.bool_)
LATIN[[k for k in range(0x80, 0xC0) if k not in (0x97, 0xB7)]] = True
#: New words that the library gets as one text, with an added token between them.
JOINED_WORDS = 64


@lru_cache(maxsize=2)
def loaded(path: str):  # noqa: ANN201
    """The library's tokenizer, read once for each worker; the words of a task go with it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Words(dict):
    """From a word to its number; a new word gets the next one and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def units(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the units of texts start, the bytes they have (lower-cased where that changes no ids), and the first unit of each text.

    Units tile the texts: a piece of a word, or a whole word that has other characters than `KIND` knows, each with the blank before it.
    """
    n = len(data)
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.empty(0, np.int64)
    lead = lead[LATIN[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = LETTER
    head = np.zeros(n + 1, np.bool_)
    head[offsets] = True  # texts
    word = head[:n].copy()
    word[kind == BLANK] = True  # a word starts with the blank before it
    starts = np.flatnonzero(word)
    body = starts + (kind[starts] == BLANK)  # its first byte after the blank
    ends = np.append(starts[1:], n)
    odd = kind == OTHER
    line = kind == LINE
    odd[:-1] |= line[:-1] & line[1:]
    some = body < ends
    edge = np.zeros(len(starts), np.bool_)
    edge[some] = line[body[some]] | line[ends[some] - 1]
    odd_words = (common.grouped_sum(odd, np.append(starts, n)) > 0) | edge | ~some
    # pieces of words that are not odd: where the kind changes; the blank goes with the first piece
    change = np.zeros(n, np.bool_)
    change[1:] = kind[1:] != kind[:-1]
    change[body[some]] = False
    plain = np.repeat(~odd_words, ends - starts)
    change &= plain
    change[starts] = True
    if lower:
        data = np.where(plain, common.LOWER[data], data)
        at = lead[plain[lead]]
        second = data[at + 1]
        data[at + 1] = np.where(second < 0x9F, second + 0x20, second)  # capital letters but the sharp s, which has none
    where = np.flatnonzero(change)
    return where, data, np.searchsorted(where, offsets)


class Encoder:
    """The ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives, for many texts at once.

    A blank between two characters that are not white space is the start of a
    pre-token in both kinds of vocabulary that this serves (byte-level BPE,
    where the blank belongs to the word that follows, and BPE with word ends,
    where it is dropped), so words with the blank before them, or their pieces, are encoded on
    their own, once each. Texts with a word that is empty or that begins or
    ends with other white space are encoded as a whole, as are those that spell
    an added token (``<|endoftext|>``), which the library looks for before it
    forms words and gives its one id.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        self.tokenizer = loaded(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = [t.content for t in added]
        #: Added tokens are looked for in normalised text: then a text cannot be told to have none.
        self.hidden = any(t.normalized for t in added)
        #: Whether the vocabulary lower-cases words anyway, so that pieces differing in case alone have the same ids.
        self.lower = "A" != self._normalised("A") == "a"
        self.limit = cached_words
        self._forget()

    def _normalised(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _forget(self) -> None:
        self.words = _Words()
        self.ids, self.start, self.length, self.whole = np.empty(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each of which the library gets as it is, and the number of ids of each."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that hold no added token, and the number of ids of each; the library treats what is between added tokens on its own."""
        if self.hidden or not self.added:
            return self._whole(words)
        mark = self.added[0]
        texts = [mark.join(words[k : k + JOINED_WORDS]) + mark for k in range(0, len(words), JOINED_WORDS)]
        ids = self._whole(texts)[0]
        ends = np.flatnonzero(ids == self.tokenizer.token_to_id(mark))
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _learn(self) -> None:
        new = self.words.new
        if not new:
            return
        bare = [w[1:] if w[:1] == " " else w for w in new]
        whole = np.fromiter((w != w.strip() or not w for w in bare), np.bool_, len(new))
        if self.hidden:
            whole[:] = True
        else:
            whole &= np.fromiter((w != "\n" for w in new), np.bool_, len(new))  # a line's end within a word is a piece
            every = "\0".join(new)
            if any(t in every for t in self.added):
                whole |= np.fromiter((any(t in w for t in self.added) for w in new), np.bool_, len(new))
        ids, lengths = self._ids(["" if x else w for w, x in zip(new, whole, strict=True)])  # a text with such a word is encoded as a whole
        start = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids, self.start, self.length, self.whole = (np.concatenate(p) for p in ((self.ids, ids), (self.start, start), (self.length, lengths), (self.whole, whole)))
        self.words.new = []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.words) > self.limit:
            self._forget()
        data, offsets = common.utf8(texts)
        where, data, first = units(data, offsets, self.lower)
        bounds = np.append(where, len(data))
        coded = pa.Array.from_buffers(pa.large_utf8(), len(where), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        known = np.fromiter(map(self.words.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        self._learn()
        number = known[coded.indices.to_numpy()]
        start, length, pool = self.start[number], self.length[number], self.ids
        odd = common.grouped_sum(self.whole[number], first) > 0
        filled = np.flatnonzero(np.diff(offsets) > 0)
        odd[filled] |= WHITE[data[offsets[filled]]]
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(odd)
        if len(odd):
            ids, lengths = self._whole(texts.take(pa.array(odd)).to_pylist())
            for k in odd:
                length[first[k] : first[k + 1]] = 0
            start[first[odd]] = len(pool) + np.cumsum(lengths) - lengths
            length[first[odd]] = lengths
            pool = np.concatenate([pool, ids])
        ends = np.cumsum(length)
        gathered = pool[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        return gathered, common.grouped_sum(length, first)


def encoded(texts: pa.Array, encoder: Encoder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids of a block of rows, bounds of each row's ids); null counts as empty."""
    _, offsets = common.utf8(texts)
    for i, j in common.blocks(offsets, ENCODED_BYTES):
        ids, n = encoder.encode(pc.fill_null(texts.slice(i, j - i), ""))
        yield i, ids, np.concatenate([[0], np.cumsum(n)])
