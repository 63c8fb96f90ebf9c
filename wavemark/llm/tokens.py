"""Token ids of whole texts by a byte-level BPE file of the tokenizers library, for use inside
Spark tasks."""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 0
#: Longer words are encoded each time they come, so that the memo stays small.
MEMO_CHARS = 64
#: About as many characters go to the library at once: what it holds for each token is many times the token.
AT_ONCE = 200_000


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level BPE file writes bytes: printable Latin-1 stands for
    itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def library(path: str):
    """The file's tokenizer without truncation and padding. It keeps to the task's own thread: others
    would each hold memory of their own for as long as the worker lives."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Memo:
    """The ids of words, which are Arrow strings here and never become objects of their own unless
    they are new. ``learn`` gives the ids of words not met before: all ids end to end, and how many
    each has. At ``most`` words, those that came in one batch only are forgotten, and of the others
    the rarer, if they are more than half. Words of more than MEMO_CHARS characters are never kept."""

    def __init__(self, learn: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]], most: int):
        self._learn, self._most = learn, most
        self._words, self._hits = pa.array([], pa.string()), np.zeros(0, np.int64)
        self._values, self._lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _keep(self, kept: np.ndarray) -> None:
        first = np.cumsum(self._lengths) - self._lengths
        self._values = self._values[places(first[kept], self._lengths[kept])]
        self._words, self._lengths = self._words.take(pa.array(kept)), self._lengths[kept]

    def ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """For words of which none comes twice: all ids end to end (int32), and the number of ids of
        each word."""
        at = pc.index_in(words, value_set=self._words)
        fresh = at.is_null().to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(fresh))
        values, lengths = self._learn(new)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[fresh] = len(self._words) + np.arange(len(new))
        self._hits[place[~fresh]] += 1
        self._values, self._lengths = np.concatenate([self._values, values.astype(np.int32)]), np.concatenate([self._lengths, lengths])
        first = np.cumsum(self._lengths) - self._lengths
        found = self._values[places(first[place], self._lengths[place])], self._lengths[place]
        self._words, self._hits = pa.concat_arrays([self._words, new]), np.concatenate([self._hits, np.zeros(len(new), np.int64)])
        long = pc.greater(pc.utf8_length(new), MEMO_CHARS).to_numpy(zero_copy_only=False)
        if len(self._words) > self._most:
            half = self._most // 2
            least = max(1, int(np.partition(self._hits, -half)[-half]) + 1) if half else 1
            kept = self._hits >= least
            self._keep(np.flatnonzero(kept))
            self._hits = np.zeros(int(kept.sum()), np.int64)
        elif long.any():
            kept = np.ones(len(self._words), bool)
            kept[len(kept) - len(new) :] = ~long
            self._keep(np.flatnonzero(kept))
            self._hits = self._hits[kept]
        return found


def places(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs of ``lengths`` that begin at ``first``, run after run."""
    ends = np.cumsum(lengths)
    return np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def per_text(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``lengths`` over runs of ``counts`` of them."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    stops = np.cumsum(counts)
    return ends[stops] - ends[stops - counts]


#: Fixed value: white space, as regular expressions of any engine may understand it.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class ByteEncoder:
    """``encode`` equals the library's encode(text, add_special_tokens=False).

    Texts are cut before single spaces: there the library's pattern always begins a new word,
    whatever stands before, so the ids of a text are those of its words, each with the space before
    it. The library encodes each word that is new, and its ids are remembered. Texts in which the
    cut is not certain (a space with white space on both sides, or an added token's string) go to
    the library as a whole.
    """

    _UNCERTAIN, _BEGINS = f"[{_SPACE}] (?:[{_SPACE}]|$)", f"^[^{_SPACE}]"

    def __init__(self, path: str, most: int = 300_000):
        self._tokenizer = library(path)
        cut = json.loads(self._tokenizer.pre_tokenizer.__getstate__()) if self._tokenizer.pre_tokenizer else {}
        if cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or self._tokenizer.normalizer:
            raise ValueError("the file does not cut texts by the byte-level pattern alone")
        space = {b: c for c, b in byte_alphabet().items()}[0x20]
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._begins = np.fromiter(((self._tokenizer.id_to_token(i) or "").startswith(space) for i in range(size)), bool, size)
        self._memo = Memo(self._learn, most)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows, ends = [], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        for first, stop in runs(ends, AT_ONCE):
            rows += [np.array(e.ids, np.int32) for e in self._tokenizer.encode_batch_fast(texts[first:stop], add_special_tokens=False)]
        return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), np.fromiter(map(len, rows), np.int64, len(rows))

    def _learn(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with a space before each. They are encoded one after another as one
        text: the tokens that begin with a space tell where each begins. Only words that are empty,
        or begin with white space, are encoded alone."""
        begins = pc.match_substring_regex(words, self._BEGINS).to_numpy(zero_copy_only=False)
        joined = words.filter(pa.array(begins))
        cuts = pa.array(np.append(np.arange(0, len(joined), 1000), len(joined)).astype(np.int32))
        texts = [" " + t for t in pc.binary_join(pa.ListArray.from_arrays(cuts, joined), " ").to_pylist()] if len(joined) else []
        values, _ = self._plain(texts)
        alone, sizes = self._plain([" " + w for w in words.filter(pa.array(~begins)).to_pylist()])
        lengths = np.zeros(len(words), np.int64)
        lengths[begins] = np.diff(np.append(np.flatnonzero(self._begins[values]), len(values)))
        lengths[~begins] = sizes
        if len(alone):
            values = np.insert(values, np.repeat((np.cumsum(lengths * begins) - lengths * begins)[~begins], sizes), alone)
        return values, lengths

    def encode(self, texts: list[str | None], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (uint32), and the number of ids of each text. ``end``: id 0 follows
        each text. None counts as the empty text."""
        given = pa.array([t or "" for t in texts], pa.string())
        apart = pc.match_substring_regex(given, self._UNCERTAIN)
        for a in self._added:
            apart = pc.or_(apart, pc.match_substring(given, a))
        whole = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        parts = pc.split_pattern(pc.if_else(apart, "", given), " ")
        starts, counts = parts.offsets.to_numpy()[:-1], np.diff(parts.offsets.to_numpy())
        words = parts.values.dictionary_encode()
        index = words.indices.to_numpy().astype(np.int64)
        index[starts] = len(words.dictionary) + np.arange(len(texts))  # a text's first word has no space before it
        firsts = parts.values.take(pa.array(starts)).to_pylist()
        for i in whole.tolist():  # a text that is not cut is all first word
            firsts[i] = texts[i]
        (values, lengths), (more, sizes) = self._memo.ids(words.dictionary), self._plain(firsts)
        values, lengths = np.concatenate([values, more]), np.concatenate([lengths, sizes])
        values = values[places((np.cumsum(lengths) - lengths)[index], lengths[index])]
        sizes = per_text(lengths[index], counts)
        if end:
            values, sizes = np.insert(values, np.cumsum(sizes), END), sizes + 1
        return values.astype(np.uint32), sizes


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for each Python worker."""
    return ByteEncoder(path)


def vocabulary_size(path: str) -> int:
    """How many ids a tokenizers file has."""
    return library(path).get_vocab_size(with_added_tokens=True)


def runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of things that end at ``ends``, each of about ``most`` in all: first and stop."""
    first = 0
    while first < len(ends):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield first, stop
        first = stop


def give_back() -> None:
    """Memory that is free goes back to the system, because workers stay for other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def byte_slices(values: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of a batch's texts or binaries of about ``most`` bytes: first and stop."""
    yield from runs(np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy().astype(np.int64) + 1), most)
    give_back()


def text_slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, list[str | None]]]:
    """``byte_slices`` with the texts of each run, of which no others are Python strings meanwhile."""
    for first, stop in byte_slices(texts, most):
        yield first, stop, texts.slice(first, stop - first).to_pylist()
