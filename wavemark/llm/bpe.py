"""BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes tokens for each distinct word. Byte-pair merging gives the same
tokens exactly if each is what merging makes of its own characters, and no merge crosses a boundary
between two neighbours before they are complete; the second is a property of the pair alone. Both
are tested for all words of a batch at once on arrays of merge ranks, and only words with a failing
pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import Memo, byte_alphabet, library, per_text, places, text_slices

_NEVER = np.iinfo(np.int64).max
#: Stretches with other characters than these are brought to normal form and cut by the file's own
#: normalizer and pre-tokenizer: lower case or class could differ between Unicode versions.
_RARE = re.compile("[^\t-\r\x20-\x84\x86-įı-ɏ‐-‧€]")
#: Words of more characters than this are merged by a heap instead of a scan for the lowest rank.
_LONG = 64


class SpeculativeBPE:
    """The words' tokens under the merges of a tokenizers file."""

    def __init__(self, said: dict):
        model = said["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max(self.vocab.values()) + 1
        a, b, made = (np.array([self.vocab[x] for x in column], np.int64) for column in ([m[0] for m in merges], [m[1] for m in merges], [x + y for x, y in merges]))
        self.ranks, self.made = {p: i for i, p in enumerate(zip(a.tolist(), b.tolist(), strict=True))}, made.tolist()
        order = np.argsort(a << 32 | b)
        self.pairs, self.pair_ranks = (a << 32 | b)[order], order
        self.rank, self.left, self.right = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(merges)), a, b
        # What follows holds for merges that each make a token of their own from tokens made before.
        if len(np.unique(made)) < len(made) or (self.rank[a] >= self.rank[made]).any() or (self.rank[b] >= self.rank[made]).any():
            raise ValueError("the merges do not follow from each other in order")
        self.sound = np.ones(size, bool)
        self.sound[made] = self.hold(a, b, self.rank[made])
        while True:
            after = self.sound.copy()
            after[made] &= self.sound[a] & self.sound[b]
            if (after == self.sound).all():
                break
            self.sound = after
        self.inner = {t: i for t, i in self.vocab.items() if not (self.end and t.endswith(self.end))}
        self.final = {t[: len(t) - len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.longest = max(map(len, self.vocab))
        self.longest_final = max(map(len, self.final), default=0)

    def _rank_of_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], _NEVER)

    def hold(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbouring tokens: that no merge crosses their boundary, up to rank
        ``until``. Goes back in time: the later made of the two is undone, which shows what stood
        at the boundary before, until both are single characters."""
        good, live, x, y = np.ones(len(a), bool), np.arange(len(a)), a, b
        ends_x = np.full(len(a), _NEVER) if until is None else until
        ends_y = ends_x
        while len(live):
            merge, made_x, made_y = self._rank_of_pair(x, y), self.rank[x], self.rank[y]
            # Of equal merges the leftmost comes first: one inside x before the boundary's, one inside y after it.
            crossed = (merge < ends_x) & (merge <= ends_y) & (merge < _NEVER)
            good[live[crossed]] = False
            on = ~crossed & ((made_x >= 0) | (made_y >= 0))
            undo_x = (made_x > made_y)[on]
            live, x, y, made_x, made_y, ends_x, ends_y = (z[on] for z in (live, x, y, made_x, made_y, ends_x, ends_y))
            ends_x, ends_y = np.where(undo_x, made_x, ends_x), np.where(undo_x, ends_y, made_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match from the left; None if some character is no token."""
        found, i, n = [], 0, len(word)
        inner, final, longest = self.inner.get, self.final.get, self.longest_final
        while i < n:
            if n - i <= longest and (token := final(word[i:])) is not None:
                found.append(token)
                return found
            j = min(n - 1, i + self.longest)
            while (token := inner(word[i:j])) is None:
                j -= 1
                if j <= i:
                    return None
            found.append(token)
            i = j
        return found

    def merge(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, of equal ranks the leftmost."""
        vocab, rank_of, made = self.vocab, self.ranks.get, self.made
        parts = [vocab[c] for c in (*word[:-1], word[-1] + self.end) if c in vocab]
        if len(parts) > _LONG:
            return self._merge_long(parts)
        ranks = [rank_of(p, _NEVER) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            parts[i] = made[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), _NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same for long words: a heap of (rank, place), and links to the neighbours left."""
        rank_of, made, n = self.ranks.get, self.made, len(parts)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        waiting = [(r, i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank_of(p)) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            if j >= n or parts[i] < 0 or rank_of((parts[i], parts[j])) != rank:
                continue  # one of the two has been merged since
            parts[i], parts[j] = made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank_of((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(waiting, (r, i))
            if before[i] >= 0 and (r := rank_of((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(waiting, (r, before[i]))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each non-empty word, written in the file's characters."""
        rows = [self.propose(w) for w in words]
        sizes = np.fromiter((len(r) if r else 0 for r in rows), np.int64, len(rows))
        flat = np.fromiter((t for r in rows if r for t in r), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        failed = np.array([r is None for r in rows], bool)
        failed[owner[~self.sound[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        keys, back = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        held = self.hold(keys >> 32, keys & 0xFFFFFFFF)
        failed[owner[inside[~held[back]]]] = True
        for i in np.flatnonzero(failed):
            rows[i] = self.merge(words[i])
        return rows


class TextEncoder:
    """Whole texts under a tokenizers file that lower-cases, drops white space, and cuts by a
    pattern; ``encode`` equals its encode(text, add_special_tokens=False). All words are encoded by
    ``SpeculativeBPE``; only texts with an added token's string go to the library. The ids of
    stretches between white space are remembered, up to ``memo_limit`` stretches."""

    def __init__(self, path: str, memo_limit: int = 300_000):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self._tokenizer = library(path)
        self._bpe = SpeculativeBPE(said)
        self._pattern = regex.compile(self._expected(said))
        self._added = [t["content"] for t in said["added_tokens"]]
        self._letters = {b: ord(c) for c, b in byte_alphabet().items()}
        self._memo = Memo(self._learn, memo_limit)

    @staticmethod
    def _expected(said: dict) -> str:
        """The pattern of a file of the kind that this class follows."""
        normal = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        cuts = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
            raise ValueError("the file does not lower-case, cut by a pattern and then take bytes")
        return cuts[0]["pattern"]["Regex"]

    def _words(self, stretch: str) -> list[str]:
        """The words of a stretch, written in the file's characters."""
        if _RARE.search(stretch):
            return [w for w, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(self._tokenizer.normalizer.normalize_str(stretch))]
        words = self._pattern.findall(stretch.lower())
        if stretch.isascii() and stretch.isprintable():
            return words
        return [w.encode().decode("latin-1").translate(self._letters) for w in words]

    def _learn(self, stretches: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        cut = [*map(self._words, stretches.to_pylist())]
        words = list({w for ws in cut for w in ws})
        known = dict(zip(words, self._bpe.encode_words(words), strict=True))
        rows = [[t for w in ws for t in known[w]] for ws in cut]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((t for r in rows for t in r), np.int32, int(lengths.sum())), lengths

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (int32), and the number of ids of each text."""
        whole, cut = {}, []
        for i, text in enumerate(texts):
            if text and any(a in text for a in self._added):
                whole[i] = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                cut.append("")
            elif text and _RARE.search(text):  # other white space may join with marks: left to the file's own cuts
                cut.append(_ASCII_SPACE.sub(" ", text))
            else:
                cut.append(" ".join((text or "").lower().split()))
        parts = pc.split_pattern(pa.array(cut, pa.string()), " ")
        stretches = parts.values.dictionary_encode()
        index, counts = stretches.indices.to_numpy().astype(np.int64), np.diff(parts.offsets.to_numpy())
        values, lengths = self._memo.ids(stretches.dictionary)
        values, lengths = values[places((np.cumsum(lengths) - lengths)[index], lengths[index])], lengths[index]
        sizes = per_text(lengths, counts)
        if whole:
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            values = np.concatenate([whole.get(i, values[cuts[i] : cuts[i + 1]]) for i in range(len(texts))])
            for i, row in whole.items():
                sizes[i] = len(row)
        return values, sizes


#: White space at which a text may be cut before it is brought to normal form.
_ASCII_SPACE = re.compile("[\t-\r ]+")


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker: its memo outlives a task."""
    return TextEncoder(path)


def encode_documents(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each row; with ``decode`` also ``decoded``, what
    ``decode_documents`` makes of the ids, in the same tasks. Null and empty texts have the empty
    array; null ids and repeated rows pass through; other columns are not read. An empty table gives
    no rows."""
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    if decode:
        schema = schema.add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, text_of = text_encoder(tokenizer), decoder(tokenizer) if decode else None
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                values, sizes = encoder.encode(texts)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))]
                if decode:
                    columns.append(pa.array([text_of(values[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(df: DataFrame, tokenizer: str, *, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the library's decode(ids, skip_special_tokens=False). A null array
    gives null, the empty one the empty text; ids that the file does not have are passed over, as
    the library does. A column of the input named ``decoded`` is replaced."""
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = decoder(tokenizer)
        for batch in batches:
            lists = batch.column(at)
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            out = [text_of(flat[a:b]) if own else None for a, b, own in zip(bounds[:-1], bounds[1:], known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], schema.names)

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


@lru_cache(maxsize=2)
def decoder(path: str) -> Callable[[np.ndarray], str]:
    """The text of some ids. A file without a decoder of its own joins tokens by single spaces; one
    that has a decoder, or whose ids leave gaps, is left to the library."""
    tokenizer = library(path)
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    tokens = np.empty(max(vocab.values()) + 1, object)
    for token, i in vocab.items():
        tokens[i] = token
    if tokenizer.decoder or any(t is None for t in tokens):
        return lambda ids: tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def joined(ids: np.ndarray) -> str:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
            ids = ids[(ids >= 0) & (ids < len(tokens))]
        return " ".join(tokens[ids].tolist())

    return joined
