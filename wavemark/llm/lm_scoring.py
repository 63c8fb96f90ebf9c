"""Stupid-backoff scores of documents under the n-gram counts of all documents.

Exploded n-grams (orders 1 to 3) are counted in tables partitioned by hash, joined back to the
n-grams, and summed for each document. To keep a row small, n-grams travel as pages: the distinct
n-grams of one block of documents that fall into one hash bucket, sorted, with their counts. The
count table of a bucket is the sum over its pages; the join within the bucket answers each page with
its n-grams' totals in the same order; the answers meet their block's documents again by block, where
every position takes the highest order with enough occurrences. A frequent n-gram is one entry of a
page, however often it occurs in a block. Buckets are as many as the bytes of the corpus need, so
pages become smaller as it grows, down to an n-gram each: never more of them than a row for each
block's n-grams would be.

The bucket of a common word has a page from every block. Where there are more blocks than
GROUP_BLOCKS, their pages are summed in groups of about so many blocks first, a bucket adds up its
groups' sums, and each group's pages are answered by themselves: no task holds a page of every block.

N-grams are told apart by their order and all 64 bits of their hash; nothing else compares them. Of n
distinct n-grams of one order, n * n / 2^65 pairs are expected to be taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import hashed_words, mix
from .storage import written_table
from .tokens import text_slices

ORDERS = 3
_SEEDS = np.array([0x8CB92BA72F3D8DD7, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F], np.uint64)
#: Bytes of an n-gram in a page (its order and the rest of its hash), and of these the noise; and of a count.
_WIDTH, _NOISE = 8, 5
_COUNT = 6
#: Blocks whose pages of one bucket are summed together.
GROUP_BLOCKS = 65_536


#: Fewer numbers than these are not worth compressing.
_FEW = 64


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray, width: int, plain: int = 0) -> bytes:
    """Unsigned numbers as ``width`` planes of their bytes, of which all but the lowest ``plain`` are
    compressed: those of hashes' steps are noise below, and say little above."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    if len(values) < _FEW:
        return b"\0" + planes.tobytes()
    return b"\1" + len(values).to_bytes(4, "little") + planes[:plain].tobytes() + _zstd().compress(planes[plain:].tobytes(), asbytes=True)


def unpack(data: bytes, width: int, plain: int = 0) -> np.ndarray:
    if data[:1] == b"\1":
        n = int.from_bytes(data[1:5], "little")
        data = data[5 : 5 + n * plain] + _zstd().decompress(data[5 + n * plain :], n * (width - plain), asbytes=True)
    else:
        data = data[1:]
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-case, cut at ASCII white space, and the number of words of each
    text."""
    return hashed_words([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])


def ngram_hashes(words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: where its n-grams end, among all words, and their hashes."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for order in range(1, ORDERS + 1):
        ends = np.flatnonzero(place >= order - 1)
        hashes = np.zeros(len(ends), np.uint64)
        for back in range(order):
            hashes = mix(hashes + words[ends - back] * _SEEDS[back])
        yield order, ends, mix(hashes ^ np.uint64(order))


def distinct_ngrams(words: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the n-grams of each order end; the buckets and the keys within them (the order, then
    the 64 - ``bits`` bits of the hash that the bucket does not tell; ``bits`` must be 2 or more) of
    the distinct n-grams, ascending; their counts; and the place of each n-gram, one order after
    another, among the distinct ones."""
    rest = np.uint64(64 - bits)
    ends, found, backs, many = [], [], [], []
    for order, own, hashes in ngram_hashes(words, sizes):
        known, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        ends.append(own)
        found.append(((known >> rest).astype(np.int32), np.uint64(order - 1) << rest | known & np.uint64((1 << int(rest)) - 1)))
        backs.append(back.astype(np.int32))
        many.append(counts.astype(np.int32))
        del hashes, known, back, counts
    buckets, keys = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(buckets, kind="stable")  # within a bucket by order, then by hash, as before
    at = np.empty(len(order), np.int32)
    at[order] = np.arange(len(order), dtype=np.int32)
    firsts = np.cumsum([0, *map(len, many[:-1])])
    return ends, buckets[order], keys[order], np.concatenate(many)[order], np.concatenate([at[b + f] for b, f in zip(backs, firsts, strict=True)])


def _by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of ascending buckets, and where each begins (and the last ends)."""
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    return buckets[first], np.append(first, len(buckets))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, block_chars: int) -> Iterator[tuple[int, pa.RecordBatch, list[str | None]]]:
    """Runs of rows, within batches, with the number of their block: a partition's rows in their
    order, cut after every ``block_chars`` characters."""
    from pyspark import TaskContext

    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for start, stop, texts in text_slices(batch.column(column)):
            first = 0
            for i, text in enumerate(texts):
                size += len(text or "") + 1
                if size >= block_chars:
                    yield block, batch.slice(start + first, i + 1 - first), texts[first : i + 1]
                    block, size, first = block + 1, 0, i + 1
            if first < len(texts):
                yield block, batch.slice(start + first, stop - start - first), texts[first:]


def _with_blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """(block, rows): runs of each block's rows as compressed Arrow streams, which take less to
    exchange than texts do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=_zstd())
        for block, rows, _ in _blocks(batches, 1, block_chars):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=options) as stream:
                stream.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return docs.mapInArrow(run, "block long, rows binary")


def _ngram_pages(docs: DataFrame, bits: int, block_chars: int) -> DataFrame:
    """(block, bucket, grams, counts): the distinct n-grams of each block, by bucket."""

    def pages(block: int, texts: list[str | None]) -> pa.RecordBatch:
        _, each, low, counts, _ = distinct_ngrams(*word_hashes(texts), bits)
        buckets, at = _by_bucket(each)
        steps = np.diff(low, prepend=np.uint64(0))
        steps[at[:-1]] = low[at[:-1]]
        grams, many = ([pack(v[a:b], *w) for a, b in zip(at[:-1], at[1:], strict=True)] for v, w in ((steps, (_WIDTH, _NOISE)), (counts, (_COUNT,))))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(buckets), block)), pa.array(buckets.astype(np.int32)), pa.array(grams, pa.binary()), pa.array(many, pa.binary())], ["block", "bucket", "grams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, []
        for block, _, texts in _blocks(batches, 0, block_chars):
            if block != at and held:
                yield pages(at, held)
                held = []
            at = block
            held += texts
        if held:
            yield pages(at, held)

    return docs.select("text").mapInArrow(run, "block long, bucket int, grams binary, counts binary")


def _summed(pages: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct n-grams of pages of one bucket, ascending, their counts, and the places of each
    page's n-grams among them."""
    grams = [np.cumsum(unpack(g, _WIDTH, _NOISE)) for g in pages["grams"].to_pylist()]
    known, back = np.unique(np.concatenate(grams), return_inverse=True)
    own = np.concatenate([unpack(c, _COUNT) for c in pages["counts"].to_pylist()]).astype(np.float64)
    total = np.minimum(np.bincount(back, weights=own, minlength=len(known)), (1 << 48) - 1).astype(np.uint64)
    return known, total, np.split(back, np.cumsum([*map(len, grams)])[:-1])


def _totals(pages: DataFrame, groups: int = 1) -> DataFrame:
    """(block, bucket, totals): each page's n-grams' counts over all blocks, in the page's order. A
    bucket is a bounded share of all distinct n-grams; a task holds its pages of a ``groups``-th of
    the blocks."""

    def run(table: pa.Table) -> pa.Table:
        _, total, places = _summed(table)
        return pa.table({"block": table["block"], "bucket": table["bucket"], "totals": [pack(total[p], _COUNT) for p in places]})

    answers = "block long, bucket int, totals binary"
    if groups == 1:
        return pages.groupBy("bucket").applyInArrow(run, answers)

    def of_group(table: pa.Table) -> pa.Table:
        known, total, _ = _summed(table)
        steps = np.diff(known, prepend=np.uint64(0))
        return pa.table({"bucket": table["bucket"].slice(0, 1), "group": table["group"].slice(0, 1), "grams": [pack(steps, _WIDTH, _NOISE)], "counts": [pack(total, _COUNT)]})

    def of_bucket(table: pa.Table) -> pa.Table:
        _, total, places = _summed(table)
        return pa.table({"bucket": table["bucket"], "group": table["group"], "grams": table["grams"], "totals": [pack(total[p], _COUNT) for p in places]})

    def answered(table: pa.Table, sums: pa.Table) -> pa.Table:
        known, total = np.cumsum(unpack(sums["grams"][0].as_py(), _WIDTH, _NOISE)), unpack(sums["totals"][0].as_py(), _COUNT)
        found = [pack(total[np.searchsorted(known, np.cumsum(unpack(g, _WIDTH, _NOISE)))], _COUNT) for g in table["grams"].to_pylist()]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "totals": found})

    keys = ("bucket", "group")
    dealt = pages.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    sums = dealt.groupBy(*keys).applyInArrow(of_group, "bucket int, group int, grams binary, counts binary")
    every = sums.groupBy("bucket").applyInArrow(of_bucket, "bucket int, group int, grams binary, totals binary")
    return dealt.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(answered, answers)


def score_positions(sizes: np.ndarray, ends: list[np.ndarray], found: np.ndarray, least: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its log score without the corpus size, and whether the score is that of the
    word alone (so that the logarithm of the size is still to be taken off). ``found``: corpus
    counts of the n-grams of all orders, which end at ``ends``."""
    words = np.empty(int(sizes.sum()))
    counts, low = [], 0
    for own in ends:
        full = np.zeros(len(words))
        full[own] = found[low : low + len(own)]
        low += len(own)
        counts.append(full)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    score, alone, open_ = np.zeros(len(words)), np.zeros(len(words), bool), np.ones(len(words), bool)
    for order in range(ORDERS, 0, -1):
        can = open_ & (place >= order - 1)
        if order > 1:
            here = can & (counts[order - 1] >= least)
            at = np.flatnonzero(here)
            score[at] += np.log(counts[order - 1][at]) - np.log(counts[order - 2][at - 1])
            open_ &= ~here
            score[can & ~here] += np.log(alpha)
        else:
            at = np.flatnonzero(can)
            score[at] += np.log(counts[0][at])
            alone[at] = True
    return score, alone


def bucket_bits(size: int, bucket_bytes: int) -> int:
    """So many bits of a hash that a bucket holds the n-grams of about ``bucket_bytes`` of text, or
    up to twice as much: what a bucket takes in memory does not grow with the corpus, nor with the
    length of its documents. A bucket's number has 30 bits at most, good for petabytes."""
    return min(30, max(2, (size // bucket_bytes).bit_length()))


def score_documents(df: DataFrame, *, least: int = 2, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8_000_000, bucket_bytes: int = 2_000_000, group_blocks: int = GROUP_BLOCKS, stable: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_score`` (sum of the natural logarithms of the words' scores)
    and ``mean_log_score`` (null without words).

    Words are lower-case and cut at ASCII white space. A word's score is count(w1 w2 w3) /
    count(w1 w2) if the trigram occurs ``least`` times or more among all documents, else ``alpha``
    times the bigram's, and so on down to count(w3) / all words. The first words of a text begin at
    the order that they allow, without the factor. The counts include the document itself. Null and
    empty texts have no words and score 0. Null ids and repeated rows are scored, and counted, like
    any other row; other columns are not read. An empty table gives no rows. N-grams are the same if
    their order and 64 bits of their hash are (see above); no other comparison is made.

    Blocks follow the rows' order in the partitions of ``df``, which must be the same each time: a
    scan of files gives that (``stable=True``); anything else is written to the shared folder
    first. A block whose n-grams differ from the first reading fails the job.
    """
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
    if not stable:
        docs = written_table(docs, "to-score")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, groups = bucket_bits(size, bucket_bytes), max(1, -(-(size // block_chars) // group_blocks))
    answers = _totals(_ngram_pages(docs, bits, block_chars), groups).select("block", "bucket", "totals")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_alone")), T.StructField("part_score", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = pa.concat_tables([pa.ipc.open_stream(r.as_buffer()).read_all() for r in left["rows"]])
        words, sizes = word_hashes(left["text"].to_pylist())
        ends, each, _, _, place = distinct_ngrams(words, sizes, bits)
        pages = dict(zip(right["bucket"].to_pylist(), right["totals"].to_pylist(), strict=True))
        buckets, at = _by_bucket(each)
        got = [unpack(pages.get(b, b"\0"), _COUNT) for b in buckets.tolist()]
        if [*map(len, got)] != np.diff(at).tolist() or len(pages) != len(got):
            raise RuntimeError("a block's n-grams are not those that were counted")
        totals = np.concatenate(got) if got else np.zeros(0, np.uint64)
        score, alone = score_positions(sizes, ends, totals[place], least, alpha)
        ends_of = np.concatenate([[0], np.cumsum(sizes)])
        ones = np.concatenate([[0], np.cumsum(alone)])[ends_of]
        per = [float(score[a:b].sum()) for a, b in zip(ends_of[:-1], ends_of[1:], strict=True)]
        return pa.table({"doc_id": left["doc_id"], "n_words": sizes, "n_alone": np.diff(ones), "part_score": pa.array(per, pa.float64())})

    left = _with_blocks(docs, block_chars)
    parts = written_table(left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema), "lm-parts")
    total = parts.agg(F.sum("n_words")).first()[0] or 1
    log_score = F.col("part_score") - F.col("n_alone") * F.log(F.lit(float(total)))
    return parts.select("doc_id", "n_words", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"))
