"""Token ids in Arrow files of fixed-size lists.

Documents in ascending id order make one stream of ids (an end id after each). Each file holds a
range of documents as record batches of two fixed-size-list columns: ``ids`` (uint16 or uint32, as
the tokenizer's ids need), ``sequence_length`` wide, and ``mask``, the bytes of a bit for each of
them, 1 for an id and 0 for padding, lowest bit first. All batches but the last have ``batch_rows``
sequences, so the batch and place of a sequence follow from its number by division; nothing is
compressed and every mask begins at a byte, so a memory map gives ids and mask without a copy. Only
the last sequence of a file is padded. A second file beside it, in
the same format, has a row for each document: its id, and where its ids start and how many there
are, in the file's stream.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import MOST_RANGES, in_ranges
from .storage import new_path
from .tokens import byte_encoder, text_slices, vocabulary_size


def filesystem(uri: str):
    """The pyarrow file system of a folder that executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer:
    """One file of sequences and its index. Both appear under their final names when closed, so a
    task that fails or runs twice leaves no half-written file that a reader could take."""

    def __init__(self, folder: str, name: str, attempt: int, ids: pa.DataType, key: pa.DataType, sequence_length: int, batch_rows: int):
        self._fs, path = filesystem(folder)
        self._length, self._rows, self._kind = sequence_length, batch_rows, ids
        self._final, self._temporary = f"{path}/{name}", f"{path}/_{name}-{attempt}"
        self._most = np.iinfo(ids.to_pandas_dtype()).max
        self.schema = pa.schema({"ids": pa.list_(ids, sequence_length), "mask": pa.list_(pa.uint8(), -(-sequence_length // 8))})
        self._out = pa.ipc.new_file(self._fs.open_output_stream(f"{self._temporary}.arrow"), self.schema)
        self._index = pa.ipc.new_file(self._fs.open_output_stream(f"{self._temporary}.docs.arrow"), pa.schema({"doc_id": key, "start": pa.int64(), "n_tokens": pa.int64()}))
        self._key, self._held, self._waiting, self.total = key, [], 0, 0

    def add(self, docs: pa.Array, values: np.ndarray, sizes: np.ndarray) -> None:
        if len(values) and int(values.max()) > self._most:
            raise ValueError(f"id {int(values.max())} does not fit {self._kind}")
        start = self.total + np.cumsum(sizes) - sizes
        self._index.write_batch(pa.RecordBatch.from_arrays([docs, pa.array(start), pa.array(sizes)], self._index_names))
        self.total += len(values)
        self._held.append(values)
        self._waiting += len(values)
        if self._waiting >= self._length * self._rows:
            self._flush(False)

    _index_names = ("doc_id", "start", "n_tokens")

    def _flush(self, last: bool) -> None:
        """Write full batches; at the end of the file, what is left too."""
        values, step = np.concatenate(self._held) if self._held else np.zeros(0, np.uint32), self._length * self._rows
        stop = len(values) if last else len(values) // step * step
        for a in range(0, stop, step):
            own = values[a : min(a + step, stop)]
            padded = np.zeros(-(-len(own) // self._length) * self._length, self._kind.to_pandas_dtype())
            padded[: len(own)] = own
            bits = np.packbits((np.arange(len(padded)) < len(own)).reshape(-1, self._length), axis=1, bitorder="little")
            pair = [pa.FixedSizeListArray.from_arrays(pa.array(padded), self._length), pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), bits.shape[1])]
            self._out.write_batch(pa.RecordBatch.from_arrays(pair, schema=self.schema))
        self._held, self._waiting = [values[stop:]], len(values) - stop

    def close(self) -> str:
        self._flush(True)
        self._out.close()
        self._index.close()
        for end in (".docs.arrow", ".arrow"):
            self._fs.move(f"{self._temporary}{end}", f"{self._final}{end}")
        return os.path.basename(self._final)


def write_token_files(
    df: DataFrame, tokenizer: str, folder: str | None = None, *, sequence_length: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 2048, batch_rows: int = 1024, most_ranges: int = MOST_RANGES,
) -> DataFrame:
    """Write all documents and return the manifest, a row for each file: ``folder``, ``name``,
    ``range_id`` (files in ascending order of ids), ``n_docs``, ``n_tokens``.

    Null and empty texts hold the end id alone. Null ids come first; equal ids follow the order of
    their texts, nulls first. An empty table writes no file. Other columns are not read. The rows
    of one id stay in one file, and there are at most ``most_ranges`` files: beyond that, files
    grow. Ids are written in 16 bits if all ids of the tokenizer fit, else in 32; an id that does
    not fit fails the job. The manifest is itself a written table: to read it again does not write
    the files again.
    """
    from .storage import written_table

    spark = df.sparkSession
    folder = folder or new_path(spark, "token-files")
    docs = in_ranges(df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")), "doc_id", "text", rows_per_file, most_ranges)
    ids = pa.uint16() if vocabulary_size(tokenizer) <= 1 << 16 else pa.uint32()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, attempt = byte_encoder(tokenizer), TaskContext.get().taskAttemptId()
        writer, at, n = None, None, 0
        system, place = filesystem(folder)
        system.create_dir(place, recursive=True)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"folder": [folder], "name": [writer.close()], "range_id": [at], "n_docs": [n], "n_tokens": [writer.total]}, schema=manifest)

        for batch in batches:
            ranges = batch.column("range_id").to_numpy()
            for first, stop in _runs(ranges):
                if ranges[first] != at:
                    if writer:
                        yield done()
                    at, n = int(ranges[first]), 0
                    writer = _Writer(folder, f"part-{at:06d}", attempt, ids, batch.column("doc_id").type, sequence_length, batch_rows)
                for a, b, texts in text_slices(batch.column("text").slice(first, stop - first)):
                    writer.add(batch.column("doc_id").slice(first + a, b - a), *encoder.encode(texts, end=True))
                n += stop - first
        if writer:
            yield done()

    manifest = pa.schema({"folder": pa.string(), "name": pa.string(), "range_id": pa.int64(), "n_docs": pa.int64(), "n_tokens": pa.int64()})
    made = docs.mapInArrow(write, "folder string, name string, range_id long, n_docs long, n_tokens long")
    # Exchanged first, so that adaptive execution joins the short rows to few Parquet files. Each task
    # that writes one has Hadoop start chmod, and until its exec such a process counts as much memory
    # as its executor's JVM once more.
    return written_table(made.repartition("range_id"), "token-manifest")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    bounds = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)] if len(values) else []
    yield from zip(bounds[:-1], bounds[1:], strict=True)


def open_token_file(folder: str, name: str) -> tuple[pa.ipc.RecordBatchFileReader, pa.Table]:
    """A reader of the sequences, mapped where the folder is a local one, and the documents' index."""
    system, path = filesystem(folder)
    local = getattr(system, "type_name", "") == "local"
    source = pa.memory_map(f"{path}/{name}.arrow") if local else system.open_input_file(f"{path}/{name}.arrow")
    index = pa.ipc.open_file(system.open_input_file(f"{path}/{name}.docs.arrow")).read_all()
    return pa.ipc.open_file(source), index


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the mask (see ``unpacked_mask``) of one sequence of a file, by its number,
    without a copy where the file is mapped. All batches but the last are as long as the first, so
    the place follows by division."""
    rows = reader.get_batch(0).num_rows if reader.num_record_batches else 1
    at, place = divmod(number, rows)
    if number < 0 or at >= reader.num_record_batches or place >= (batch := reader.get_batch(at)).num_rows:
        raise IndexError("no such sequence")
    widths = ((c, batch.schema.field(c).type.list_size) for c in ("ids", "mask"))
    return tuple(batch.column(c).flatten().slice(place * width, width).to_numpy() for c, width in widths)


def unpacked_mask(mask: np.ndarray, sequence_length: int) -> np.ndarray:
    """True for each place of a sequence that holds an id, from the bytes of its mask (or of several
    sequences, a row for each)."""
    return np.unpackbits(mask, axis=-1, count=sequence_length, bitorder="little").astype(bool)


def read_token_files(manifest: DataFrame, id_type: T.DataType | str = "long") -> DataFrame:
    """A row for each document, read from the files: ``doc_id``, ``range_id``, ``start`` (ids of
    all documents before it in the file), ``n_tokens`` (with the end id) and ``ids`` (binary,
    little-endian unsigned 32-bit). Reading is spread over the files; an empty manifest gives no rows."""
    schema = T.StructType([T.StructField("doc_id", T.LongType() if id_type == "long" else id_type), T.StructField("range_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, index = open_token_file(row["folder"], row["name"])
                starts, sizes = index["start"].to_numpy(), index["n_tokens"].to_numpy()
                docs = index["doc_id"].combine_chunks()
                # Sequences come batch by batch: only the ids of the documents of one piece are held.
                held, low, k, doc = np.zeros(0, np.uint32), 0, 0, 0
                while doc < len(starts):
                    while k < reader.num_record_batches and low + len(held) < starts[doc] + sizes[doc]:
                        got = reader.get_batch(k)
                        flat, bits = (got.column(c).flatten().to_numpy().reshape(got.num_rows, -1) for c in ("ids", "mask"))
                        held = np.concatenate([held, flat[unpacked_mask(bits, flat.shape[1])].astype("<u4")])
                        k += 1
                    stop = int(np.searchsorted(starts + sizes, low + len(held), side="right"))
                    bounds = (np.append(starts[doc:stop], starts[stop - 1] + sizes[stop - 1]) - low) * 4
                    packed = pa.Array.from_buffers(pa.binary(), stop - doc, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(held)])
                    part = slice(doc, stop)
                    yield pa.RecordBatch.from_arrays(
                        [docs.slice(doc, stop - doc), pa.array(np.full(stop - doc, row["range_id"])), pa.array(starts[part]), pa.array(sizes[part]), packed],
                        ["doc_id", "range_id", "start", "n_tokens", "ids"],
                    )
                    used = int(starts[stop - 1] + sizes[stop - 1])
                    held, low, doc = held[used - low :], used, stop

    spark = manifest.sparkSession
    files = manifest.select("folder", "name", "range_id")
    return files.repartition(spark.sparkContext.defaultParallelism * 4, F.col("range_id")).mapInArrow(read, schema)


def with_global_starts(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add to ``start`` the ids of all files before: a sum over the manifest, which has a row per
    file, not per document."""
    before = F.sum("n_tokens").over(_by_range()) - F.col("n_tokens")
    bases = manifest.select("range_id", before.alias("before"))
    return rows.join(F.broadcast(bases), "range_id").withColumn("start", F.col("start") + F.col("before")).drop("before")


def _by_range():
    from pyspark.sql import Window

    return Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, 0)
