"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: a request, a response (or, where an earlier page has the same payload, a
revisit), and metadata; the other two name the response in WARC-Concurrent-To. Reading gives a row
for each record; assembly brings together the records of a capture by that identifier, and emits one
nested row for each. A revisit holds no payload: it names the response that does.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import hot_keys, left_join_spread
from .storage import new_path, place, written_table
from .token_files import filesystem
from .tokens import byte_slices

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def record_id(*parts: object) -> str:
    """The same identifier each time for the same parts, so that a task run twice writes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def with_first_copies(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, payload, place) with ``digest``, and, where several pages have the
    same payload of ``least_bytes`` or more, ``first``: the smallest page_id among them, and
    ``chosen``: whether this row, of those with that id the one of the smallest place, is the
    response that the others revisit. Payloads are counted by digest first; the join spreads those
    that many pages have."""
    hashed = pages.withColumn("digest", F.sha2("payload", 256))
    long = hashed.where(F.octet_length("payload") >= least_bytes).select("page_id", "place", "digest")
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "place"))
    counted = long.groupBy("digest").agg(F.min(known).alias("f"), F.count("*").alias("n")).where("n > 1 and f is not null")
    counted = written_table(counted.select("digest", F.col("f.page_id").alias("first"), F.col("f.place").alias("first_place"), "n"), "payloads")
    joined = left_join_spread(hashed, counted.drop("n"), "digest", hot_keys(counted, "digest", "n", pages.count()), F.xxhash64("place"))
    return joined.withColumn("chosen", F.coalesce(F.col("place") == F.col("first_place"), F.lit(False)))


def write_archives(df: DataFrame, folder: str | None = None, *, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", stable: bool = False) -> DataFrame:
    """Write a capture for each row to gzipped archives, a file for each task, and return their
    manifest: ``folder``, ``name``, ``n_captures``.

    Of rows with equal payloads of ``least_bytes`` or more, those with the smallest id are
    responses and the others revisit one of them; rows with a null id count as larger than any id,
    and if all have one, all are responses. Every row is a capture of its own, also rows that repeat
    an id or all their values. A null html is an empty payload; a null url is written empty. Other
    columns are not read. An empty table writes no file. The manifest is a written table: to read it
    again does not write the archives again.

    Rows are told apart by their place in the files that ``df`` scans (``stable=True``: ``df`` is a
    scan of Parquet files, each row of which it has once); anything else is written to the shared
    folder first.
    """
    folder = folder or new_path(df.sparkSession, "archives")
    columns = [df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), F.coalesce(df[html_col].cast("string"), F.lit("")).cast("binary").alias("payload")]
    scan = df if stable else written_table(df.select(*columns), "to-archive")
    pages = scan.select(*(columns if stable else scan.columns), place(scan).alias("place"))
    rows = with_first_copies(pages, least_bytes).select("page_id", "url", "payload", "digest", "first", "chosen")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, path = filesystem(folder)
        out, n = None, 0
        for row in (r for batch in batches for a, b in byte_slices(batch.column("payload")) for r in batch.slice(a, b - a).to_pylist()):
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/_{part:06d}-{attempt}.warc.gz", compression=None)
            for record in capture_records(row, (folder, part, n)):
                out.write(gzip.compress(record, 6, mtime=0))
            n += 1
        if out is not None:
            out.close()
            system.move(f"{path}/_{part:06d}-{attempt}.warc.gz", f"{path}/part-{part:06d}.warc.gz")
            yield pa.RecordBatch.from_pydict({"folder": [folder], "name": [f"part-{part:06d}.warc.gz"], "n_captures": pa.array([n], pa.int64())})

    return written_table(rows.mapInArrow(write, "folder string, name string, n_captures long"), "archive-manifest")


def response_id(page_id: int, digest: str) -> str:
    """The identifier of the one response that revisits of a payload name."""
    return record_id("payload", page_id, digest)


def capture_records(row: dict, place: tuple) -> list[bytes]:
    page, payload, first = row["page_id"], row["payload"], row["first"]
    revisit = first is not None and page != first
    own = response_id(page, row["digest"]) if row["chosen"] else record_id(*place, "response")
    url, digest = _one_line(row["url"]), f"sha256:{row['digest']}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    shared = [("WARC-Date", _DATE), ("WARC-Target-URI", url)]
    about = f"page-id: {'' if page is None else page}\r\npayload-bytes: {len(payload)}\r\n".encode()
    request = record_bytes([("WARC-Type", "request"), ("WARC-Record-ID", record_id(*place, "request")), *shared, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], b"GET / HTTP/1.1\r\n\r\n")
    if revisit:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared, ("WARC-Profile", _REVISIT), ("WARC-Refers-To", response_id(first, row["digest"])), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
    else:
        head = [("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
    metadata = record_bytes([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(*place, "metadata")), *shared, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], about)
    return [request, record_bytes(head, http if revisit else http + payload), metadata]


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by their names in lower case, and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record ends early")
        yield headers, block


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, http_head string, payload binary"


def read_records(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives in ``manifest`` (``folder``, ``name``); reading is
    spread over the files. For HTTP messages ``http_head`` and ``payload`` are apart; otherwise the
    payload is the block. Names may end in .warc or .warc.gz."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = filesystem(folder)
                with system.open_input_file(f"{place}/{name}") as raw, gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw as stream:
                    for headers, block in parse_records(stream):
                        head = b""
                        if headers.get("content-type", "").startswith("application/http"):
                            head, _, block = block.partition(b"\r\n\r\n")
                        get = headers.get
                        rows.append((get("warc-record-id"), get("warc-type"), get("warc-concurrent-to"), get("warc-refers-to"), get("warc-target-uri"), get("warc-payload-digest"), head.decode("utf-8", "replace"), block))
                        size += len(block)
                        if size > 4_000_000 or len(rows) >= 10_000:
                            yield _records(rows)
                            rows, size = [], 0
        if rows:
            yield _records(rows)

    files = manifest.select("folder", "name")
    tasks = 4 * manifest.sparkSession.sparkContext.defaultParallelism
    return files.repartition(tasks, "name").mapInArrow(read, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: ``capture_id`` (the response's or revisit's record id) and the
    nested ``request``, ``response`` (or revisit; see its ``type``) and ``metadata``. A missing
    record is null; a record that is concurrent to nothing that was read makes a capture without a
    response. Of several records of a kind in one capture, the smallest record id counts. Captures
    are brought together by one exchange on the identifier."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    whole = F.struct(*names)

    def of(*kinds: str) -> Column:
        return F.min(F.when(F.col("type").isin(*kinds), whole))

    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))


def field(metadata: Column, name: str) -> Column:
    """A field of a warc-fields block; null if it is not there or empty."""
    found = F.regexp_extract(metadata["payload"].cast("string"), f"(?m)^{name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def captured_pages(captures: DataFrame) -> DataFrame:
    """``page_id``, ``capture_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and
    ``refers_to`` (the page whose response a revisit names), a row for each capture with a response
    or revisit. For responses, size and digest are those of the payload as read; a revisit takes
    them from the response that it names, and has nulls if that was not read."""
    revisit = F.col("response.type") == "revisit"
    rows = written_table(
        captures.where("response is not null").select(
            field(F.col("metadata"), "page-id").cast("long").alias("page_id"),
            "capture_id",
            F.when(~revisit, F.octet_length("response.payload")).cast("long").alias("own_bytes"),
            F.when(~revisit, F.sha2("response.payload", 256)).alias("own_digest"),
            F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("named"),
        ),
        "captures",
    )
    responses = rows.where("record_type = 'response'")
    theirs = responses.select(F.col("capture_id").alias("named"), F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"))
    # Only revisits are joined: a response names nothing, and null keys would all meet in one task.
    revisits = rows.where("record_type = 'revisit'")
    counts = revisits.groupBy("named").agg(F.count("*").alias("n"))
    revisits = left_join_spread(revisits, theirs, "named", hot_keys(counts, "named", "n", rows.count()), F.xxhash64("capture_id"))
    named = ["page_id", "capture_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    alone = responses.select("page_id", "capture_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return alone.unionByName(revisits.select(*named))
