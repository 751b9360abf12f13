"""WARC archives through a chunked record table.

A record travels as rows (record, chunk_no, bytes) of at most ``CHUNK`` bytes in order, never as a whole: the writer streams
chunks behind the record's header, the reader parses an archive as a stream and gives each chunk with the length and
the SHA-256 of the payload up to it, so that the last chunk of a record carries both of the whole payload.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the smallest identifier is the response, the others
are revisits of it and hold no payload; their HTTP header states its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from skywarden.llm import store
from skywarden.session import fresh_folder, written

CHUNK = 64 << 10
LEAST = 100
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id long, url string, n_bytes long, digest string, record_type string, refers_to long, chunk_no int, last boolean, bytes binary"
READ = ("page_id long, record_type string, refers_to long, stated_digest string, chunk_no int, last boolean, payload_bytes long, "
        "payload_digest string, bytes binary")


def record_table(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The pages as chunk rows. A null html is an empty payload; an empty payload is one empty chunk.

    Rows without an identifier are revisits if a row with one has the payload, else responses. Rows that repeat an identifier
    and payload are all responses if the identifier is the smallest.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"))
    copied = (rows.where(F.col("n_bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 and first is not null").select("digest", "first"))
    rows = rows.join(written(copied, "copied"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    last = F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / CHUNK).cast("int")
    chunks = F.when(again, F.array(F.struct(F.lit(0).alias("chunk_no"), F.lit(True).alias("last"), F.lit(b"").alias("bytes")))).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            i.alias("chunk_no"), (i == last).alias("last"), F.substring(F.col("payload"), i * CHUNK + 1, F.lit(CHUNK)).alias("bytes"))))
    return rows.select("page_id", "url", "n_bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                       F.when(again, F.col("first")).alias("refers_to"), F.inline(chunks))


def _header(row: dict) -> bytes:
    def line(value: object) -> str:
        return " ".join(str(value).split())
    length = row["n_bytes"] if row["record_type"] == "response" else 0
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n"
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:page:{'' if row['page_id'] is None else row['page_id']}>"),
              ("WARC-Date", DATE), ("WARC-Target-URI", line(row["url"] or "urn:none")), ("WARC-Payload-Digest", f"sha256:{row['digest']}")]
    if row["record_type"] == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + length)]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n", http]).encode()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist())
        row, number = next(rows, None), 0
        while row is not None:
            target, size, records = f"{folder}/part-{task.partitionId():07d}-{number:04d}.warc", 0, 0
            with store.committed(target, task.taskAttemptId()) as out:
                while row is not None and (size < FILE_BYTES or row["chunk_no"]):
                    head = _header(row) if not row["chunk_no"] else b""
                    out.write(head)
                    out.write(row["bytes"])
                    size += len(head) + len(row["bytes"])
                    if row["last"]:
                        out.write(b"\r\n\r\n")
                        records += 1
                    row = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([records], pa.int64())], ["path", "records"])
    return write


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows (a record's rows together and in order, as ``record_table`` gives them) to archives: path, records."""
    return written(chunks.mapInArrow(_writer(folder), "path string, records long"), "archives")


class Stream:
    """Reads lines and exact numbers of bytes from an input stream, a block at a time."""

    def __init__(self, source: pa.NativeFile, block: int = 1 << 20):
        self.source, self.block, self.buffer, self.at = source, block, b"", 0

    def _fill(self) -> bool:
        more = self.source.read(self.block)
        self.buffer, self.at = self.buffer[self.at:] + more, 0
        return bool(more)

    def line(self) -> bytes:
        """The next line without its end; empty at the end of the stream."""
        while (end := self.buffer.find(b"\r\n", self.at)) < 0:
            if not self._fill():
                return b""
        found, self.at = self.buffer[self.at:end], end + 2
        return found

    def header(self) -> dict[str, str]:
        """Fields up to an empty line."""
        found = {}
        while text := self.line().decode():
            name, _, value = text.partition(":")
            found[name.lower()] = value.strip()
        return found

    def take(self, n: int) -> bytes:
        """Up to ``n`` bytes; fewer only at the end of a block."""
        if self.at >= len(self.buffer) and not self._fill():
            raise EOFError("the archive ends inside a record")
        found = self.buffer[self.at:self.at + n]
        self.at += len(found)
        return found

    def more(self) -> bool:
        return self.at < len(self.buffer) or self._fill()


def _identifier(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def chunks_of(source: pa.NativeFile, with_bytes: bool = True, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of an archive, in the order of READ; memory is a block and a chunk."""
    stream = Stream(source)
    while stream.more():
        version = stream.line()
        if not version:
            continue
        fields = stream.header()
        left = int(fields["content-length"])
        http = {}
        if left:
            first = stream.line()
            used = len(first) + 2
            while text := stream.line():
                name, _, value = text.decode().partition(":")
                http[name.lower()] = value.strip()
                used += len(text) + 2
            left -= used + 2
        kind, refers = fields["warc-type"], fields.get("warc-refers-to")
        base = (_identifier(fields["warc-record-id"]), kind, _identifier(refers) if refers else None,
                fields.get("warc-payload-digest", "").removeprefix("sha256:"))
        if kind == "revisit":
            yield (*base, 0, True, int(http["content-length"]), base[3], b"" if with_bytes else None)
            continue
        digest, length, number = hashlib.sha256(), 0, 0
        while True:
            body = []
            room = min(chunk, left)
            while room:
                body.append(stream.take(room))
                room -= len(body[-1])
                left -= len(body[-1])
                digest.update(body[-1])
                length += len(body[-1])
            yield (*base, number, not left, length, digest.hexdigest(), b"".join(body) if with_bytes else None)
            number += 1
            if not left:
                break


def _reader(with_bytes: bool):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary())
    names = [part.split()[0] for part in READ.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for uri in batch["path"].to_pylist():
                system, path = store.place(uri)
                rows: list[tuple] = []
                with system.open_input_stream(path) as source:
                    for row in chunks_of(source, with_bytes):
                        rows.append(row)
                        if len(rows) >= (64 if with_bytes else 4096):
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)
    return read


def read_archives(archives: DataFrame, with_bytes: bool = True) -> DataFrame:
    """Chunk rows of the archives in ``archives`` (path); ``with_bytes=False`` leaves the bytes out."""
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(tasks).mapInArrow(_reader(with_bytes), READ)


def records(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_archives(archives, with_bytes=False).where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def fresh(spark: SparkSession) -> str:
    return fresh_folder(spark, "warc")
