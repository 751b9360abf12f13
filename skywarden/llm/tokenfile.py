"""Token ids in Arrow files of equal-length sequences.

The ids of all documents, in ascending order of their identifiers, are one stream. A file holds a range of it, cut into rows
of ``LENGTH`` ids: ``tokens`` and ``mask`` are fixed-size lists (the mask has a bit for each place, lowest first: 1 for an id, 0 for
padding, which only a file's last row has; ids have 16 bits where the vocabulary allows), ``starts`` lists the documents that begin in the row with their place in it and their number of ids. Files
are in Arrow's random-access format, uncompressed, so a mapped file gives any sequence without a copy.

A range partition by identifier makes a file of each task; files are streamed out a batch of rows at a time and appear
whole under their final name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skywarden.llm import store, words
from skywarden.llm.tokens import Encoder, tokenizer, word_chunks
from skywarden.session import fresh_folder, written

LENGTH = 2048
ROWS = 64
END = 2
FILE_BYTES = 16 << 20
START = pa.struct([("doc_id", pa.int64()), ("place", pa.int32()), ("n_tokens", pa.int64())])
INDEX = "part int, path string, n_tokens long, n_docs long"


def schema_for(vocabulary: int) -> pa.Schema:
    """Fields of a file whose ids are below ``vocabulary``."""
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("tokens", pa.list_(kind, LENGTH)), ("mask", pa.list_(pa.uint8(), LENGTH // 8)), ("starts", pa.list_(START))])


def _rows(ids: np.ndarray, starts: list[tuple[int | None, int, int]], schema: pa.Schema) -> pa.RecordBatch:
    """Sequences from ids (the last one padded) and the documents that start in them, by place in ``ids``."""
    n = -(-len(ids) // LENGTH)
    tokens, mask = np.zeros(n * LENGTH, schema.field("tokens").type.value_type.to_pandas_dtype()), np.zeros(n * LENGTH, np.uint8)
    tokens[:len(ids)], mask[:len(ids)] = ids, 1
    own: list[list[dict]] = [[] for _ in range(n)]
    for doc, at, size in starts:
        own[at // LENGTH].append({"doc_id": doc, "place": at % LENGTH, "n_tokens": size})
    return pa.RecordBatch.from_arrays(
        [pa.FixedSizeListArray.from_arrays(pa.array(tokens), LENGTH), pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(mask, bitorder="little")), LENGTH // 8),
         pa.array(own, pa.list_(START))], schema=schema)


def _writer(folder: str, path: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), Encoder(path, word_chunks)
        schema = schema_for(tokenizer(path).get_vocab_size())
        target = f"{folder}/part-{task.partitionId():07d}.arrow"
        held: list[np.ndarray] = []
        starts: list[tuple[int | None, int, int]] = []
        length = total = docs = 0
        with store.committed(target, task.taskAttemptId()) as out, pa.ipc.new_file(out, schema) as file:
            for batch in batches:
                for some in words.slices(batch, "text"):
                    for doc, ids in zip(some["doc_id"].to_pylist(), encoder.encode(some["text"].to_pylist())):
                        starts.append((doc, length, len(ids) + 1))
                        held += [ids, np.array([end], np.uint32)]
                        length += len(ids) + 1
                        total += len(ids) + 1
                        docs += 1
                    if length >= ROWS * LENGTH:
                        stream = np.concatenate(held)
                        whole = len(stream) // LENGTH * LENGTH
                        file.write_batch(_rows(stream[:whole], [s for s in starts if s[1] < whole], schema))
                        held, starts = [stream[whole:]], [(d, p - whole, n) for d, p, n in starts if p >= whole]
                        length -= whole
            if length:
                file.write_batch(_rows(np.concatenate(held), starts, schema))
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([target]),
                                              pa.array([total], pa.int64()), pa.array([docs], pa.int64())],
                                             ["part", "path", "n_tokens", "n_docs"])
    return write


def write_tokens(docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Write the documents' ids to files in ``folder`` and return the index of files: part, path, n_tokens, n_docs, before.

    ``before`` counts the ids of all earlier files. A null or empty text gives the end id only. Rows without an identifier
    come first; rows that repeat one are kept, ordered by text. Other columns are not looked at. An empty table gives no file.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / FILE_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    index = written(ordered.mapInArrow(_writer(folder, path, end), INDEX), "index")
    # prefix sums in two levels, a thousand files at a time
    group = F.floor(F.col("part") / 1000)
    inner = index.withColumn("group", group)
    sums = inner.groupBy("group").agg(F.sum("n_tokens").alias("tokens"))
    earlier = sums.withColumn("base", F.sum("tokens").over(Window.orderBy("group")) - F.col("tokens")).select("group", "base")
    local = F.sum("n_tokens").over(Window.partitionBy("group").orderBy("part")) - F.col("n_tokens")
    return inner.withColumn("local", local).join(earlier, "group").select(
        "part", "path", "n_tokens", "n_docs", (F.col("base") + F.col("local")).alias("before"))


def opened(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A file for random access; a local one is mapped into memory, so that its sequences are not copied."""
    system, path = store.place(uri)
    source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
    return pa.ipc.open_file(source)


def sequence(file: pa.ipc.RecordBatchFileReader, batch: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask bits of a sequence, as views of the file."""
    found = file.get_batch(batch)
    first = found.column("tokens").offset + row
    return tuple(found.column(name).values.to_numpy(zero_copy_only=True)[first * size:(first + 1) * size]
                 for name, size in (("tokens", LENGTH), ("mask", LENGTH // 8)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
            file = opened(path)
            rows: list[list] = []
            left = 0  # ids of the last document that following batches hold
            for number in range(file.num_record_batches):
                found = file.get_batch(number)
                tokens = found.column("tokens").values.to_numpy(zero_copy_only=True)

                def take(at: int, n: int) -> int:
                    some = tokens[at:at + n]
                    rows[-1][3] = zlib.crc32(some.astype("<u4"), rows[-1][3])
                    return n - len(some)
                if left:
                    left = take(0, left)
                for row, starts in enumerate(found.column("starts").to_pylist()):
                    for s in starts:
                        rows.append([s["doc_id"], before, s["n_tokens"], 0])
                        before += s["n_tokens"]
                        left = take(row * LENGTH + s["place"], s["n_tokens"])
            for at in range(0, len(rows), 10_000):
                cols = list(zip(*rows[at:at + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(index: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = written(index.select("path", "before"), "files")
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return files.repartition(tasks).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh(spark: SparkSession) -> str:
    return fresh_folder(spark, "tokens")
