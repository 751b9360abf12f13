"""Blocks of documents that ask buckets of hashes, with one packed message for each (block, bucket).

Documents are dealt by a hash of their identifier into blocks of a few MB. A block looks at all its texts together,
removes what repeats inside it, and sends a bucket one binary message instead of a row for each hash: a value that a
third of all documents hold reaches its bucket once for each block, however often it occurs. The bucket answers each
block with one message in the order of the block's own question. Both steps are ordinary grouped maps, so a lost
executor costs the recomputation of its partitions only.

Count-min sketch: a block's sketch has a row of cells for each hash it is given; it is sent sparsely, as sorted cells with counts. The bucket
adds up the sketches of all blocks and answers with the total of each cell asked for. Totals never fall below the
true count. The width follows the size of the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 4 << 20
CELLS_PER_ITEM = 8
MESSAGE = "step int, block int, bucket int, parts array<binary>"
ARROW_MESSAGE = pa.schema([("step", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("parts", pa.list_(pa.binary()))])


@dataclass(frozen=True)
class Layout:
    """How many blocks and buckets there are, and the width of a bucket's sketch."""
    blocks: int
    buckets: int
    width: int


def layout(df: DataFrame, text: str, bytes_per_item: float, block_bytes: int = BLOCK_BYTES, per_task: int = 2,
           cells: int = CELLS_PER_ITEM) -> Layout:
    """Sizes from the total length of the texts; one narrow aggregate over the table. There are at least ``per_task`` blocks a task."""
    total = df.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(per_task * tasks, math.ceil(total / block_bytes))
    buckets = max(tasks, blocks // 4)
    items = total / bytes_per_item / buckets
    return Layout(blocks, buckets, 1 << max(12, math.ceil(math.log2(cells * max(items, 1)))))


def block_of(key: Column, plan: Layout) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(plan.blocks)).cast("int").alias("block")


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of up to 32 bits, sorted for the smallest result: differences, byte planes, zstd."""
    step = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def messages(rows: list[tuple[int, int, int, list[bytes]]]) -> pa.Table:
    step, block, bucket, parts = zip(*rows) if rows else ((), (), (), ())
    return pa.table([pa.array(step, pa.int32()), pa.array(block, pa.int32()), pa.array(bucket, pa.int32()),
                     pa.array(parts, pa.list_(pa.binary()))], schema=ARROW_MESSAGE)


def received(table: pa.Table, step: int) -> dict[int, list[bytes]]:
    """Messages of a step by bucket."""
    return {bucket: parts for s, bucket, parts in zip(
        table["step"].to_pylist(), table["bucket"].to_pylist(), table["parts"].to_pylist()) if s == step}


def cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each run of a sorted array."""
    if len(bucket):
        at = np.flatnonzero(np.diff(bucket)) + 1
        edges = [0, *at.tolist(), len(bucket)]
        yield from zip(bucket[edges[:-1]].tolist(), edges[:-1], edges[1:])


class Sketch:
    """A block's part of the sketch: items given by a hash for each row, each with how often the block counts it."""

    def __init__(self, plan: Layout, *hashes: np.ndarray):
        self.bucket = ((hashes[0] >> np.uint64(40)) % np.uint64(plan.buckets)).astype(np.int64)
        self.rows = []
        for h in hashes:
            place = (self.bucket.astype(np.uint64) << np.uint64(32)) | (h & np.uint64(plan.width - 1))
            self.rows.append(np.unique(place, return_inverse=True))

    def question(self, step: int, block: int, counts: np.ndarray) -> pa.Table:
        """Cells and counts (255 stands for 255 and more) of each row, for each bucket."""
        bodies: dict[int, list[bytes]] = {}
        for place, inverse in self.rows:
            total = np.minimum(np.bincount(inverse, counts, len(place)), 255).astype(np.uint8)
            for bucket, a, b in cuts((place >> np.uint64(32)).astype(np.int64)):
                bodies.setdefault(bucket, []).extend(
                    (packed(place[a:b] & np.uint64(0xFFFFFFFF)), zstandard.compress(total[a:b].tobytes(), 1)))
        return messages([(step, block, bucket, parts) for bucket, parts in bodies.items()])

    def estimates(self, answers: dict[int, list[bytes]]) -> np.ndarray:
        """The least total of an item's cells; never below the true total (up to 255)."""
        out = None
        for row, (place, inverse) in enumerate(self.rows):
            total = np.zeros(len(place), np.uint8)
            for bucket, a, b in cuts((place >> np.uint64(32)).astype(np.int64)):
                total[a:b] = np.frombuffer(zstandard.decompress(answers[bucket][row]), np.uint8)
            mine = total[inverse]
            out = mine if out is None else np.minimum(out, mine)
        return out if out is not None else np.zeros(0, np.uint8)


def merge_sketches(step: int, width: int) -> Callable[[pa.Table], pa.Table]:
    """Add up the blocks' sketches of a bucket and answer each block with the totals of its cells."""

    def merge(table: pa.Table) -> pa.Table:
        asked = list(zip(table["block"].to_pylist(), table["bucket"].to_pylist(), table["parts"].to_pylist()))
        replies: list[list[bytes]] = [[] for _ in asked]
        for row in range(len(asked[0][2]) // 2):
            total = np.zeros(width, np.uint8)
            for _, _, parts in asked:
                cells, counts = unpacked(parts[2 * row]), np.frombuffer(zstandard.decompress(parts[2 * row + 1]), np.uint8)
                total[cells] += np.minimum(counts, 255 - total[cells])
            for reply, (_, _, parts) in zip(replies, asked):
                reply.append(zstandard.compress(total[unpacked(parts[2 * row])].tobytes(), 1))
        return messages([(step, block, bucket, reply) for (block, bucket, _), reply in zip(asked, replies)])

    return merge


def answered(questions: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return questions.groupBy("bucket").applyInArrow(answer, MESSAGE)


def with_messages(texts: DataFrame, answers: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Run ``function`` on each block's texts together with what buckets answered to the block."""
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(function, schema)
