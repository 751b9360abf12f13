"""Rows of one key in (time, packet id) order, however many they are.

Few rows are sorted in memory. More are sorted in runs that go to temporary files without a name, which end with the worker's
hold on them, and are merged block by block.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from skywarden.session import ship_to_workers

ship_to_workers(__name__)
RUN = 25_000  # rows sorted at once, and those of a block
PIECE = 512  # rows of a run that a merge holds
FAN = 128  # runs merged at once
COLUMNS = {"at": pa.int64(), "seq": pa.int64(), "amount": pa.int64(), "also": pa.int64(), "values": pa.list_(pa.string()), "row": pa.string()}


def in_order(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` (``COLUMNS``) in order, in blocks of about ``RUN`` rows."""
    parts, rows = [], 0
    levels: list[list[_Run]] = []
    for frame in frames:
        parts.append(frame)
        rows += len(frame)
        if rows >= RUN:
            _add(levels, _Run([_arrow(_sorted(parts))]))
            parts, rows = [], 0
    if not levels:
        yield _sorted(parts)
        return
    if parts:
        _add(levels, _Run([_arrow(_sorted(parts))]))
        parts = []
    for block in _merged([run for level in levels for run in level]):
        yield block.to_pandas()


def _sorted(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts, ignore_index=True).sort_values(["at", "seq"], ignore_index=True)


def _arrow(block: pd.DataFrame) -> pa.Table:
    return pa.Table.from_pandas(block, pa.schema(COLUMNS.items()), preserve_index=False)


def _times(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Times to sort by: rows without one come last."""
    return column.fill_null(2**63 - 1).to_numpy()


def _add(levels: list[list[_Run]], run: _Run, level: int = 0) -> None:
    """A run more; as many as are merged at once become one of the next level."""
    if level == len(levels):
        levels.append([])
    levels[level].append(run)
    if len(levels[level]) == FAN:
        full, levels[level] = levels[level], []
        _add(levels, _Run(_merged(full)), level + 1)


class _Run:
    """A sorted run in a file, read piece by piece; ``place`` is where its next row stands in the piece."""

    def __init__(self, blocks: Iterable[pa.Table]):
        self.file = tempfile.TemporaryFile()
        with pa.ipc.new_stream(self.file, pa.schema(COLUMNS.items()), options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            for block in blocks:
                out.write_table(block, max_chunksize=PIECE)
        self.file.seek(0)
        self.reader = pa.ipc.open_stream(self.file)
        self.piece = None

    def next_piece(self) -> bool:
        """Whether there is another; the file ends with the last one."""
        try:
            self.piece, self.place = self.reader.read_next_batch(), 0
        except StopIteration:
            self.file.close()
            return False
        self.at, self.seq = _times(self.piece.column("at")), self.piece.column("seq").to_numpy()
        self.last = (int(self.at[-1]), int(self.seq[-1]))
        return True

    def up_to(self, bound: tuple[int, int]) -> pa.RecordBatch | None:
        """The next rows of the piece up to ``bound``."""
        start, end = self.place, len(self.at)
        if bound < (self.at[start], self.seq[start]):
            return None
        if bound < self.last:
            end = int(np.searchsorted(self.at, bound[0], side="left"))
            ties = int(np.searchsorted(self.at, bound[0], side="right"))
            end += int(np.searchsorted(self.seq[end:ties], bound[1], side="right"))
        self.place = end
        return self.piece.slice(start, end - start)


def _merged(some: list[_Run]) -> Iterator[pa.Table]:
    """Blocks of ``RUN`` rows or some more, in order: all rows up to the least last one of the pieces held are known."""
    some = [run for run in some if run.next_piece()]
    parts, rows = [], 0
    while some:
        bound = min(run.last for run in some)
        for run in some:
            if (part := run.up_to(bound)) is not None:
                parts.append(part)
                rows += part.num_rows
        some = [run for run in some if run.place < len(run.at) or run.next_piece()]
        if rows >= RUN or not some:
            block = pa.Table.from_batches(parts)
            order = np.lexsort((block.column("seq").to_numpy(), _times(block.column("at"))))
            yield block.take(order)
            parts, rows = [], 0
