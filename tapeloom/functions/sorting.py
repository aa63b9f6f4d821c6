"""Sorting more rows than a Python worker should hold, by spilled runs."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

#: Rows of a run, which is sorted in memory, and of the blocks in which runs are merged.
RUN_ROWS, BLOCK_ROWS = 1 << 18, 1 << 13


def _ordered(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    return rows[np.lexsort(rows.T[::-1])]


def sorted_blocks(chunks: Iterable[np.ndarray], width: int, run_rows: int | None = None, block_rows: int | None = None) -> Iterator[np.ndarray]:
    """Reads all ``chunks`` (rows of ``width`` longs), then returns them ordered by their columns in blocks of at most ``block_rows``.

    Beyond ``run_rows`` sorted runs go to a temporary file. What is held is one run, and later a block of each run; rows that agree in the
    first two columns are in no stated order.
    """
    run_rows, block_rows = run_rows or RUN_ROWS, block_rows or BLOCK_ROWS
    parts, size, file, runs = [], 0, None, []
    for chunk in chunks:
        parts.append(chunk)
        size += len(chunk)
        if size >= run_rows:
            file = file or tempfile.TemporaryFile(prefix="runs-")
            runs.append((file.tell(), size))
            file.write(_ordered(parts).tobytes())
            parts, size = [], 0
    last = _ordered(parts) if parts else np.empty((0, width), "int64")
    merged = _merged(file, runs, last, width, block_rows) if runs else iter([last])
    return (block[i : i + block_rows] for block in merged for i in range(0, len(block), block_rows))


def _merged(file, runs: list[tuple[int, int]], last: np.ndarray, width: int, block_rows: int) -> Iterator[np.ndarray]:
    """In each round the rows up to the least of the last keys in memory of runs that go on in the file."""
    starts, left = [s for s, _ in runs], [n for _, n in runs]
    held = [np.empty((0, width), "int64") for _ in runs] + [last]
    while True:
        for k, n in enumerate(left):
            if n and not len(held[k]):
                take = min(n, block_rows)
                file.seek(starts[k])
                held[k] = np.frombuffer(file.read(take * width * 8), "int64").reshape(take, width)
                starts[k], left[k] = starts[k] + take * width * 8, n - take
        ends = [tuple(held[k][-1, :2]) for k, n in enumerate(left) if n]
        if not ends:
            break
        first, second = min(ends)
        out = []
        for k, h in enumerate(held):
            n = int(np.count_nonzero((h[:, 0] < first) | ((h[:, 0] == first) & (h[:, 1] <= second))))
            out.append(h[:n])
            held[k] = h[n:]
        yield _ordered(out)
    file.close()
    yield _ordered(held)
