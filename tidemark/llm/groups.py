"""Groups of sorted rows inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[pa.Table]:
    """Rows sorted by key, as tables that hold all rows of each of their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for column in (batch.column(c).to_numpy() for c in key):
            new[1:] |= column[1:] != column[:-1]
        new[0] = bool(held) and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in key)
        cuts = np.flatnonzero(new)
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
