"""Runs of equal keys in a stream of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def groups(batches, keys: list[str]):
    """Over batches clustered by `keys`: (key tuple, pyarrow.Table) of each run. Holds one group and one batch."""
    pending: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)) for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:]):
            key = tuple(c[s].as_py() for c in cols)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(pending)
                pending = []
            last = key
            pending.append(b.slice(s, e - s))
    if pending:
        yield last, pa.Table.from_batches(pending)
