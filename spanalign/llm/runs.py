"""Streaming over sorted partitions, one run of equal keys at a time."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc


def runs(batches, key: str):
    """Tables of whole runs of equal ``key``, as many runs as stand in a batch, in order.

    A partition must be sorted by the key. Only the run that crosses a batch's end is carried over.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        last = keys[batch.num_rows - 1]
        cut = pc.index(pc.equal(keys, last), True).as_py()
        if rest and rest[-1].column(rest[-1].schema.get_field_index(key))[0] != last:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
            rest = []
        elif not rest and cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks()
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()
