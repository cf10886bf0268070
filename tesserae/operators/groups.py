"""Work on whole groups of rows in Arrow batches: rows are sorted by group and stream through a task, and only an open group is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def starts_of(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Places of the rows at which a group begins, in rows sorted by group. A null is a key of its own."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def by_group(df: DataFrame, keys: Sequence[str], work: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str, order: Sequence[str] = (), together: bool = False) -> DataFrame:
    """What work makes of batches of whole groups and the places where groups begin, rows of schema. Rows of a group come in an order, if
    one is given. together: the rows of a group are in one partition already; else they are dealt by key."""
    placed = (df if together else df.repartition(*keys)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made():
            whole = held[0] if len(held) == 1 else pa.concat_batches(held)
            return work(whole, starts_of(whole, keys))

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = starts_of(batch, keys)
            if held and all(held[-1].column(k)[-1].equals(batch.column(k)[0]) for k in keys):
                starts = starts[1:]
            if not len(starts):
                held.append(batch)
                continue
            last = int(starts[-1])
            if last:
                held.append(batch.slice(0, last))
            if held:
                yield from made()
            held = [batch.slice(last)]
        if held:
            yield from made()

    return placed.mapInArrow(run, schema)
