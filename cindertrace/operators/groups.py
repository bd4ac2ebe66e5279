"""Functions of whole groups, at the cost of one call for a batch of rows instead of one for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Rows of a task that groups them by hash. AQE joins tasks by their compressed bytes, of which such rows have few.
TASK_ROWS = 200_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys over so many tasks that one has some TASK_ROWS. They are counted for that, so they should lie in files."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with fewer a join would deal them out again
    return rows.repartition(max(least, -(-rows.count() // TASK_ROWS)), *keys)


def each_group(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], dict], schema: pa.Schema, kinds: str) -> DataFrame:
    """work(table) of every group of rows by keys, each sorted by order; work gives the columns of schema.

    Spark deals the groups out by key and sorts them; a task cuts its sorted rows where a key changes, so
    only one group is held beyond a batch. Many small groups cost no more than their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            made: dict[str, list] = {c: [] for c in schema.names}
            for a, z in zip([0, *cuts], [*cuts, t.num_rows], strict=True):
                for c, values in work(t.slice(a, z - a)).items():
                    made[c].extend(values)
            return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

        def boundaries(t: pa.Table) -> list[int]:
            change = np.zeros(max(t.num_rows - 1, 0), bool)
            for k in keys:
                v = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
                change |= v[1:] != v[:-1]
            return (np.flatnonzero(change) + 1).tolist()

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            last = {k: b.column(k)[b.num_rows - 1].as_py() for k in keys}
            if all(held[0].column(k)[0].as_py() == v for k, v in last.items()):
                continue  # still one group
            t = pa.Table.from_batches(held)
            cuts = boundaries(t)
            yield out(t.slice(0, cuts[-1]), cuts[:-1])
            held = t.slice(cuts[-1]).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield out(t, boundaries(t))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)
