"""Counts that a task adds up before they are shuffled, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes that a task gathers before it adds up equal ones.
ROWS, BYTES = 1 << 21, 96 << 20


def summed_rows(table: pa.Table) -> pa.Table:
    keys = [c for c in table.column_names if c != "n"]
    return table.group_by(keys).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"])


def combined(tables: Iterator[pa.Table], n_rows: int = ROWS, n_bytes: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Rows with equal keys added up, as far as bounded memory goes; sorted, as sorted rows are stored small.

    A worker holds about three times ``n_bytes`` while it adds up or sorts.
    """
    held: list[pa.Table] = []
    fresh = 0

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.sort_by([(c, "ascending") for c in table.column_names if c != "n"]).combine_chunks().to_batches(max_chunksize=65_536)

    for table in tables:
        held.append(table)
        fresh += table.num_rows
        if fresh >= n_rows or sum(t.nbytes for t in held) >= n_bytes:
            held, fresh = [summed_rows(pa.concat_tables(held))], 0
            if held[0].num_rows >= n_rows or held[0].nbytes >= n_bytes // 2:
                yield from out(held.pop())
    if held:
        yield from out(summed_rows(pa.concat_tables(held)))
