"""Streaming whole groups out of sorted Arrow batches, with bounded memory."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def group_cuts(df: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Row positions where a new group starts, plus the end."""
    new = np.zeros(len(df), bool)
    new[0] = True
    for k in keys:
        v = df[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(df))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, cuts) holding only complete groups; the open last group waits, batch by batch, for its end."""
    held: list[pd.DataFrame] = []
    for df in batches:
        if not len(df):
            continue
        if held and len(group_cuts(df, keys)) == 2 and len(group_cuts(pd.concat([held[-1].iloc[-1:], df.iloc[:1]]), keys)) == 2:
            held.append(df)
            continue
        df = pd.concat([*held, df], ignore_index=True) if held else df
        cuts = group_cuts(df, keys)
        held = [df.iloc[cuts[-2]:].reset_index(drop=True)]
        if len(cuts) > 2:
            yield df.iloc[:cuts[-2]], cuts[:-1]
    if held:
        df = pd.concat(held, ignore_index=True)
        yield df, group_cuts(df, keys)


def table_cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """`group_cuts` of an Arrow table; nulls are one value."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        if c.null_count:
            differs = pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), len(table))


def whole_tables(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """`whole_groups` of Arrow batches, about `rows` rows at a time; strings stay as they are."""
    held, n, least = [], 0, rows
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cuts = table_cuts(table, keys)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]), cuts[:-1]
        held = table.slice(cuts[-2]).to_batches()
        n = n - cuts[-2]
        least = max(rows, 2 * n)                    # a group larger than that is put together anew only when it has doubled
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, table_cuts(table, keys)
