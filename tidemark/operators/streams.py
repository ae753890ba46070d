"""Helpers for functions that walk sorted partitions in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cuts batches sorted by keys so that no group is split; holds one batch and one group at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        changed = change_flags(b, keys)
        starts = np.flatnonzero(changed)
        if held:
            last = held[-1]
            if all(_same(last[k].iat[-1], b[k].iat[0]) for k in keys):
                starts = starts[1:]
        if not len(starts):
            held.append(b)
            continue
        cut = int(starts[-1])
        head = [*held, b.iloc[:cut]] if cut else held
        if head:
            yield pd.concat(head, ignore_index=True)
        held = [b.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _same(a, b) -> bool:
    return a == b or (a is None and b is None) or (a != a and b != b)


def change_flags(b: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from the row's before; the first row is a change."""
    out = np.zeros(len(b), dtype=bool)
    if len(b):
        out[0] = True
        for k in keys:
            v = b[k].to_numpy()
            out[1:] |= v[1:] != v[:-1]
    return out


def running_max(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running maximum that begins anew where starts is true."""
    return pd.Series(values).groupby(np.cumsum(starts)).cummax().to_numpy()
