"""Groups of sorted rows, whole, from the batches of a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def by_key(frames: Iterator[pd.DataFrame], key: str, work: Callable[[pd.DataFrame], Iterator]) -> Iterator:
    """Call ``work`` on frames that hold whole groups; rows of a group are neighbours in ``frames``.

    What is held is one batch and one group, so groups have to be bounded by what dealt the rows.
    """
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = frame[key].to_numpy()
        changes = np.flatnonzero(values[1:] != values[:-1])
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if rest and (cut or values[0] != rest[-1][key].iloc[-1]):
            whole = pd.concat([*rest, frame.iloc[:cut]], ignore_index=True)
            rest = []
            yield from work(whole)
        elif cut:
            yield from work(frame.iloc[:cut])
        rest.append(frame.iloc[cut:])
    if rest:
        yield from work(pd.concat(rest, ignore_index=True))
