"""Reading sorted partitions group by group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal ``keys``, also where one spans several batches; one run at a time is held."""
    held: list[pd.DataFrame] = []
    mark = None
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch) - 1, dtype=bool)
        for v in values:
            change |= v[1:] != v[:-1]
        starts = np.flatnonzero(np.concatenate([[True], change]))
        for at, end in zip(starts, [*starts[1:], len(batch)], strict=True):
            here = tuple(v[at] for v in values)
            if held and here != mark:
                whole, held = pd.concat(held) if len(held) > 1 else held[0], []
                yield whole
                del whole
            mark = here
            held.append(batch.iloc[at:end])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def map_groups(
    df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: Sequence[str] = ()
) -> DataFrame:
    """``fn`` on every group of ``keys``, in ``order``: for very many small groups.

    The rows are shuffled and sorted as a grouped map would, without its cost per group; results
    leave in batches. Keys must not be null.
    """
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, n = [], 0
        for group in runs(batches, names):
            out = fn(group)
            if len(out):
                ready.append(out)
                n += len(out)
            if n >= 10_000:
                yield pd.concat(ready)
                ready, n = [], 0
        if ready:
            yield pd.concat(ready)

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(run, schema)
