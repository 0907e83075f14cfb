"""Recurrences over a key's ordered rows that pass in sorted batches.

Spark sorts the rows, which spills; a task sees them batch by batch and keeps
the state of the open key alone, so its memory does not follow the length of a
key.  A key's rows are one task: that is what a recurrence asks for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def carried(df: DataFrame, keys: list[str], order: list[str], fresh: Callable[[], object], schema: str) -> DataFrame:
    """``fresh()`` gives a key's state, whose ``feed(rows)`` takes the key's next rows and returns rows of the schema."""

    def run(batches):
        at, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            head = batch[keys].astype(object).where(batch[keys].notna(), None)
            first = np.flatnonzero(np.r_[True, (head.iloc[1:].to_numpy() != head.iloc[:-1].to_numpy()).any(axis=1)])
            parts = []
            for a, b in zip(first, [*first[1:], len(batch)], strict=True):
                if (now := tuple(head.iloc[a])) != at:
                    at, state = now, fresh()
                parts.append(state.feed(batch.iloc[a:b]))
            made = pd.concat(parts)
            if len(made):
                yield made

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
