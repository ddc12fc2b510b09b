"""Row-count windows over a stream: an extension, for rows that come in order within each key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_window_mean(df: DataFrame, key: str, index: str, columns: Sequence[str], size: int) -> DataFrame:
    """(key, bin, means) of each full window of ``size`` rows of a key; a window that isn't full is never given out.

    State is one count and one sum a column for each key. Rows of a micro-batch are put in the order of ``index``.
    """
    columns = list(columns)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, *sums = state.get if state.exists else (0, *[0.0] * len(columns))
        rows = pd.concat(list(parts)).sort_values(index)[columns].to_numpy(np.float64)
        carried, made, at = np.array(sums, np.float64), [], 0
        while at < len(rows):
            take = min(size - seen % size, len(rows) - at)
            carried = carried + rows[at : at + take].sum(0)
            at, seen = at + take, seen + take
            if seen % size == 0:
                made.append([group[0], seen // size - 1, *(carried / size)])
                carried = np.zeros(len(columns))
        state.update((int(seen), *map(float, carried)))
        yield pd.DataFrame(made, columns=[key, "bin", *columns])

    kind = dict(df.dtypes)[key]
    doubles = ", ".join(f"{c} double" for c in columns)
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, bin bigint, {doubles}", f"seen bigint, {doubles}", "append", GroupStateTimeout.NoTimeout)
