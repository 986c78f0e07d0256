"""Progress events: throttled by event time per run, as a stream and as the batch that it must equal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "run long, seq long, at double"


def kept(times: list[float], every: float, last: float | None) -> tuple[list[bool], float | None]:
    """Events at least ``every`` seconds after the last one that was kept."""
    out = []
    for t in times:
        ok = last is None or t - last >= every
        last = t if ok else last
        out.append(ok)
    return out, last


def throttle_batch(events: DataFrame, every: float) -> DataFrame:
    """(run, seq, at) thinned; a run's events are one group."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "seq"])
        return rows[kept(rows["at"].tolist(), every, None)[0]]

    return events.select("run", "seq", "at").groupBy("run").applyInPandas(group, SCHEMA)


def throttle_stream(events: DataFrame, every: float) -> DataFrame:
    """The same over a stream: the state of a run is the time of the last event kept."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["at", "seq"])
        ok, last = kept(rows["at"].tolist(), every, state.get[0] if state.exists else None)
        if last is not None:
            state.update((last,))
        yield rows[ok]

    return events.select("run", "seq", "at").groupBy("run").applyInPandasWithState(step, SCHEMA, "last double", "append", GroupStateTimeout.NoTimeout)


def last_status(log: DataFrame) -> DataFrame:
    """The state of each run: the last entry of its log."""
    return log.groupBy("run").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
