"""Event operators on streams; the batch forms are in operators. Windows are closed by watermark, the states of contracts never."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from irloom import vocab

_TABLE = {(a, t): b for a, t, b in vocab.CONTRACT}


def diagnostics(events: DataFrame, least: float = 0.7) -> DataFrame:
    """Events (ts, kind, confidence, ...) confident enough to report; stateless."""
    return events.where(F.col("confidence") >= least).withColumn("level", F.lit("warning"))


def kind_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, kind, n: counts over event time; a window closes once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n")).select("window.start", "kind", "n")


def contract_states(events: DataFrame) -> DataFrame:
    """resource_id, state, invalid after each batch: the contract's state machine over events (resource_id, seq, trigger).

    Families and escapes play no part, unlike in ``lifecycle.contract_fold``. A resource's state (two values) is kept for good, since
    events say nothing of its end; its events of one micro-batch are put in order together, in memory, so the trigger bounds them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, invalid = state.get if state.exists else ("unknown", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for trigger in rows["trigger"]:
            nxt = _TABLE.get((now, trigger))
            now, invalid = (nxt, invalid) if nxt else (now, invalid + 1)
        state.update((now, invalid))
        yield pd.DataFrame({"resource_id": [key[0]], "state": [now], "invalid": [invalid]})

    return events.groupBy("resource_id").applyInPandasWithState(step, "resource_id long, state string, invalid long", "state string, invalid long", "update", GroupStateTimeout.NoTimeout)
