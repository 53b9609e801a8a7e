"""Alerts with a hold time: a condition that has held for so long opens one, and its end closes it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROWS = "rule string, since bigint, until bigint, n bigint, state string"


class Hold(StatefulProcessor):
    """Of each rule: since when it has held, until which sample, in how many samples, and whether its alert is open.

    A timer opens the alert if the watermark passes the hold time and no sample has said otherwise."""

    def __init__(self, hold_ms: int):
        self.hold = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "since bigint, until bigint, n bigint, open boolean")

    def _told(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["rule", "since", "until", "n", "state"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        out: list[tuple] = []
        for at, over in pd.concat(list(rows)).sort_values("at")[["at", "over"]].itertuples(index=False):
            if over:
                if held is None:
                    held = (at, at, 1, False)
                    self.handle.registerTimer(at + self.hold)
                else:
                    held = (held[0], at, held[2] + 1, held[3])
                held = (*held[:3], held[3] or at - held[0] >= self.hold)
            elif held is not None:
                if held[3]:
                    out.append((*held[:3], "closed"))
                self.handle.deleteTimer(held[0] + self.hold)
                held = None
        if held is None:
            self.state.clear()
        else:
            held = (*(int(x) for x in held[:3]), bool(held[3]))
            self.state.update(held)
            if held[3]:
                out.append((*held[:3], "open"))
        yield from self._told(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            since, until, n, is_open = self.state.get()
            if not is_open and since + self.hold <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((since, until, n, True))
                yield from self._told(key, [(since, until, n, "open")])

    def close(self) -> None:
        pass


def held(samples: DataFrame, time: str, rule: Column, over: Column, hold: str, late: str) -> DataFrame:
    """What becomes known of alerts, from a stream of samples: rule, since, until (the last sample of the kind), n (samples) and state, open or closed.

    A sample without a condition counts as one that doesn't hold. Needs the RocksDB state store (``jobs.rocks``)."""
    hold_ms = int(pd.Timedelta(hold).total_seconds() * 1000)
    rows = samples.withWatermark(time, late).select(
        rule.cast("string").alias("rule"), F.col(time), F.unix_millis(F.col(time)).alias("at"), F.coalesce(over, F.lit(False)).alias("over")
    )
    out = rows.groupBy("rule").transformWithStateInPandas(Hold(hold_ms), ROWS, "append", "eventTime")
    return out.withColumns({c: F.timestamp_millis(c) for c in ("since", "until")})


def alerts(told: DataFrame) -> DataFrame:
    """A row for each alert, as it is known last: rule, since, until, n, state."""
    last = F.max_by(F.struct("until", "n", "state"), F.struct("n", F.col("state") == "closed")).alias("last")
    return told.groupBy("rule", "since").agg(last).select("rule", "since", "last.*")
