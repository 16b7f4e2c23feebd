"""Units of packets as they arrive: keyed state that holds the open unit of each file and packet id between micro-batches.

The rules are those of operators.demux.units, and over any number of micro-batches the closed units are the same, as
long as a pid's packets arrive in order from batch to batch (within a batch any order will do); a packet whose number isn't above
the last one of an earlier batch is late and is left out. A unit is given when the next one begins. The open unit's parts are a list in
the state store, appended to and not rewritten; a pid that is silent for `ttl` is forgotten with its open unit. Needs the
RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelframe.operators.demux import COUNTERS, UNIT, used

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Units(StatefulProcessor):
    def __init__(self, ttl: int | None = None, limit: int = 1 << 16):
        self.ttl, self.limit = ttl, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Last number, counter and payload seen; the open unit's ordinal (0: none yet), first number, packets and gaps.
        self.last = handle.getValueState("last", "number long, counter int, payload binary, unit long, first long, packets long, gaps long", self.ttl)
        self.parts = handle.getListState("parts", "payload binary", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("number", kind="stable")
        state = self.last.get()
        number, counter, payload, unit, first, packets, gaps = state if state is not None else (None, None, None, 0, 0, 0, 0)
        late, open_parts, out = number, [], []
        for row in batch.itertuples(index=False):
            now, data = None if pd.isna(row.counter) else int(row.counter), bytes(row.payload)
            if late is not None and row.number <= late:
                continue
            repeated = number is not None and now == counter and data == payload
            gap = number is not None and counter is not None and now != (counter + 1) % COUNTERS
            number, counter, payload = int(row.number), now, data
            if repeated:
                continue
            if row.start:
                if unit:
                    held = [bytes(x[0]) for x in self.parts.get()] if self.parts.exists() else []
                    out.append((*key, unit, first, packets, gaps, True, b"".join(held + open_parts)))
                self.parts.clear()
                unit, first, packets, gaps, open_parts = unit + 1, number, 0, 0, []
            if unit:
                packets, gaps = packets + 1, gaps + int(gap)
                open_parts.append(data)
        if open_parts:
            self.parts.appendList([(x,) for x in open_parts])
        if number is not None:
            self.last.update((number, counter, payload, unit, first, packets, gaps))
        yield pd.DataFrame(out, columns=["file", "pid", *(c.split()[0] for c in UNIT.split(", "))])

    def close(self) -> None:
        pass


def unit_stream(packets: DataFrame, ttl: int | None = None) -> DataFrame:
    """Closed units of a stream of packets; ttl: milliseconds after which a silent pid is forgotten."""
    own = used(packets)
    kinds = dict(own.dtypes)
    schema = f"file {kinds['file']}, pid {kinds['pid']}, {UNIT}"
    return own.groupBy("file", "pid").transformWithStateInPandas(Units(ttl), schema, "Append", "ProcessingTime" if ttl else "None")
