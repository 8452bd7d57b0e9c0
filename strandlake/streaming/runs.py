"""Run collapse over a stream: an extension with the same rows as the batch form, given each read's events in order.

The state of a read is its open run. A run is emitted when another key follows; a read's last run stays open, as more of it
may come.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

_OUT = "user_id long, event_type string, mean double, start_idx long, end_idx long, event_len long, rows long"
_STATE = "event_type string, total double, weight long, lo long, hi long, n long"


def _row(read, state) -> dict:
    key, total, weight, lo, hi, n = state
    mean = round(total / weight * 1000) / 1000 if weight else None  # Python rounds half to even
    return {"user_id": read, "event_type": key, "mean": mean, "start_idx": lo, "end_idx": hi, "event_len": weight, "rows": n}


def collapse(key, frames, state):
    out, open_ = [], state.get if state.exists else None
    for pdf in frames:
        for r in pdf.sort_values(["ts", "event_id"]).itertuples():
            if open_ is not None and open_[0] == r.event_type:
                open_ = (open_[0], open_[1] + r.k * r.value, open_[2] + r.k, min(open_[3], r.event_id), max(open_[4], r.event_id), open_[5] + 1)
            else:
                if open_ is not None:
                    out.append(_row(key[0], open_))
                open_ = (r.event_type, float(r.k * r.value), int(r.k), int(r.event_id), int(r.event_id), 1)
    if open_ is not None:
        state.update(open_)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])


def stream_runs(events: DataFrame) -> DataFrame:
    """events: a streaming frame with user_id, ts, event_id, event_type, value, k."""
    return events.groupBy("user_id").applyInPandasWithState(collapse, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
