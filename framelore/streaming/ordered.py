"""Rules over streams in event-time order.

A micro-batch brings rows in any order, and late ones up to the watermark. ``replay``
holds the rows of a key until the watermark has passed them, so that none can come
before them any more, and only then folds them, in order, through the rule's state. What
comes out is what one ordered pass over the same rows gives, however they arrived. The buffer
holds what arrived within the watermark's delay, never more.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (key, rows in order, the rule's state or None, the watermark in seconds) -> (output rows, state or None).
#: The state must be JSON-able. If it is a dict with ``due``, the fold is also called, without rows, once the watermark has passed that second.
Fold = Callable[[tuple, pd.DataFrame, object, float], tuple[list[tuple], object]]


def _millis(rows: pd.DataFrame, ts: str) -> pd.Series:
    """The least whole millisecond not before each instant; the watermark is in milliseconds."""
    at = rows[ts]
    at = at.dt.tz_localize(None) if at.dt.tz is not None else at
    return -(-at.astype("datetime64[us]").astype("int64") // 1000)


def _due(memo: object) -> int | None:
    """When the fold wants to be called again, in milliseconds."""
    due = memo.get("due") if isinstance(memo, dict) else None
    return None if due is None else int(-(-due * 1000 // 1))


def _pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


def replay(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str | T.StructType, fold: Fold,
           ts: str = "event_ts", idle_s: float | None = 3600.0) -> DataFrame:
    """Fold the rows of each key in the order of (``ts``, ``order``), each once the watermark has passed it.

    ``rows`` carries a watermark on ``ts``. A fold that returns no state forgets its key; a
    state is also dropped when the watermark is ``idle_s`` beyond the key's last row (None:
    never by time). Rows behind the watermark are dropped by Spark before they get here.
    """
    schema = out if isinstance(out, T.StructType) else T.StructType.fromDDL(out)
    names, names_in = [f.name for f in schema.fields], rows.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, memo, last = (state.get if state.exists else (None, None, None))
        parts = ([_unpack(held)] if held is not None else []) + ([] if state.hasTimedOut else [b for b in batches if len(b)])
        mark, made = state.getCurrentWatermarkMs(), []
        rest, now = None, None
        if parts:
            every = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            at = _millis(every, ts)
            ready = at <= mark
            if ready.any():
                now = every[ready].sort_values([ts, *order], kind="mergesort").reset_index(drop=True)
                last = int(at[ready].max())
            if not ready.all():
                rest, first = every[~ready], int(at[~ready].min())
        memo = None if memo is None else json.loads(memo)
        if now is not None or (_due(memo) is not None and _due(memo) <= mark):
            made, memo = fold(key, every.iloc[:0] if now is None and parts else pd.DataFrame(columns=names_in) if now is None else now, memo, mark / 1000)
        if memo is not None and idle_s is not None and mark > last + idle_s * 1000:
            memo = None
        timers = [first] if rest is not None else []
        timers += [_due(memo)] if _due(memo) is not None else []
        timers += [int(last + idle_s * 1000)] if memo is not None and idle_s is not None else []
        if rest is None and memo is None:
            if state.exists:
                state.remove()
        else:
            state.update((None if rest is None else _pack(rest), None if memo is None else json.dumps(memo), last))
            if timers:
                state.setTimeoutTimestamp(max(min(timers), mark + 1))
        yield pd.DataFrame(made, columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(step, schema, "held binary, memo string, last long", "append", GroupStateTimeout.EventTimeTimeout)
