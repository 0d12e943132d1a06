"""Stateful steps of metric and alert streams: windows that close, empty ones too, and conditions that hold.

Both processors see a few rows per series and step, since log rows are aggregated to buckets of one
step before.  State per series is bounded by the widest window, or by the ticks the watermark still waits for.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
STRETCH = 10_000  # steps that are laid out at a time, however far the watermark jumps


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _timestamps(micros) -> pd.Series:
    return pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us")


class _ByEventTime(StatefulProcessor):
    """A processor that releases what the watermark has passed, on input and on timers."""

    def handleInputRows(self, key, rows, timerValues):
        yield from self._released(key, [frame for frame in rows if len(frame)], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._released(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _wake(self, micros: int | None):
        """One timer per group, at the next time something can be released."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if micros is not None:
            self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


class SlidingSums(_ByEventTime):
    """Sums of buckets over windows of several widths, at every step from a series' first bucket on.

    A step without a bucket gives its windows as well, as soon as the watermark passes it: a timer waits for each step.
    """

    def __init__(self, sums: list[str], widths: list[int], step: int, columns: list[str], keys: list[str]):
        self.sums, self.widths, self.step, self.columns, self.keys = sums, widths, step, columns, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", "next bigint, starts array<bigint>, sums array<array<double>>")

    def _released(self, key, frames, watermark):
        none = np.empty((0, len(self.sums)))
        following, starts, sums = None, np.empty(0, np.int64), none
        if self.state.exists():
            following, kept, values = self.state.get()
            starts, sums = np.array(kept, np.int64), np.array(values, float).reshape(-1, len(self.sums))
        for frame in frames:
            starts = np.concatenate([starts, _micros(frame["window_start"])])
            sums = np.concatenate([sums, frame[self.sums].astype("float64").fillna(0.0).to_numpy()])
        if len(starts) and following is None:
            following = int(starts.min())
        if following is None:
            return
        reach = max(self.widths) // self.step
        while following + self.step <= watermark:
            # a stretch of steps at a time, with the steps before it that its windows reach back to
            steps = min((watermark - following) // self.step, STRETCH)
            dense = np.zeros((steps + reach - 1, len(self.sums)))
            place = (starts - following) // self.step + reach - 1
            inside = (place >= 0) & (place < len(dense))
            np.add.at(dense, place[inside], sums[inside])
            times = following + self.step * np.arange(steps)
            for width in self.widths:
                n = width // self.step
                windows = np.lib.stride_tricks.sliding_window_view(dense[reach - n :], n, axis=0).sum(-1)
                found = pd.DataFrame(windows, columns=self.sums)
                for name, value in zip(self.keys, key):
                    found[name] = value
                found["width"] = width // MICROS
                found["window_start"] = _timestamps(times)
                found["closes"] = _timestamps(times + self.step - 1)
                yield found[self.columns]
            following += int(steps) * self.step
            needed = starts > following - max(self.widths)
            starts, sums = starts[needed], sums[needed]
        self.state.update((following, starts.tolist(), sums.tolist()))
        self._wake(following + self.step)


def sliding_stream(buckets: DataFrame, sums: list[str], widths: list[int], step: int, *keys: str) -> DataFrame:
    """Windows of ``widths`` seconds that end with every ``step`` of every series of a stream.

    ``buckets`` has one row per step and series (``window_start`` and the event time ``closes``, see
    ``closing``), as a windowed aggregation emits them.  A window's ``window_start`` is that of its last
    step, ``width`` tells which window it is, and sums are doubles.  Series without rows go on with zeros.
    """
    columns = [*keys, "width", "window_start", "closes", *sums]
    kinds = [f"{k} string" for k in keys] + ["width bigint", "window_start timestamp", "closes timestamp"] + [f"{s} double" for s in sums]
    processor = SlidingSums(sums, [w * MICROS for w in widths], step * MICROS, columns, list(keys))
    return buckets.groupBy(*keys).transformWithStateInPandas(processor, ", ".join(kinds), "Append", "EventTime", eventTimeColumnName="closes")


class Holds(_ByEventTime):
    """State machine of one rule and series: inactive, pending, firing.

    Ticks wait until the watermark passes them, so rows that come out of order are read in order.
    A missing tick is a quiet one.  Only runs of equal conditions are looped over.
    """

    def __init__(self, holds: dict[str, int], step: int):
        self.holds, self.step = holds, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "hold", "last bigint, since bigint, state string, waiting array<bigint>, breaches array<boolean>, closes array<bigint>"
        )

    def _released(self, key, frames, watermark):
        last, since, current = None, None, "inactive"
        parts = []
        if self.state.exists():
            last, since, current, *kept = self.state.get()
            parts.append(pd.DataFrame(dict(zip(("ts", "breach", "closes"), kept))))
        for frame in frames:
            parts.append(pd.DataFrame({"ts": _micros(frame["ts"]), "breach": frame["breach"].to_numpy(bool), "closes": _micros(frame["closes"])}))
        if not parts:
            return
        rows = pd.concat(parts).astype({"ts": "int64", "breach": bool, "closes": "int64"})
        rows = rows.groupby("ts", as_index=False).agg({"breach": "any", "closes": "max"})  # sorted by time
        passed = rows["closes"] <= watermark
        ready, waiting = rows[passed], rows[~passed]
        changes, hold = [], self.holds[key[0]] * MICROS
        ts, breach = ready["ts"].to_numpy(), ready["breach"].to_numpy()
        gap = np.diff(ts, prepend=ts[:1] if last is None else last) > self.step
        first = np.flatnonzero(np.append(True, breach[1:] != breach[:-1]) | gap) if len(ts) else []
        for start, end in zip(first, np.append(first[1:], len(ts))):
            if gap[start] and current != "inactive":
                changes.append((int(ts[start - 1] if start else last) + self.step, "inactive", None, int(ts[start])))
            if gap[start]:
                since, current = None, "inactive"
            if not breach[start]:
                if current != "inactive":
                    changes.append((int(ts[start]), "inactive", None, int(ts[start])))
                since, current = None, "inactive"
                continue
            since = int(ts[start]) if since is None else since
            fires = start + int(np.searchsorted(ts[start:end], since + hold))
            if current == "inactive" and fires > start:
                changes.append((int(ts[start]), "pending", since, int(ts[start])))
                current = "pending"
            if current != "firing" and fires < end:
                changes.append((int(ts[fires]), "firing", since, int(ts[fires])))
                current = "firing"
        last = int(ts[-1]) if len(ts) else last
        self.state.update((last, since, current, waiting["ts"].tolist(), waiting["breach"].tolist(), waiting["closes"].tolist()))
        self._wake(int(waiting["closes"].min()) if len(waiting) else None)
        found = pd.DataFrame(changes, columns=["ts", "state", "since", "at"])
        found.insert(0, "series", key[1])
        found.insert(0, "rule", key[0])
        found["ts"] = _timestamps(found["ts"])
        found["since"] = pd.to_datetime(found["since"].astype("Int64"), unit="us")
        # a change is told when its tick closes
        found["closes"] = _timestamps(found.pop("at").astype("int64") + self.step - 1)
        yield found


def alerts_stream(ticks: DataFrame, holds: dict[str, int], step: int) -> DataFrame:
    """State changes of alerts from a stream of evaluated rules.

    ``ticks`` has ``rule, series, ts, breach`` and the event time ``closes`` with a watermark; ``holds`` gives each
    rule's hold time and ``step`` the distance of ticks, in seconds.
    """
    out = "rule string, series string, ts timestamp, state string, since timestamp, closes timestamp"
    return (
        ticks.groupBy("rule", "series")
        .transformWithStateInPandas(Holds(holds, step * MICROS), out, "Append", "EventTime", eventTimeColumnName="closes")
        .drop("closes")
    )


def closing(windows: DataFrame) -> DataFrame:
    """Add the event time ``closes``, the last moment of a window column ``w``, and ``window_start``."""
    return windows.select("*", F.window_time("w").alias("closes"), F.col("w.start").alias("window_start")).drop("w")
