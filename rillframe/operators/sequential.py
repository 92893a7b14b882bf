"""Operators whose every decision depends on the one before: small models, one per stream, that batch and streaming share.

A model takes one item at a time (`push`) and returns rows. In batch, Spark deals streams to tasks and sorts each by seq; a task holds one model and one
batch of rows at a time, however long a stream is.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Row = tuple


class LimitFps:
    """Keeps a frame if it is a step after the last kept one, or before it; without a time only until one with a time was kept."""

    fields = "seq long, pts_us long"

    def __init__(self, step_us: int):
        self.step, self.last = step_us, None

    def push(self, seq: int, ts: int | None, arrival: int | None = None) -> list[Row]:
        if self.last is None or ts is not None and (ts < self.last or ts - self.last >= self.step):
            self.last = ts if ts is not None else self.last
            return [(seq, ts)]
        return []


class ForceFps:
    """A fixed rate by repeating and dropping frames; starts anew where time steps back, or ahead by more than the limit since the last accepted frame."""

    fields = "seq long, pts_us long, duplicated boolean"

    def __init__(self, step_us: int, limit_us: int = 500_000):
        self.step, self.limit = step_us, limit_us
        self.last = self.next = self.held = None

    def push(self, seq: int, ts: int | None, arrival: int | None = None) -> list[Row]:
        if ts is None:
            return []
        out: list[Row] = []
        if self.last is not None:
            gap = ts - self.last
            if gap != self.step and 0 <= gap <= self.limit:
                while ts > self.next:
                    out.append((self.held, self.next, True))
                    self.next += self.step
                if ts < self.next:
                    self.held = seq
                    return out
        self.last, self.next, self.held = ts, ts + self.step, seq
        return [*out, (seq, ts, False)]


class Realtime:
    """What replay against the wall clock does with each item: wait, emit, drop, or resynchronise.

    An offset ties times to the clock. It is set with the initial margin at the start and after a discontinuity, else with the usual one. The members of a
    team share the least offset; a discontinuity of a master resets it. `speed` scales times.
    """

    fields = "seq long, action string, offset_us long, stream string"

    def __init__(self, tolerance_us: int = 250_000, discard_us: int | None = None, discontinuity_us: int = 1_000_000, margin_us: int = 0, initial_margin_us: int | None = None, masters: tuple[str, ...] = (), speed: float = 1.0):
        self.tolerance, self.limit, self.margin = tolerance_us, discontinuity_us, margin_us
        self.initial = margin_us if initial_margin_us is None else initial_margin_us
        self.discard = tolerance_us if discard_us is None else discard_us
        self.masters, self.speed = masters, speed
        self.offset: int | None = None
        self.fresh: dict[str, bool] = {}

    def push(self, seq: int, ts: int | None, arrival: int | None = None, stream: str = "") -> list[Row]:
        if ts is None:
            return [(seq, "emit", self.offset, stream)]
        ts = round(ts / self.speed) if self.speed != 1 else ts
        ahead = None if self.offset is None else ts - self.offset - arrival
        if ahead is None or ahead < -self.tolerance:
            action = "resync"
        elif ahead < -self.discard:
            return [(seq, "drop", self.offset, stream)]
        elif ahead < self.limit:
            return [(seq, "wait" if ahead > 0 else "emit", self.offset, stream)]
        else:
            action = "discontinuity"
            self.fresh[stream] = True
            if stream in self.masters:
                self.offset = None
        own = ts - arrival - (self.initial if self.fresh.get(stream, True) else self.margin)
        self.fresh[stream] = False
        self.offset = own if self.offset is None or not self.masters else min(self.offset, own)
        return [(seq, action, self.offset, stream)]


class SyncBuffer:
    """Holds each stream's items until they span the fill time, then lets each go when the shared offset says so; 250 ms late or a second early sets the offset anew.

    Rows say when an item leaves: at a time of the clock, or with the flush at the end ("flush", no time). Items without a time go. Arrivals of a group share
    one clock and never step back.
    """

    fields = "seq long, action string, out_us long, stream string"

    def __init__(self, fill_us: int = 200_000, late_us: int = 250_000, early_us: int = 1_000_000):
        self.fill, self.late, self.early = fill_us, late_us, early_us
        self.offset: int | None = None
        self.held: dict[str, deque] = {}
        self.open: dict[str, bool] = {}

    def _leave(self, stream: str, now: int) -> list[Row]:
        """What leaves a stream's buffer up to now, at the times it is due."""
        out: list[Row] = []
        held = self.held[stream]
        while held and self.open[stream]:
            seq, ts, since = held[0]
            due = None if self.offset is None else ts - self.offset
            at = since if not out else max(since, out[-1][2])
            if due is None or due - at < -self.late or due - at >= self.early:
                self.offset, action = ts - at, "resync"
            elif due <= at:
                action = "emit"
            elif due <= now:
                action, at = "wait", due
            else:
                break
            out.append((seq, action, at, stream))
            held.popleft()
        if not held:
            self.open[stream] = False
        return out

    def push(self, seq: int, ts: int | None, arrival: int | None = None, stream: str = "") -> list[Row]:
        if ts is None:
            return []
        held = self.held.setdefault(stream, deque())
        out = self._leave(stream, arrival) if self.open.setdefault(stream, False) else []
        held.append((seq, ts, arrival))
        if not self.open[stream] and ts - held[0][1] >= self.fill and len(held) > 1:
            self.open[stream] = True
            for i, (n, t, _) in enumerate(held):
                held[i] = (n, t, arrival)
        return out + (self._leave(stream, arrival) if self.open[stream] else [])

    def end(self) -> list[Row]:
        return [(n, "flush", None, stream) for stream, held in sorted(self.held.items()) for n, _, _ in held]


class GlobalShift:
    """Rising decoding times of a mux: when a stream's packets had to move more than ten times in a row, the largest current move of any stream is added to
    a shift that all streams share, and all counters begin anew. A stream's first packet isn't shifted. Times are in one unit; presentation times (given as arrival) move along.
    """

    fields = "seq long, fixed_dts long, shift long, fixed_pts long, stream string"

    def __init__(self, most: int = 10):
        self.most, self.shift = most, 0
        self.streams: dict[str, list] = {}

    def push(self, seq: int, ts: int | None, arrival: int | None = None, stream: str = "") -> list[Row]:
        if ts is None:
            return []
        own = self.streams.setdefault(stream, [None, 0, 0])  # last time, current move, moves in a row
        out, pts = ts, arrival
        if own[0] is not None:
            out, pts = ts + self.shift, None if arrival is None else arrival + self.shift
            own[1:] = [own[0] + 1 - out, own[2] + 1] if out <= own[0] else [0, 0]
            out = max(out, own[0] + 1)
        own[0] = out
        if own[2] > self.most:
            self.shift += max(s[1] for s in self.streams.values())
            for s in self.streams.values():
                s[1:] = [0, 0]
        return [(seq, out, self.shift, None if pts is None else max(pts, out), stream)]


class SentinelRuns:
    """Continuous output times of streams that share a clock and a shift; what is missing is filled with backup frames.

    The clock shows the latest live output; after `idle` without one it runs with the wall clock. A stream that meets a jump takes over the shared shift if that
    heals it. A step back joins on. A step ahead is filled with at most five backup frames if this stream or another one of the group jumped within `recent`, but not
    straight after a fill; else it joins on too. While nothing arrives for longer than the timeout, wake-ups fill a stream up to the clock, at most five frames
    each. A backup frame repeats the last live one until `freeze` has passed since that, then the slate is shown.

    Rows are runs of `frames` frames, each a duration after the one before: live ones (of one frame) with their seq, backup ones with the seq of the frame before. A long
    pause is few runs; `frames_of` gives their frames.
    """

    fields = "seq long, out_us long, card string, shift_us long, stream string, frames long"
    most = 5

    def __init__(self, duration_us: int, tolerance_us: int = 1000, timeout_us: int = 1_000_000, freeze_us: int = 5_000_000, start_us: int = 10_000_000, wake_us: int = 22_000, idle_us: int = 2_000_000, recent_us: int = 2_000_000, lock: bool = False):
        self.d, self.tolerance, self.timeout, self.freeze = duration_us, tolerance_us, timeout_us, freeze_us
        self.wake, self.idle, self.recent, self.lock = wake_us, idle_us, recent_us, lock
        self.start, self.clock, self.set_at = start_us, start_us, None
        self.shift: int | None = None
        self.jumped: int | None = None
        self.streams: dict[str, _Guarded] = {}

    def _now(self, wall: int) -> int:
        if self.set_at is None:
            self.set_at = wall
        return self.clock if wall - self.set_at < self.idle else self.clock + wall - self.set_at

    def _live(self, out: int, wall: int) -> None:
        if self.set_at is None or out > self.clock:
            self.clock, self.set_at = out, wall

    def _backup(self, name: str, own: _Guarded, until: int, most: int | None) -> Iterator[Row]:
        """Frames that begin before `until`, at most so many: first those that freeze, then the slate."""
        n = max(0, -((own.next - until) // self.d))
        n = n if most is None else min(n, most)
        frozen = 0 if own.real is None else min(n, max(0, -((own.next - own.real - self.freeze) // self.d)))
        for card, k in (("freeze", frozen), ("slate", n - frozen)):
            if k:
                yield own.seq, own.next, card, own.shift, name, k
                own.next += k * self.d

    def _stalled(self, name: str, own: _Guarded, until: int) -> Iterator[Row]:
        """Backup frames of wake-ups before `until`; wake-ups at which nothing is due are skipped at once, those that each catch up with the running clock taken together."""
        at, first = own.woken, own.live
        while at < until:
            now = self._now(at)
            if now > own.next and (not first or now - own.next > self.timeout):
                if at - self.set_at >= self.idle and now - own.next <= self.most * self.d and self.wake <= self.most * self.d:
                    last = at + (until - 1 - at) // self.wake * self.wake
                    yield from self._backup(name, own, self._now(last), None)
                    # the wake-up that gave the last frame
                    due = self.set_at + own.next - self.d - self.clock + 1
                    at += max(0, -((at - due) // self.wake)) * self.wake
                else:
                    yield from self._backup(name, own, now, self.most)
                at += self.wake
            else:
                runs_from = self.set_at + self.idle
                due = max(runs_from, self.set_at + own.next - self.clock + 1)
                at += self.wake * max(1, -(-(due - at) // self.wake))
            first = own.live = False
        own.woken = at

    def push(self, seq: int, ts: int | None, arrival: int | None = None, stream: str = "") -> Iterator[Row]:
        for name, other in self.streams.items():
            if other.woken < arrival:
                yield from self._stalled(name, other, arrival)
        if ts is None:
            return
        own = self.streams.get(stream)
        if self.shift is None:
            self.shift = self._now(arrival) - ts
        if own is None:
            own = self.streams[stream] = _Guarded(self.start, self.shift)
        apart = abs(own.shift - self.shift) > self.tolerance
        before = abs(ts + own.shift - own.next) >= self.tolerance
        if before:
            self.jumped = self._now(arrival)
        if apart:
            own.shift = self.shift
        when = ts + own.shift
        if abs(when - own.next) >= self.tolerance:
            if not before:
                self.jumped = self._now(arrival)
            if when > own.next and not own.filled and (before or self.jumped is not None and self._now(arrival) - self.jumped < self.recent):
                yield from self._backup(stream, own, when, self.most)
                own.filled = True
            elif when > own.next:
                own.filled = False
            own.shift, when = own.next - ts, own.next
            if not self.lock:
                self.shift = own.shift
        elif apart and not self.lock:
            self.shift = own.shift
        self._live(when, arrival)
        own.seq, own.real, own.next, own.live, own.woken = seq, when, when + self.d, True, arrival + self.timeout
        yield seq, when, "live", own.shift, stream, 1


class Sentinel(SentinelRuns):
    """The same frame by frame."""

    fields = "seq long, out_us long, card string, shift_us long, stream string"

    def push(self, seq: int, ts: int | None, arrival: int | None = None, stream: str = "") -> Iterator[Row]:
        for n, out, card, shift, name, frames in super().push(seq, ts, arrival, stream):
            for k in range(frames):
                yield n, out + k * self.d, card, shift, name


def frames_of(runs: DataFrame, duration_us: int) -> DataFrame:
    """The frames of a sentinel's runs."""
    return runs.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1))).withColumn("out_us", F.col("out_us") + F.col("_k") * duration_us).drop("_k", "frames")


class AudioDrift:
    """Output times of resampled sound, which follow from the number of samples, and what keeps them near the input's: silence put in or samples left out.

    Drift is the input's time less the output's. It is acted on once it has kept its sign, and its average over the last frames too, beyond the limit for `patience`
    frames; at most one output frame of samples a time, and then on until it is small. Time that steps back, or ahead by more than a second, begins anew.
    Items give their number of samples as `arrival`.
    """

    fields = "seq long, out_us long, drift_us long, added long"

    def __init__(self, rate: int, frame: int = 1024, most_us: int = 1000, patience: int = 40, window: int = 50, gap_us: int = 1_000_000):
        self.rate, self.frame, self.most, self.patience, self.gap = rate, frame, most_us, patience, gap_us
        self.recent: deque = deque([0] * window, maxlen=window)
        self.base: int | None = None
        self.samples = self.run = 0
        self.last = 0
        self.behind = self.busy = False

    def push(self, seq: int, ts: int | None, arrival: int | None = None, stream: str = "") -> list[Row]:
        if ts is None:
            return []
        if self.base is None or not 0 <= ts - self.last <= self.gap:
            self.base, self.samples, self.run, self.busy = ts, 0, 0, False
            self.recent.extend([0] * len(self.recent))
        self.last = ts
        drift = ts - self.base - self.samples * 1_000_000 // self.rate
        self.recent.append(drift)
        mean = sum(self.recent) / len(self.recent)
        act = drift * mean > 0 and abs(mean) > self.most < abs(drift) and (drift < 0) == self.behind
        act = abs(drift) >= self.most and act or self.busy and 10 * abs(drift) > 7 * self.most
        self.behind = drift < 0
        if not act:
            self.run = 0
        elif not self.busy and self.run < self.patience:
            self.run, act = self.run + 1, False
        added = 0
        if act:
            due = abs(drift) * self.rate // 1_000_000
            self.busy = self.busy or due > self.frame
            added = min(due, self.frame) * (1 if drift > 0 else -1)
        else:
            self.busy = False
        out = self.base + (self.samples + max(added, 0)) * 1_000_000 // self.rate
        self.samples += added + (arrival or 0)
        return [(seq, out, drift, added)]


class SyncPairs:
    """Distance of audio from video: the latest trigger of either is kept until both are there and close enough, then both are forgotten."""

    fields = "video_seq long, audio_seq long, offset_us long"

    def __init__(self, video: str, within_us: int = 500_000):
        self.video, self.within = video, within_us
        self.seen: dict[bool, tuple[int, int]] = {}

    def push(self, seq: int, ts: int | None, arrival: int | None = None, stream: str = "") -> list[Row]:
        if ts is None:
            return []
        self.seen[stream == self.video] = (seq, ts)
        if len(self.seen) < 2 or abs(self.seen[False][1] - self.seen[True][1]) > self.within:
            return []
        (v, at), (a, sound) = self.seen[True], self.seen[False]
        self.seen = {}
        return [(v, a, sound - at)]


@dataclass
class _Guarded:
    """A stream under a sentinel: its next time, its shift, the last live frame and its time, the next wake-up, and whether the last jump ahead was filled."""

    next: int
    shift: int
    seq: int | None = None
    real: int | None = None
    woken: int = 0
    live: bool = True
    filled: bool = False


#: Rows that a task puts out at a time: an item may give many.
ROWS_OUT = 20_000
ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}


def replay(items: DataFrame, model: Callable[[], Any], ts: str = "pts_us", arrival: str = "arrival_us", key: str = "stream_id", member: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, the model's fields) from each stream's items in order of seq.

    With `member`, streams that share a key form one group, and the model is told each item's stream. With `order`, items come in order of these columns, then of
    seq. A model with an `end` adds its rows when its stream is over.
    """
    kind = items.schema[key].dataType.simpleString()
    fields = model().fields
    names, types = zip(*[f.strip().split(" ") for f in fields.split(",")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = of = None
        kind_of_key: pa.DataType | None = None

        def made(keys: list, rows: list[Row]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(keys, kind_of_key), *[pa.array(c, ARROW[t]) for c, t in zip(cols, types, strict=True)]], names=[key, *names])

        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[Any, Row]]:
            nonlocal m, of
            for k, seq, t, a, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if m is None or k != of:
                    if hasattr(m, "end"):
                        yield from ((of, r) for r in m.end())
                    m, of = model(), k
                yield from ((of, r) for r in m.push(seq, t, a, *more))

        for batch in batches:
            kind_of_key = batch.schema.field(0).type
            keyed = rows_of(batch)
            while some := list(islice(keyed, ROWS_OUT)):
                yield made([k for k, _ in some], [r for _, r in some])
        if hasattr(m, "end") and (rows := m.end()):
            yield made([of] * len(rows), rows)

    quoted = [f"`{key}` as `_key`", "seq", f"{ts} as ts", f"{arrival} as arrival", *([f"cast({member} as string) as member"] if member else [])]
    given = items.selectExpr(*quoted, *[f"`{o}` as `_order{i}`" for i, o in enumerate(order)])
    sorted_ = given.repartition("_key").sortWithinPartitions("_key", *[f"_order{i}" for i in range(len(order))], "seq")
    return sorted_.select("_key", "seq", "ts", "arrival", *(["member"] if member else [])).mapInArrow(run, f"`{key}` {kind}, {fields}")
