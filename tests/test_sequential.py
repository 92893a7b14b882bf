"""The sequential models against plain loops and, over files, against streaming."""

from __future__ import annotations

import random

import pytest

from rillframe.operators import routing as R
from rillframe.operators import sequential as S
from rillframe.sources import tables as V
from rillframe.streaming.stateful import replay_stream, report_stream


def rows(spark, seed=3, n=400):
    rng = random.Random(seed)
    out, t = [], {"a": 0, "b": 0}
    for i in range(n):
        k = rng.choice("ab")
        t[k] += rng.choice([-3_000_000, 0, 40_000, 40_000, 40_000, 20_000, 500_000, 500_001, 2_000_000])
        out.append((k, i, None if rng.random() < 0.05 else t[k], i * 40_000 + rng.randrange(300_000)))
    return out, spark.createDataFrame(out, "stream_id string, seq long, pts_us long, arrival_us long")


def of(data, key):
    return [(s, t, a) for k, s, t, a in data if k == key]


@pytest.mark.parametrize("model", [lambda: S.LimitFps(100_000), lambda: S.ForceFps(40_000), S.Realtime, S.SyncBuffer, S.GlobalShift, lambda: S.Sentinel(40_000)])
def test_batches_carry_the_model_on(spark, model):
    """A stream in many Arrow batches gives what its items give on end, whatever order they come in."""
    data, df = rows(spark)
    want = []
    for key in "ab":
        m = model()
        for item in of(data, key):
            want += [(key, *r) for r in m.push(*item)]
        want += [(key, *r) for r in m.end()] if hasattr(m, "end") else []
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        got = [tuple(r) for r in S.replay(df.orderBy("pts_us"), model).collect()]
    finally:
        spark.conf.set(name, was)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_limit_fps_rule():
    m = S.LimitFps(10)
    assert [bool(m.push(i, t)) for i, t in enumerate([None, 0, 5, 10, 9, None, 20])] == [True, True, False, True, True, False, True]


def test_force_fps_repeats_and_drops():
    m = S.ForceFps(10, 1000)
    assert m.push(0, 0) == [(0, 0, False)]
    assert m.push(1, 5) == []
    assert m.push(2, 25) == [(1, 10, True), (1, 20, True)]
    assert m.push(3, 10**6) == [(3, 10**6, False)]


def test_global_shift_starts_after_more_than_ten():
    m = S.GlobalShift()
    m.push(0, 100)
    got = [m.push(i, 50 + i)[0] for i in range(1, 14)]
    assert got[9][2] == 0 and got[10][2] > 0
    assert all(b[1] > a[1] for a, b in zip(got, got[1:]))


def test_global_shift_is_shared_by_streams(spark):
    # a is stuck from its second packet on: its eleventh move is 111 - 50 = 61, which v and a then take over; late only begins afterwards
    items = [("a", 0, 100, 100), ("v", 1, 100, 130)] + [("a", 1 + i, 50, 50) for i in range(1, 12)] + [("v", 13, 140, 150), ("a", 14, 145, 155), ("late", 15, 146, None)]
    want = [("a", 0, 100, 0, 100), ("v", 1, 100, 0, 130)] + [("a", 1 + i, 100 + i, 61 if i == 11 else 0, 100 + i) for i in range(1, 12)] + [("v", 13, 201, 61, 211), ("a", 14, 206, 61, 216), ("late", 15, 146, 61, None)]
    df = R.merge_key(spark.createDataFrame(items, "stream_id string, seq long, dts_us long, pts_us long"), ["a", "v", "late"]).selectExpr("*", "'m' as mux")
    got = S.replay(df.orderBy("pts_us"), S.GlobalShift, ts="dts_us", arrival="pts_us", key="mux", member="stream_id", order=("merge_ts", "src_index"))
    # v's first packet has the same time as a's, which come first
    assert sorted(tuple(r) for r in got.where("stream = 'a'").select("stream", "seq", "fixed_dts", "shift", "fixed_pts").collect()) == [w for w in want if w[0] == "a"]
    assert sorted((r["stream"], r["seq"]) for r in got.collect()) == sorted(w[:2] for w in want)
    m = S.GlobalShift()
    assert [(r[4], *r[:4]) for k, s, t, p in items for r in m.push(s, t, p, k)] == want


def test_sentinel_group_shares_its_shift():
    m = S.Sentinel(40_000)
    out = {"v": [], "a": []}
    for i in range(20):
        jump = 7_000_000 if i >= 10 else 0
        for k in "va":
            out[k] += m.push(2 * i + (k == "a"), i * 40_000 + jump, i * 40_000, k)
    for k in "va":  # no gap in either; what the first to jump was filled with is the other's jump too
        assert [b[1] - a[1] for a, b in zip(out[k], out[k][1:])] == [40_000] * (len(out[k]) - 1)
    assert [r[2] for r in out["v"]].count("freeze") == 5
    assert out["v"][-1][3] == out["a"][-1][3]
    assert list(S.Sentinel(40_000).push(0, None, 0)) == []


def test_stall_is_filled_up_to_the_clock():
    """25 frames a second stop for a minute: nothing for two seconds, then frames up to the clock, the first five seconds of them frozen."""
    m = S.Sentinel(40_000)
    out = [r for i in range(10) for r in m.push(i, i * 40_000, i * 40_000)]
    assert [r[1] for r in out] == [10_000_000 + i * 40_000 for i in range(10)] and {r[2] for r in out} == {"live"}
    more = list(m.push(10, 10 * 40_000, 9 * 40_000 + 60_000_000))
    cards = [r[2] for r in more]
    last = 10_000_000 + 9 * 40_000
    # the last wake-up before the frame comes, at 1 s and then every 22 ms, sees the clock this far on
    clock = last + 1_000_000 + (59_000_000 - 1) // 22_000 * 22_000
    assert [r[1] for r in more[:-1]] == list(range(last + 40_000, clock, 40_000))
    assert len(more) > 1400 and cards[-1] == "live" and more[-1][1] == more[-2][1] + 40_000
    assert cards.count("freeze") == 124 and cards[:124] == ["freeze"] * 124
    assert list(m.push(11, 11 * 40_000, 9 * 40_000 + 60_000_000 + 40_000)) == [(11, more[-1][1] + 40_000, "live", more[-1][3], "")]
    # a pause of less than two seconds shows nothing: the clock stands still
    n = S.Sentinel(40_000)
    assert len(list(n.push(0, 0, 0))) == len(list(n.push(1, 40_000, 1_900_000))) == 1


def test_a_long_stall_is_few_runs():
    """Ten days without a frame: the backup frames of test_stall_is_filled_up_to_the_clock, in few rows."""
    m = S.SentinelRuns(40_000)
    out = [r for i in range(10) for r in m.push(i, i * 40_000, i * 40_000)]
    assert [r[5] for r in out] == [1] * 10
    more = list(m.push(10, 400_000, 9 * 40_000 + 864_000_000_000))
    assert len(more) < 40 and more[-1][2] == "live"
    last = 10_000_000 + 9 * 40_000
    clock = last + 1_000_000 + (863_999_000_000 - 1) // 22_000 * 22_000
    assert sum(r[5] for r in more[:-1]) == len(range(last + 40_000, clock, 40_000)) and sum(r[5] for r in more if r[2] == "freeze") == 124
    at = last + 40_000
    for r in more:
        assert r[1] == at
        at += r[5] * 40_000


def test_runs_give_the_frames_one_by_one(spark, small):
    items = V.packets(spark, small)
    args = (3_600_000_000, 36_000_000_000, 14_400_000_000, 21_600_000_000, 10_000_000, 360_000_000, 28_800_000_000, 28_800_000_000)
    by_frame = S.replay(items, lambda: S.Sentinel(*args), key="user_id", member="stream_id")
    runs = S.replay(items, lambda: S.SentinelRuns(*args), key="user_id", member="stream_id")
    key = lambda r: str(tuple(r))
    want = sorted(by_frame.collect(), key=key)
    assert sorted(S.frames_of(runs, args[0]).select(*by_frame.columns).collect(), key=key) == want and runs.count() < len(want) / 2


def test_every_second_step_ahead_is_filled():
    m = S.Sentinel(10, 1, start_us=0)
    got = [list(m.push(i, t, t)) for i, t in enumerate([0, 10, 1000, 1010, 2000, 2010, 3000])]
    assert [len(g) for g in got] == [1, 1, 6, 1, 1, 1, 6]
    assert [g[-1][1] for g in got] == [0, 10, 70, 80, 90, 100, 160]


def test_realtime_margins_and_masters():
    m = S.Realtime(margin_us=10, initial_margin_us=100)
    assert m.push(0, 0, 0) == [(0, "resync", -100, "")]
    assert m.push(1, 0, 1_000_000) == [(1, "resync", -1_000_010, "")]
    assert m.push(2, 9_000_000, 1_000_000) == [(2, "discontinuity", 7_999_900, "")]
    t = S.Realtime(masters=("v",))
    assert t.push(0, 100, 0, "v")[0][2] == 100 and t.push(1, 100, 20, "a")[0][1:3] == ("emit", 100)
    # a member that is not a master follows the least offset, a master sets it anew
    assert t.push(2, 5_000_000, 20, "a")[0][1:3] == ("discontinuity", 100)
    assert t.push(3, 5_000_000, 20, "v")[0][1:3] == ("discontinuity", 4_999_980)


def test_sync_buffer_fills_then_follows_the_offset():
    m = S.SyncBuffer()
    assert m.push(0, 0, 0) == [] and m.push(1, 100_000, 90_000) == []
    # at 200 ms the buffer opens: the first item sets the offset, the others are due later
    assert m.push(2, 200_000, 210_000) == [(0, "resync", 210_000, "")]
    assert m.push(3, 300_000, 400_000) == [(1, "wait", 310_000, "")]
    assert m.push(4, 400_000, 2_000_000) == [(2, "wait", 410_000, ""), (3, "wait", 510_000, "")]
    assert m.end() == [(4, "flush", None, "")] and m.push(5, None, 0) == []


def test_drift_is_made_up_for():
    m = S.AudioDrift(1000, frame=10, most_us=1000, patience=40, window=50, gap_us=10**9)
    # frames of 10 samples at 1 kHz that come 25 ms late from the first one on
    got = [m.push(i, i * 10_000 + (25_000 if i else 0), 10)[0] for i in range(60)]
    first = next(i for i, r in enumerate(got) if r[3])
    # the average passes the limit with the third late frame; forty more are waited for
    assert first == 3 + 40
    assert [r[3] for r in got[first : first + 4]] == [10, 10, 5, 0] and all(r[3] == 0 for r in got[first + 3 :])
    assert got[first + 3][2] == 0 and got[first + 3][1] == (first + 3) * 10_000 + 25_000
    early = S.AudioDrift(1000, frame=10, most_us=1000, window=50, gap_us=10**9)
    out = [early.push(i, i * 10_000 - (7_000 if i > 1 else 0), 10)[0][3] for i in range(70)]
    assert sum(out) == -7 and [x for x in out if x] == [-7]
    assert S.AudioDrift(1000).push(0, None) == [] and early.push(70, 0, 10)[0][2] == 0


def test_triggers_pair_once():
    m = S.SyncPairs("v", 500)
    got = [m.push(i, t, 0, k) for i, (k, t) in enumerate([("v", 0), ("v", 100), ("a", 150), ("a", 160), ("v", 900), ("a", 1000), ("a", 1001)])]
    assert [r for g in got for r in g] == [(1, 2, 50), (4, 5, 100)]


def test_one_item_and_empty_streams(spark):
    empty = spark.createDataFrame([], "stream_id string, seq long, pts_us long, arrival_us long")
    assert S.replay(empty, S.Realtime).count() == 0
    one = spark.createDataFrame([("a", 1, None, 5)], empty.schema)
    assert [tuple(r) for r in S.replay(one, S.Realtime).collect()][0][:3] == ("a", 1, "emit")


def test_stream_equals_batch(spark, small, tmp_path):
    items = V.packets(spark, small).select("stream_id", "seq", "pts_us", "arrival_us")
    for part in range(2):
        items.where(f"seq % 1000 div 500 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    step = 40 * 3_600_000_000
    live = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = replay_stream(live, lambda: S.LimitFps(step)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in S.replay(items, lambda: S.LimitFps(step)).collect()}


def test_report_stream_is_a_windowed_sum(spark, small, tmp_path):
    items = V.packets(spark, small).selectExpr("stream_id", "seq", "size", "timestamp_micros(arrival_us) as at")
    items.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    q = report_stream(live, "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("report").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(packets) from report").first()[0] == items.count()
