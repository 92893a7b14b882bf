from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rillframe.operators import statistics as ST
from rillframe.plans.catalog import oracle_sql, queries


@pytest.mark.parametrize("name", ["stats_speed", "stats_bitrate", "stats_fps", "stats_duration", "stats_sound_duration", "remux_with_statistics"])
def test_histories_have_no_sliding_frame(spark, small, name):
    """Spark sums up a sliding frame anew for each row: work that grows with what a history holds."""
    plan = queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$()" in plan and "specifiedwindowframe(RangeFrame, -" not in plan


def _streams():
    """Times that stay, step back and leap; sizes that are missing; arrivals out of order."""
    rng = random.Random(8)
    rows = []
    for stream in ("a", "b", None):
        at = 0
        for seq in range(150):
            at += rng.choice([0, 0, 3, 7, 20, -15 if seq % 40 == 39 else 1, 200 if seq % 50 == 49 else 2])
            rows.append((stream, seq, at, at + rng.randrange(30), None if rng.random() < 0.1 else rng.randrange(1000)))
    return rows


def _sessions(rows, limit):
    out, last, session = {}, {}, {}
    for stream, seq, at, arrival, size in rows:
        step = at - last.get(stream, at)
        session[stream] = session.get(stream, 0) + (step < 0 or step > limit)
        last[stream] = at
        out.setdefault((stream, session[stream]), []).append((seq, at, arrival, size))
    return out


def test_history_and_speed_against_brute_force(spark):
    rows, age, limit = _streams(), 40, 100
    df = spark.createDataFrame(rows, "stream_id string, seq long, dts_us long, arrival_us long, size long")
    want, wanted_speed, number = {}, {}, {}
    for (stream, _), items in _sessions(rows, limit).items():
        for seq, at, arrival, _ in items:
            number[stream] = number.get(stream, 0) + 1
            held = [i for i in items if at - age <= i[1] <= at]
            first, span = min(held), at - min(i[1] for i in held)
            total = None if first[3] is None or not span else (sum(i[3] or 0 for i in held) - first[3]) * 8e6 / (span * 1024)
            want[stream, seq] = (number[stream], total, (len(held) - 1) * 1e6 / span if span else 0.0, span)
            held = sorted((i[2], i[0], i[1]) for i in items if arrival - age <= i[2] <= arrival)
            wall = arrival - held[0][0]
            wanted_speed[stream, seq] = (held[-1][2] - held[0][2]) / wall if wall else None
    got = {(r["stream_id"], r["seq"]): (r["frame_num"], r["kbitrate"], r["fps"], r["duration_us"]) for r in ST.history(df, age, limit).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    got = {(r["stream_id"], r["seq"]): r["speed"] for r in ST.speed(df, age, limit).collect()}
    assert got.keys() == wanted_speed.keys() and all(got[k] == pytest.approx(wanted_speed[k]) for k in got)
    sound = df.where("stream_id = 'a'").select("stream_id", "seq", (F.col("seq") % 7).alias("duration_us"))
    ends, end = {}, 0
    for seq in range(150):
        end += seq % 7
        ends[seq] = end
    want = {n: e - min([e - 20] * any(b - n2 % 7 == e - 20 for n2, b in ends.items() if n2 % 7 and e - 20 <= b <= e) or [b - n2 % 7 if b - n2 % 7 >= e - 20 else b for n2, b in ends.items() if n2 % 7 and e - 20 <= b <= e]) for n, e in ends.items() if n % 7}
    assert {r["seq"]: r["sound_us"] for r in ST.sound_duration(sound, 20).collect()} == want


def test_remux_statistics_match_sql_where_times_are_equal_or_step_back(spark, small, tmp_path):
    """The mux repairs such times; statistics are subscribed before it."""
    con = duckdb.connect()
    con.execute(f"copy (select event_id * 2 + k as event_id, ts - interval 3 hour * (event_id % 50 = 7)::int as ts, * exclude (event_id, ts) from '{small}/events.parquet', range(2) r(k)) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = sorted(con.execute(f"select stream_id, seq, frame_num, kbitrate from ({oracle_sql()['remux_with_statistics']})").fetchall())
    got = sorted(tuple(r) for r in queries()["remux_with_statistics"](spark, str(tmp_path)).select("stream_id", "seq", "frame_num", "kbitrate").collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == pytest.approx(w[3], abs=1e-8) for g, w in zip(got, want, strict=True))
