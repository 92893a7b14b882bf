from __future__ import annotations

import pytest

from rillframe.operators import frames, routing, statistics
from rillframe.plans import nodes  # noqa: F401
from rillframe.plans.catalog import REMUX
from rillframe.plans.graph import REGISTRY, Graph, script
from rillframe.sources import tables as V


def test_remux_binds(spark, small):
    graph = script(REMUX)
    edges = graph.bind({"events": V.packets(spark, small)})
    assert set(edges) == {"all", "video", "audio", "video2", "muxed", "written"}
    assert [r[0] for r in edges["video"].select("stream_id").distinct().collect()] == ["click"]
    rates = graph.statistics(edges)["rates"]
    assert {(r["media"], r["edge"]) for r in rates.select("media", "edge").distinct().collect()} == {("video", "video"), ("audio", "audio")}


def test_cycle_and_double_ends():
    g = Graph()
    g.command('node.add {"name":"a","type":"split","src":"y","dst":"x"}')
    g.command('node.add {"name":"b","type":"split","src":"x","dst":"y"}')
    with pytest.raises(ValueError, match="cycle"):
        g.order()
    with pytest.raises(ValueError, match="two ends"):
        g.command('node.add {"name":"c","type":"split","src":"x","dst":"z"}')
    with pytest.raises(ValueError, match="unknown"):
        g.command("no.such.command")


def test_commands():
    g = script('# comment\nqueue.plan_capacity q 5\nnode.add {"name":"n","type":"firewall<av::Packet>","src":"a","dst":"b"}\nnode.param.set n x 1\nretry group.start default\n')
    assert g.nodes["n"].params["x"] == 1 and g.command("node.param.get n x") == "1"
    with pytest.raises(ValueError, match="line 2"):
        script("# one\nnode.delete nobody\n")


TRANSCODE = """
# a source in two streams, paced, decoded, guarded, encoded and written; a slate from another source
node.add {"type": "input", "url": "slate", "name": "slate_in", "dst": "s0"}
node.add {"type": "demux", "routing": {"v:0": "s1"}, "src": "s0"}
node.add {"type": "dec_video", "src": "s1", "dst": "s2", "columns": {"width": "1280", "height": "720"}}
node.add {"type": "rescale_video", "src": "s2", "dst": "s3", "columns": {"width": "1920", "height": "1080"}}
node.add {"type": "picture_buffer_sink", "name": "slate", "buffer": "slate", "src": "s3"}
event.on.node.finished ready slate
node.add {"type": "input", "url": "live", "name": "in", "dst": "m0"}
node.add {"type": "demux", "wait_for_keyframe": true, "routing": {"v:0": "v0", "?a:0": "a0", "?d:0": "d0"}, "src": "m0"}
node.add {"type": "split", "src": "d0", "dst": ["d1"]}
node.add {"type": "realtime", "leak_after": 25.0, "speed": 1.02, "src": "v0", "dst": "v1"}
node.add {"type": "realtime", "speed": 1.02, "src": "a0", "dst": "a1"}
node.add {"optional": true, "type": "dec_audio", "src": "a1", "dst": "a2", "columns": {"n_samples": "1024"}}
node.add {"type": "split", "src": "v1", "dst": ["v2"]}
node.add {"type": "dec_video", "src": "v2", "dst": "v3", "columns": {"width": "1920"}}
node.add {"type": "filter_video", "shift": true, "src": "v3", "dst": "v4", "columns": {"pts_us": "pts_us + 7"}}
node.add {"type": "assume_audio_format", "src": "a2", "dst": "a3"}
node.add {"type": "sentinel_audio", "timeout": 100000.0, "frame_sec": 36000, "src": "a3", "dst": "a4"}
node.add {"type": "split", "src": "a4", "dst": ["a5", "a6"]}
node.add {"type": "enc_audio", "codec": "aac", "src": "a6", "dst": "a7", "timestamps_passthrough": true}
node.add {"type": "force_fps", "fps": "1/36000", "src": "v4", "dst": "v5"}
node.add {"type": "assume_video_format", "src": "v5", "dst": "v6"}
node.add {"type": "sentinel_video", "timeout": 100000.0, "freeze": 15.0, "frame_sec": 36000, "src": "v6", "dst": "v7"}
node.add {"type": "split", "src": "v7", "dst": ["v8", "v9"]}
node.add {"type": "force_keyframe", "interval_sec": "1001/1000", "src": "v9", "dst": "v10"}
node.add {"type": "enc_video", "codec": "x", "src": "v10", "dst": "v11"}
node.add {"type": "mux", "name": "mx", "src": ["v11", "a7"], "dst": "muxed"}
node.add {"type": "output", "name": "out", "url": "live/output", "src": "muxed"}
node.add {"type": "split", "drop": true, "src": "v8", "dst": []}
node.add {"type": "null_sink", "name": "gone", "src": "a5"}
stats.subscribe {"url": "", "name": "stream1", "interval": 3, "streams": {"video": [{"q_pre_dec": "v2"}], "audio": [{"q_pre_dec": "a0"}]}}
group.start out
detach retry group.start in
"""


def test_transcoder_binds_and_runs(spark, small):
    graph = script(TRANSCODE)
    packets = V.packets(spark, small)
    # the two outputs have other columns where only frames of one kind have them
    edges = graph.bind({"live": packets, "slate": packets.where("stream_id = 'view'")})
    assert "d1" not in edges and edges["slate"].count() == 1 and edges["gone"].count() > 0
    out = edges["out"].select("stream_id", "stream_index", "merge_ts", "seq", "pts_us", "dts_us").collect()
    assert {(r["stream_id"], r["stream_index"]) for r in out} == {("click", 0), ("error", 1)}
    for k in (0, 1):
        own = sorted((r for r in out if r["stream_index"] == k), key=lambda r: r["seq"])
        assert len({r["seq"] for r in own}) == len(own) and all(a["merge_ts"] <= b["merge_ts"] for a, b in zip(own, own[1:]))
    assert graph.statistics(edges)["stream1"].count() == edges["v2"].count() + edges["a0"].count()


def test_routing_pairs_by_queue(spark, small):
    g = script('node.add {"type":"input","url":"x","dst":"all"}\nnode.add {"type":"demux","src":"all","dst":["audio","video"],"routing":{"v":"video","a":"audio"}}')
    edges = g.bind({"x": V.packets(spark, small)})
    assert edges["video"].first()["media"] == "V" and edges["audio"].first()["media"] == "A"


def test_mux_merges(spark):
    rows = lambda k, ts: spark.createDataFrame([(k, i, t, p) for i, (t, p) in enumerate(ts)], "stream_id string, seq long, dts_us long, pts_us long")
    one, two = rows("a", [(10, 10), (30, 25), (None, None), (30, 60)]), rows("b", [(5, 5), (40, 40), (None, 50)])
    got = REGISTRY["mux"]([one, two], {"fix_timestamps": True, "tick_us": 10})[0].orderBy("merge_ts", "stream_index", "seq").collect()
    assert [(r["stream_id"], r["seq"], r["dts_us"], r["pts_us"]) for r in got] == [("b", 0, 10, 10), ("a", 0, 10, 10), ("a", 1, 30, 30), ("a", 3, 40, 60), ("b", 1, 40, 40)]


def test_timecodes_and_slaves(spark):
    word = 0x00010203  # 03:02:01:00
    frames = spark.createDataFrame([("v", 0, 100, None, None), ("v", 2, 300, [1, word], 5), ("v", 4, 500, [0, word], None), ("v", 6, 600, [], 1 << 19)], "stream_id string, seq long, pts_us long, s12m array<long>, gop long")
    us = (3 * 3600 + 2 * 60 + 1) * 1_000_000
    got = {r["seq"]: r["pts_us"] for r in REGISTRY["extract_timestamps"]([frames], {"rate": 25, "timecodes": ["S12M", "what", "GOP"]})[0].collect()}
    assert got == {0: 100 + us - 300, 2: us, 4: 500 + us - 300, 6: 600 + us - 300}
    both = {r["seq"]: r["pts_us"] for r in REGISTRY["extract_timestamps"]([frames], {"rate": 25, "timecodes": ["GOP", "S12M"], "drop_before_available": True})[0].collect()}
    assert both == {2: 200_000, 4: 200_200, 6: 3_600_000_000}
    master = REGISTRY["extract_timestamps"]([frames], {"timecodes": ["S12M"]})[0]
    slave = spark.createDataFrame([("a", 1, 150), ("a", 3, 350)], "stream_id string, seq long, pts_us long")
    assert {r["seq"]: r["pts_us"] for r in REGISTRY["extract_timestamps_slave"]([slave, master], {})[0].collect()} == {1: 150 + us - 300, 3: 350 + us - 300}


def test_output_ends_after_many_failures(spark):
    rows = [("a", i, 3 <= i < 5 or 10 <= i < 40) for i in range(60)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, bad boolean")
    assert sorted(r["seq"] for r in REGISTRY["output"]([df], {"failed": "bad"})[0].collect()) == [i for i, (_, _, bad) in enumerate(rows) if not bad and i < 30]


def test_routes():
    assert routing.resolve_routes(V.STREAMS, {"v:1": "x", "A": "y", "?d": "z"}) == {"view": "x", "error": "y"}
    with pytest.raises(ValueError):
        routing.resolve_routes(V.STREAMS, {"d": "z"})
    with pytest.raises(ValueError):
        routing.resolve_routes(V.STREAMS, {"v": "z", "0": "y"})


def test_empty_tables(spark, small):
    none = V.packets(spark, small).where("false")
    assert routing.fix_timestamps(none.withColumn("dts_ms", none.dts_us).withColumn("pts_ms", none.pts_us)).count() == 0
    assert statistics.history(none, 10, 10).count() == 0
    assert frames.fps_grid(none, 1000).count() == 0
    assert frames.sentinel(none, 1000).count() == 0


def test_filters_reach_the_scan(spark, small):
    plan = routing.demux(V.packets(spark, small), V.STREAMS, {"v": "q"}).select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan or "EqualTo(event_type,click)" in plan
    assert "value" not in plan.split("ReadSchema")[1]
