"""Node types for graphs, each a thin wrapper of an operator."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.functions.timeline import gop_ticks, parse_ratio, smpte_ticks
from rillframe.operators import frames, routing, sequential
from rillframe.plans.graph import register_node
from rillframe.sources.records import splice_section

Frames = list[DataFrame]
Params = dict[str, Any]


def _whole(src: Frames) -> DataFrame:
    """All inputs' items; what one kind of item lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), src)


def _us(seconds: Any) -> int:
    """Microseconds of seconds given as a number or a ratio."""
    return round(parse_ratio(seconds) * 1_000_000)


def _step(rate: Any) -> int:
    return round(1_000_000 / parse_ratio(rate))


@register_node("split", "packet_relay", "assume_video_format", "assume_audio_format", "null_sink")
def same(src: Frames, params: Params) -> Frames:
    """Items as they are: fan-out, relays, declared formats, and the sink that drops all (to be run with the noop format)."""
    return src[:1]


@register_node("bsf", "dec_video", "dec_audio", "filter_video", "filter_audio", "rescale_video", "expr")
def expressions(src: Frames, params: Params) -> Frames:
    """What codecs, filter graphs and scalers do to an item isn't run here: `columns` says it with named Spark SQL expressions.

    filter_audio, and filter_video where asked, move times so that a stream begins where its input began.
    """
    if "columns" not in params:
        raise ValueError("this node doesn't run codecs or filters: give `columns`, named Spark SQL expressions")
    whole = _whole(src)
    out = whole.withColumns({"_was": F.col("pts_us")} if params.get("shift") else {}).withColumns({k: F.expr(v) for k, v in params["columns"].items()})
    if params.get("shift"):
        out = routing.equalize(out, F.col("_was")).withColumn("pts_us", F.col("equal_pts_us")).drop("_was", "shift_us", "equal_pts_us")
    return [out]


@register_node("demux")
def demux(src: Frames, params: Params) -> Frames:
    """One edge for each route, None where an optional stream is missing. Streams are those of the data, or those that `streams` lists as [id, media]."""
    streams = [tuple(s) for s in params["streams"]] if "streams" in params else routing.streams_of(src[0])
    if only := params.get("streams_filter"):
        kept = routing.matching(streams, only)
        streams = [s for s in streams if s[0] in kept]
    routes = params["routing"]
    got = routing.demux(src[0], streams, routes, bool(params.get("wait_for_keyframe", False)))
    there = set(routing.resolve_routes(streams, routes).values())
    return [got.where(F.col("queue") == q) if q in there else None for q in routes.values()]


@register_node("mux")
def mux(src: Frames, params: Params) -> Frames:
    """Packets of all inputs with stream_index (the input's place) and merge_ts: sorted by (merge_ts, stream_index, seq) they stand in output order.

    Packets without a decoding time go, once those with one are in order. fix_timestamps repairs times in ticks of `tick_us`.
    """
    whole = _whole([s.withColumn("stream_index", F.lit(i)) for i, s in enumerate(src)])
    timed = whole.where("dts_us is not null or pts_us is not null")
    so_far = Window.partitionBy("stream_index").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = timed.withColumn("merge_ts", F.max(F.coalesce("dts_us", "pts_us")).over(so_far)).where("dts_us is not null")
    if params.get("fix_timestamps"):
        tick = int(params.get("tick_us", 1))
        ticks = lambda c: F.expr(f"cast(round({c} / {tick}) as long)") if tick > 1 else F.col(c)
        fixed = routing.fix_timestamps(out.withColumn("_dts", ticks("dts_us")).withColumn("_pts", ticks("pts_us")), "_dts", "_pts")
        out = fixed.withColumn("dts_us", F.col("fixed_dts") * tick).withColumn("pts_us", F.col("fixed_pts") * tick).drop("fixed_dts", "fixed_pts", "_dts", "_pts")
    return [out]


@register_node("output")
def output(src: Frames, params: Params) -> Frames:
    """What is written. Where `failed`, an expression, marks packets that couldn't be, more than twenty on end are an error of the whole output: nothing
    after them is written."""
    if "failed" not in params:
        return src[:1]
    return [routing.until_failures(src[0], F.expr(params["failed"]), int(params.get("most", 20)))]


@register_node("firewall")
def firewall(src: Frames, params: Params) -> Frames:
    return [routing.firewall(src[0])]


@register_node("force_keyframe")
def force_keyframe(src: Frames, params: Params) -> Frames:
    return [frames.force_keyframe(src[0], _us(params["interval_sec"]))]


@register_node("enc_video", "enc_audio")
def encode(src: Frames, params: Params) -> Frames:
    """What an encoder accepts, as packets; with timestamps_passthrough decoding times are the presentation times."""
    out = routing.monotone_guard(src[0])
    return [out.withColumn("dts_us", F.col("pts_us")) if params.get("timestamps_passthrough") or "dts_us" not in out.columns else out]


def _modelled(items: DataFrame, model: Any) -> DataFrame:
    """The items that a model lets through, with what it says of them; an item that it repeats comes as often, numbered anew in order of time."""
    got = sequential.replay(items, model)
    kept = items.drop(*[c for c in got.columns if c not in ("stream_id", "seq")])
    met = got.join(kept, ["stream_id", "seq"])
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("pts_us", "seq")).cast("long")
    return met.withColumn("seq", number)


@register_node("limit_fps")
def limit_fps(src: Frames, params: Params) -> Frames:
    step = _step(params["max_fps"])
    got = sequential.replay(src[0], lambda: sequential.LimitFps(step)).select("stream_id", "seq")
    return [src[0].join(got, ["stream_id", "seq"], "left_semi")]


@register_node("force_fps")
def force_fps(src: Frames, params: Params) -> Frames:
    step = _step(params["fps"])
    return [_modelled(src[0], lambda: sequential.ForceFps(step))]


@register_node("sentinel_video", "sentinel_audio")
def sentinel(src: Frames, params: Params) -> Frames:
    """Continuous frames; `frame_sec` is the length of one (1/25 unless given). Streams of one input are guarded each by itself."""
    args = {"duration_us": _us(params.get("frame_sec", "1/25")), "tolerance_us": _us(params.get("max_streams_diff", 0.001)), "timeout_us": _us(params.get("timeout", 1)), "freeze_us": _us(params.get("freeze", 5)), "lock": bool(params.get("lock_timeshift", False))}
    runs = sequential.replay(src[0], lambda: sequential.SentinelRuns(**args)).drop("stream")
    got = sequential.frames_of(runs, args["duration_us"]).withColumnRenamed("out_us", "pts_us")
    met = got.join(src[0].drop("pts_us"), ["stream_id", "seq"])
    return [met.withColumn("seq", F.row_number().over(Window.partitionBy("stream_id").orderBy("pts_us")).cast("long"))]


@register_node("realtime")
def realtime(src: Frames, params: Params) -> Frames:
    """Items that replay doesn't drop, with its action and offset."""
    margin = _us(params.get("jitter_margin", 0))
    args = {
        "tolerance_us": _us(params.get("negative_time_tolerance", 0.25)), "discontinuity_us": _us(params.get("discontinuity_threshold", 1)), "margin_us": margin,
        "initial_margin_us": _us(params["initial_jitter_margin"]) if "initial_jitter_margin" in params else margin,
        "discard_us": _us(params["negative_time_discard"]) if "negative_time_discard" in params else None, "speed": float(params.get("speed", 1)),
    }
    got = sequential.replay(src[0], lambda: sequential.Realtime(**args)).drop("stream").where("action <> 'drop'")
    return [src[0].join(got, ["stream_id", "seq"])]


@register_node("sync_buffer")
def sync_buffer(src: Frames, params: Params) -> Frames:
    got = sequential.replay(src[0], sequential.SyncBuffer).drop("stream")
    return [src[0].join(got, ["stream_id", "seq"])]


#: Timecode sources by name.
TIMECODES = ("S12M", "GOP")


def timecode(params: Params) -> Column:
    """Microseconds of the first available timecode of a frame with columns s12m (array of words, the first one their number) and gop; an unknown name ends the search."""
    rate = parse_ratio(params.get("rate", 25))
    found = []
    for name in params.get("timecodes", TIMECODES)[:4]:
        if name not in TIMECODES:
            break
        if name == "GOP":
            ticks = gop_ticks(F.col("gop"), rate)
        else:
            words = F.slice("s12m", 2, F.least(F.element_at("s12m", 1), F.lit(3)).cast("int"))
            ticks = F.when(F.size("s12m") > 1, smpte_ticks(F.try_element_at(words, F.lit(1)), rate, bool(params.get("liveu", False))))
        found.append(F.expr("cast(null as long)") if ticks is None else F.floor(ticks * rate.denominator * 1_000_000 / rate.numerator).cast("long"))
    return F.coalesce(*found) if found else F.lit(None).cast("long")


@register_node("extract_timestamps")
def extract_timestamps(src: Frames, params: Params) -> Frames:
    """Times moved by the latest timecode of the team's frames, which are those of the node's inputs (slaves among them: they bring no timecode)."""
    before = "pass" if params.get("passthrough_before_available") else "drop" if params.get("drop_before_available") else "block"
    whole = _whole(src)
    moved = frames.team_shift(whole.withColumn("_team", F.lit(params.get("team", "default"))), timecode(params), "_team", before)
    return [moved.withColumn("pts_us", F.col("shifted_pts_us")).drop("_team", "shifted_pts_us")]


@register_node("extract_timestamps_slave")
def extract_timestamps_slave(src: Frames, params: Params) -> Frames:
    """Frames of a team's slave, which has no timecode of its own: the second input has the team's frames, as extract_timestamps gives them."""
    if len(src) < 2:
        raise ValueError("a slave needs its team's frames as a second input")
    known = src[1].select(F.lit(None).cast("string").alias("_own"), "seq", F.col("shift_us").alias("_shift"))
    both = src[0].withColumn("_own", F.lit("x")).withColumn("_shift", F.lit(None).cast("long")).unionByName(known, allowMissingColumns=True)
    w = Window.partitionBy(F.lit(params.get("team", "default"))).orderBy("seq", F.col("_own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    moved = both.withColumn("shift_us", F.last("_shift", ignorenulls=True).over(w)).where("_own is not null")
    moved = moved if params.get("passthrough_before_available") else moved.where("shift_us is not null")
    return [moved.withColumn("pts_us", F.col("pts_us") + F.coalesce("shift_us", F.lit(0))).select(*src[0].columns, "shift_us")]


@register_node("extract_cc_data")
def extract_cc_data(src: Frames, params: Params) -> Frames:
    return [frames.side_packets(src[0], "A53_CC")]


@register_node("parse_scte35")
def parse_scte35(src: Frames, params: Params) -> Frames:
    return [src[0].withColumn("splice", splice_section(F.col("payload")))]


@register_node("resample_audio", "resample_audio_forward_channels")
def resample_audio(src: Frames, params: Params) -> Frames:
    """Frames of another size (1024 unless given) for frames of one channel each. Samples keep their rate.

    Frames that come without samples but with their number, n_samples, get output times instead, held near the input's (`max_drift`, seconds) by `added` samples.
    """
    size = int(params.get("frame_size", 1024))
    if "samples" in src[0].columns:
        return [frames.reframe(src[0], size)]
    rate, most = int(params.get("dst_sample_rate", 48000)), _us(params.get("max_drift", 0.001))
    got = sequential.replay(src[0], lambda: sequential.AudioDrift(rate, size, most), arrival="n_samples").withColumnRenamed("out_us", "pts_us")
    return [src[0].drop("pts_us").join(got, ["stream_id", "seq"])]


@register_node("raw_output")
def raw_output(src: Frames, params: Params) -> Frames:
    """What a group writes from its common start on; the group's streams are the node's inputs."""
    return [frames.raw_output_align(_whole(src))]


@register_node("jack_sink")
def jack_sink(src: Frames, params: Params) -> Frames:
    return [frames.pad_channels(src[0], int(params.get("channels_count", 2)))]


@register_node("picture_buffer_sink")
def picture_buffer(src: Frames, params: Params) -> Frames:
    return [frames.picture_buffer(src[0], bool(params.get("once", True)))]


@register_node("delaygen")
def delaygen(src: Frames, params: Params) -> Frames:
    return [routing.delayed(src[0], _us(params["delay"]))]


@register_node("jittergen")
def jittergen(src: Frames, params: Params) -> Frames:
    return [routing.jittered(src[0])]
