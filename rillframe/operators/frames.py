"""Operators on video and audio frames that windows, joins and explosions express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.functions.timeline import by_stream

#: Ticks of one gap that are spread at a time.
CHUNK = 10_000


def force_keyframe(frames: DataFrame, interval_us: int) -> DataFrame:
    """Marks a frame as key (picture type I) where the interval's number changes; frames without a time are left alone."""
    timed = frames.withColumn("bucket", F.expr(f"cast(pts_us div {interval_us} as int)"))
    last = F.last(F.col("bucket"), ignorenulls=True).over(by_stream().rowsBetween(Window.unboundedPreceding, -1))
    key = F.col("bucket").isNotNull() & ~F.col("bucket").eqNullSafe(last)
    return timed.withColumn("forced", key).withColumn("picture_type", F.when(F.col("bucket").isNull(), F.lit(None)).when(key, "I").otherwise("NONE"))


def team_shift(frames: DataFrame, timecode_us: Column, team: str, before: str = "drop") -> DataFrame:
    """Times moved by the latest timecode's distance from its frame's time, over all streams of a team in order of seq. `team` names a column.

    before: what becomes of frames that come before any timecode: "drop" or "pass"; "block" holds them until one comes, and they leave with its shift.
    """
    w = Window.partitionBy(team).orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = frames.withColumn("shift_us", F.last(timecode_us - F.col("pts_us"), ignorenulls=True).over(so_far))
    if before == "block":
        first = F.first(timecode_us - F.col("pts_us"), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        out = out.withColumn("shift_us", F.coalesce("shift_us", first))
    out = out.where("shift_us is not null") if before != "pass" else out
    return out.withColumn("shifted_pts_us", F.col("pts_us") + F.coalesce("shift_us", F.lit(0)))


def fps_grid(frames: DataFrame, step_us: int) -> DataFrame:
    """A fixed rate without resynchronising: tick k shows the last frame at or before the first one's time plus k steps.

    A frame fills the ticks from its own time up to the next frame's, so that there is no join. A long gap is spread in chunks of ticks.
    """
    w = by_stream()
    first = F.first("pts_us").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = frames.where("pts_us is not null").withColumn("_t0", first).withColumn("_next", F.lead("pts_us").over(w))
    low = F.expr(f"(pts_us - _t0 + {step_us - 1}) div {step_us}")
    high = F.when(F.col("_next").isNull(), low).otherwise(F.expr(f"(_next - _t0 + {step_us - 1}) div {step_us} - 1"))
    spread = kept.withColumn("_low", low).withColumn("_high", high).where("_high >= _low")
    chunk = F.explode(F.sequence(F.expr(f"_low div {CHUNK}"), F.expr(f"_high div {CHUNK}")))
    spread = spread.withColumn("_chunk", chunk).withColumn("tick", F.explode(F.sequence(F.greatest("_low", F.col("_chunk") * CHUNK), F.least("_high", F.col("_chunk") * CHUNK + (CHUNK - 1)))))
    return spread.select("stream_id", "tick", (F.col("_t0") + F.col("tick") * step_us).alias("tick_us"), "seq")


def sentinel(frames: DataFrame, duration_us: int, tolerance_us: int = 1000, fill: str = "exact", start_us: int = 10_000_000) -> DataFrame:
    """Continuous output times of one stream: steps back join on, steps ahead are filled with at most five backup frames ("exact": every
    second one isn't filled; "all": each is). fills: backup frames before this one."""
    w = by_stream()
    d = duration_us
    step = frames.where("pts_us is not null").withColumn("_d", F.col("pts_us") - F.lag("pts_us").over(w))
    step = step.withColumn("jump", F.coalesce(F.abs(F.col("_d") - d) >= tolerance_us, F.lit(False)))
    ahead = F.col("jump") & (F.col("_d") > d)
    step = step.withColumn("_k", F.sum(ahead.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    filled = ahead & (F.lit(True) if fill == "all" else F.col("_k") % 2 == 1)
    most = F.lit(1 << 40) if fill == "all" else F.lit(5)
    step = step.withColumn("fills", F.when(filled, F.least(most, F.ceil((F.col("_d") - d) / d).cast("long"))).otherwise(0).cast("long"))
    moved = F.when(F.col("_d").isNull(), start_us).when(F.col("jump"), (1 + F.col("fills")) * d).otherwise(F.col("_d"))
    return step.withColumn("out_us", F.sum(moved).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_d", "_k")


def raw_output_align(items: DataFrame) -> DataFrame:
    """What a group of raw outputs writes: from the first video time not before all audio streams have begun; earlier audio loses its first samples.

    items: stream_id, seq, media, pts_us, n_samples and sample_rate (audio).
    """
    begin = items.where("media = 'A'").groupBy("stream_id").agg(F.min_by("pts_us", "seq").alias("t")).agg(F.max("t").alias("least"))
    start = items.where("media = 'V'").join(F.broadcast(begin), F.col("pts_us") >= F.col("least")).agg(F.min_by("pts_us", "seq").alias("start_us"))  # one row
    skip = F.expr("greatest(0, (start_us - pts_us) * sample_rate div 1000000)")
    out = items.crossJoin(F.broadcast(start)).where("start_us is not null").withColumn("skip", F.when(F.col("media") == "A", skip).otherwise(0))
    return out.where((F.col("media") == "V") & (F.col("pts_us") >= F.col("start_us")) | (F.col("media") == "A") & (F.col("skip") < F.col("n_samples")))


def picture_buffer(frames: DataFrame, once: bool = True) -> DataFrame:
    """One frame per stream: the first, or the latest."""
    pick = F.min_by if once else F.max_by
    cols = [c for c in frames.columns if c != "stream_id"]
    return frames.groupBy("stream_id").agg(pick(F.struct(*cols), "seq").alias("f")).select("stream_id", "f.*")


def side_packets(frames: DataFrame, kind: str) -> DataFrame:
    """One packet for each side-data entry of a kind, at its frame's time."""
    own = F.expr(f"filter(side_data, x -> x.type = '{kind}')")
    return frames.select("stream_id", "seq", "pts_us", F.posexplode(own).alias("entry", "side")).select("stream_id", "seq", F.col("pts_us"), F.col("pts_us").alias("dts_us"), "entry", F.col("side.data").alias("payload"))


def reframe(audio: DataFrame, size: int) -> DataFrame:
    """Frames of another size from the samples of each stream and channel in order; a rest shorter than a frame is a frame of its own."""
    before = Window.partitionBy("stream_id", "channel").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = audio.withColumn("_at", F.coalesce(F.sum(F.size("samples")).over(before), F.lit(0)))
    one = placed.select("stream_id", "channel", F.posexplode("samples").alias("i", "x"), "_at").withColumn("at", F.col("_at") + F.col("i"))
    frames = one.groupBy("stream_id", "channel", F.expr(f"at div {size}").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"))
    return frames.select("stream_id", "channel", "frame", F.size("s").alias("n_samples"), F.transform("s", lambda v: v["x"]).alias("samples"))


def pad_channels(frames: DataFrame, count: int) -> DataFrame:
    """Exactly `count` channels: missing ones are silent, others go. frames: channels as array of arrays."""
    silence = F.array_repeat(F.lit(0.0), F.coalesce(F.size(F.element_at("channels", 1)), F.lit(0)))
    return frames.withColumn("channels", F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.coalesce(F.try_element_at("channels", i.cast("int")), silence)))


def estimate_rate(audio: DataFrame, skip: int, analyse: int) -> DataFrame:
    """Sample rate of each stream: samples over time after skipping whole records until `skip` samples have gone by, over about `analyse` samples;
    above 47760 it counts as 48000."""
    so_far = by_stream().rowsBetween(Window.unboundedPreceding, 0)
    kept = audio.withColumn("_n", F.sum("n_samples").over(so_far)).where(F.col("_n") > skip)
    kept = kept.withColumn("_m", F.sum("n_samples").over(so_far)).where(F.col("_m") <= analyse)
    rate = kept.groupBy("stream_id").agg((F.sum("n_samples") - F.max_by("n_samples", "seq")).alias("n"), (F.max("pts_us") - F.min("pts_us")).alias("us"))
    raw = F.round(F.try_divide(F.col("n") * 1e6, F.col("us"))).cast("long")
    return rate.select("stream_id", F.when(raw > 47760, 48000).otherwise(raw).alias("rate"))


def first_of_tick(frames: DataFrame, tick_us: int) -> DataFrame:
    """The first frame of each tick; all others that have come by then go."""
    return frames.groupBy("stream_id", F.expr(f"arrival_us div {tick_us}").alias("tick")).agg(F.min("seq").alias("seq"), F.min_by("pts_us", "seq").alias("pts_us"), F.count("*").alias("n_buffered"))
