"""Routing, fan-out, ordered merge and timestamp repair of packets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.functions.timeline import by_stream, discontinuity, session_id


def drop_invalid(packets: DataFrame) -> DataFrame:
    """What a source passes on: packets with a presentation or a decoding time."""
    return packets.where("pts_us is not null or dts_us is not null")


def firewall(items: DataFrame) -> DataFrame:
    return items.where(F.col("pts_us").isNotNull())


#: A source with more streams than this isn't one recording; streams are listed on the driver.
MOST_STREAMS = 10_000


def streams_of(packets: DataFrame) -> list[tuple[str, str]]:
    """(stream, media) of a source in index order: by its column stream_index if it has one, else by name."""
    index = F.min("stream_index") if "stream_index" in packets.columns else F.lit(0)
    rows = packets.groupBy("stream_id", "media").agg(index.alias("i")).orderBy("i", "stream_id").limit(MOST_STREAMS + 1).collect()
    if len(rows) > MOST_STREAMS:
        raise ValueError(f"more than {MOST_STREAMS} streams")
    return [(r["stream_id"], r["media"]) for r in rows]


def matching(streams: list[tuple[str, str]], spec: str) -> list[str]:
    """Streams that a specifier names: `v`, `a` or `d`, all of that media or with `:n` the n-th, or a plain index."""
    m = re.fullmatch(r"(?:([vadVAD])(?::(\d+))?|(\d+))", spec)
    if not m:
        raise ValueError(f"bad stream specifier {spec!r}")
    names = [s[0] for s in streams if m[3] or s[1].lower() == m[1].lower()]
    number = m[3] or m[2]
    return names if number is None else names[int(number) : int(number) + 1]


def resolve_routes(streams: list[tuple[str, str]], routing: dict[str, str]) -> dict[str, str]:
    """stream -> queue for specifiers as in matching(), the first stream of each; `?` before one allows it to be missing."""
    out: dict[str, str] = {}
    for spec, queue in routing.items():
        names = matching(streams, spec.removeprefix("?"))
        if not names:
            if spec.startswith("?"):
                continue
            raise ValueError(f"no stream for {spec!r}")
        if names[0] in out:
            raise ValueError(f"stream {names[0]!r} is routed twice")
        out[names[0]] = queue
    return out


def demux(packets: DataFrame, streams: list[tuple[str, str]], routing: dict[str, str], wait_for_keyframe: bool = False) -> DataFrame:
    """Routed packets with their queue. The filter on stream_id reaches the scan.

    With wait_for_keyframe all packets before the first key packet of a routed video stream go.
    """
    routes = resolve_routes(streams, routing)
    if not routes:
        return packets.where("false").withColumn("queue", F.lit(""))
    queue = F.coalesce(*[F.when(F.col("stream_id") == s, q) for s, q in routes.items()])
    out = packets.where(F.col("stream_id").isin(*routes)).withColumn("queue", queue)
    if not wait_for_keyframe:
        return out
    first = out.where("is_key and media = 'V'").agg(F.min("seq").alias("_first"))
    return out.crossJoin(F.broadcast(first)).where("seq >= _first").drop("_first")  # one row


def split(items: DataFrame, branches: list[str]) -> DataFrame:
    """Each item once per branch."""
    return items.withColumn("branch", F.explode(F.array(*map(F.lit, branches)))) if branches else items.where("false").withColumn("branch", F.lit(""))


def merge_key(packets: DataFrame, sources: list[str], ts: str = "dts_us") -> DataFrame:
    """Packets with merge_ts and src_index: sorted by (merge_ts, src_index, seq) they stand in the order of a merge by least timestamp.

    A packet can't overtake those before it in its stream, so that it counts as the latest time so far.
    """
    so_far = by_stream().rowsBetween(Window.unboundedPreceding, 0)
    index = F.coalesce(*[F.when(F.col("stream_id") == s, i) for i, s in enumerate(sources)])
    return packets.where(F.col(ts).isNotNull() & F.col("stream_id").isin(*sources)).withColumn("merge_ts", F.max(ts).over(so_far)).withColumn("src_index", index)


def fix_timestamps(packets: DataFrame, dts: str = "dts_ms", pts: str = "pts_ms") -> DataFrame:
    """Decoding times strictly rising in each stream, by single ticks where need be; presentation times not before them."""
    w = by_stream()
    number = F.row_number().over(w)
    numbered = packets.withColumn("_n", number)
    fixed = F.col("_n") + F.max(F.col(dts) - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = numbered.withColumn("fixed_dts", fixed)
    return out.withColumn("fixed_pts", F.when(F.col(pts).isNotNull(), F.greatest(F.col(pts), F.col("fixed_dts")))).drop("_n")


def monotone_guard(frames: DataFrame, ts: str = "pts_us") -> DataFrame:
    """Frames that an encoder accepts: none before the latest accepted time; those without a time pass."""
    before = by_stream().rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("_latest", F.max(ts).over(before)).where(F.col(ts).isNull() | F.col("_latest").isNull() | (F.col(ts) >= F.col("_latest"))).drop("_latest")


def runs(items: DataFrame, failed: Column) -> DataFrame:
    """Runs of consecutive failures: (stream_id, first_seq, n)."""
    w = by_stream()
    marked = items.select("stream_id", "seq", failed.alias("failed")).withColumn("island", F.sum((~F.col("failed")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("failed").groupBy("stream_id", "island").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")).drop("island")


def until_failures(items: DataFrame, failed: Column, most: int) -> DataFrame:
    """Items of each stream that didn't fail, up to the one that makes it more than `most` failures on end."""
    w = by_stream().rowsBetween(Window.unboundedPreceding, 0)
    marked = items.withColumn("_failed", F.coalesce(failed, F.lit(False))).withColumn("_good", F.sum((~F.col("_failed")).cast("long")).over(w))
    run = F.sum(F.col("_failed").cast("long")).over(Window.partitionBy("stream_id", "_good").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    over = F.max((F.col("_run") > most).cast("int")).over(w)
    return marked.withColumn("_run", run).withColumn("_over", over).where("_over = 0 and not _failed").drop("_failed", "_good", "_run", "_over")


def choose_codec(packets: DataFrame, codec: Column, codec_map: dict[str, str], default: str) -> DataFrame:
    """The decoder for each packet: from the map, else the default."""
    chosen = F.coalesce(*[F.when(codec == k, v) for k, v in codec_map.items()], F.lit(default))
    return packets.withColumn("decoder", chosen)


def sessions(items: DataFrame, ts: str, limit_us: int) -> DataFrame:
    """Items with a session number that rises at every discontinuity."""
    w = by_stream()
    return items.withColumn("jump", discontinuity(F.col(ts), w, limit_us)).withColumn("session", session_id(F.col("jump"), w))


def equalize(items: DataFrame, first_input: Column) -> DataFrame:
    """Output times moved so that a stream begins where its input began."""
    w = by_stream().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return items.withColumn("shift_us", F.first(first_input, ignorenulls=True).over(w) - F.first("pts_us", ignorenulls=True).over(w)).withColumn("equal_pts_us", F.col("pts_us") + F.col("shift_us"))


def delayed(items: DataFrame, delay_us: int) -> DataFrame:
    return items.withColumn("arrival_us", F.col("arrival_us") + delay_us)


def jittered(items: DataFrame) -> DataFrame:
    """A random-looking but repeatable delay: below 100 ms, and for one in eight up to 600 ms more."""
    h = lambda salt: F.conv(F.substring(F.md5(F.concat(F.col("seq").cast("string"), F.lit(salt))), 1, 6), 16, 10).cast("long")
    extra = F.when(h("b") % 8 == 0, h("c") % 600).otherwise(0)
    return items.withColumn("arrival_us", F.col("arrival_us") + (h("a") % 100 + extra) * 1000)


def queue_stats(items: DataFrame, capacity: int = 63) -> DataFrame:
    """Per edge: items seen, capacity and last time."""
    return items.groupBy("stream_id").agg(F.count("*").alias("n_items"), F.lit(capacity).alias("capacity"), F.max_by("pts_us", "seq").alias("last_pts_us"))
