"""The registered queries over the event and embedding tables, each with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.functions import timeline as T
from rillframe.operators import frames as FR
from rillframe.operators import routing as R
from rillframe.operators import sequential as S
from rillframe.operators import statistics as ST
from rillframe.plans import nodes  # noqa: F401  (registers the node types)
from rillframe.plans.graph import script
from rillframe.sources import tables as V

HOUR = 3_600_000_000
PKT = """pkt AS (SELECT event_type AS stream_id, event_id AS seq, epoch_us(ts) AS arrival_us, epoch_us(ts) AS pts_us, epoch_us(ts) AS dts_us,
  cast(json_extract_string(props, '$.k') AS BIGINT) + 1 AS size, (event_id % 10 = 0) AS is_key,
  CASE WHEN event_type IN ('view', 'click') THEN 'V' ELSE 'A' END AS media, user_id, value FROM events)"""
REORDERED = PKT + ", re AS (SELECT *, pts_us // 1000 AS pts_ms, pts_us // 1000 - CASE WHEN seq % 7 = 0 THEN 7200000 ELSE 0 END AS dts_ms FROM pkt)"
NULLS = PKT + ", nu AS (SELECT * REPLACE (CASE WHEN seq % 5 <> 0 THEN pts_us END AS pts_us, CASE WHEN seq % 10 >= 5 THEN dts_us END AS dts_us) FROM pkt)"
AUD = """aud AS (SELECT cast(label AS VARCHAR) AS stream_id, vec_id AS seq, vec_id % 2 AS channel, (vec_id // 2) * 64 * 1000000 // 48000 AS pts_us,
  48000 AS sample_rate, 64 AS n_samples, list_transform(embedding, lambda x: x::DOUBLE * 2.2) AS samples FROM embeddings)"""
SMP = AUD + ", smp AS (SELECT stream_id, seq, channel, pts_us, unnest(samples) AS x, unnest(range(64)) AS i FROM aud)"
SES = PKT + f""", lagged AS (SELECT *, dts_us - lag(dts_us) OVER (PARTITION BY stream_id ORDER BY seq) AS d FROM pkt),
  ses AS (SELECT *, sum(CASE WHEN d < 0 OR d > {HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) AS session FROM lagged)"""
BIN = "CASE WHEN abs(x) < 0.001 THEN 0 WHEN abs(x) > 0.9885309 THEN 16 ELSE greatest(0, least(16, ceil(15 + 5 * log10(greatest(abs(x), 1e-9)))::INT)) END"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {NULLS} SELECT stream_id, seq, pts_us, dts_us FROM nu WHERE pts_us IS NOT NULL OR dts_us IS NOT NULL")
def source_drop_invalid(spark, d):
    return R.drop_invalid(V.with_nulls(spark, d)).select("stream_id", "seq", "pts_us", "dts_us")


@query(f"WITH {NULLS} SELECT stream_id, seq, pts_us FROM nu WHERE pts_us IS NOT NULL")
def firewall(spark, d):
    return R.firewall(V.with_nulls(spark, d)).select("stream_id", "seq", "pts_us")


@query(f"WITH {PKT} SELECT stream_id, seq, size, CASE stream_id WHEN 'click' THEN 'video' WHEN 'error' THEN 'audio' END AS queue FROM pkt WHERE stream_id IN ('click', 'error')")
def demux_route(spark, d):
    return R.demux(V.packets(spark, d), V.STREAMS, {"v": "video", "a:0": "audio", "?a:9": "extra"}).select("stream_id", "seq", "size", "queue")


@query(f"WITH {PKT} SELECT stream_id, seq, CASE stream_id WHEN 'view' THEN 'v1' WHEN 'signup' THEN 'a2' ELSE 'two' END AS queue FROM pkt WHERE stream_id IN ('view', 'signup', 'purchase')")
def demux_nth(spark, d):
    return R.demux(V.packets(spark, d), V.STREAMS, {"v:1": "v1", "A:2": "a2", "2": "two"}).select("stream_id", "seq", "queue")


@query(f"WITH {PKT} SELECT stream_id, seq FROM pkt WHERE stream_id IN ('click', 'error') AND seq >= (SELECT min(seq) FROM pkt WHERE is_key AND stream_id = 'click')")
def demux_keyframe_gate(spark, d):
    return R.demux(V.packets(spark, d), V.STREAMS, {"v": "video", "a": "audio"}, wait_for_keyframe=True).select("stream_id", "seq")


@query(f"WITH {PKT} SELECT stream_id, seq, size, branch FROM pkt, (VALUES ('a'), ('b')) t(branch)")
def split_fanout(spark, d):
    return R.split(V.packets(spark, d), ["a", "b"]).select("stream_id", "seq", "size", "branch")


@query(f"""WITH {REORDERED} SELECT stream_id, seq, max(dts_ms) OVER (PARTITION BY stream_id ORDER BY seq) AS merge_ts,
  CASE stream_id WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS src_index FROM re WHERE stream_id IN ('view', 'click', 'error')""")
def mux_merge_order(spark, d):
    return R.merge_key(V.reordered(spark, d), ["view", "click", "error"], "dts_ms").select("stream_id", "seq", "merge_ts", "src_index")


@query(f"""WITH {REORDERED}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS rn FROM re)
  SELECT stream_id, seq, rn + max(dts_ms - rn) OVER (PARTITION BY stream_id ORDER BY seq) AS fixed_dts FROM n""")
def mux_fix_timestamps(spark, d):
    return R.fix_timestamps(V.reordered(spark, d)).select("stream_id", "seq", "fixed_dts")


@query(f"""WITH {REORDERED}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS rn FROM re),
  f AS (SELECT *, rn + max(dts_ms - rn) OVER (PARTITION BY stream_id ORDER BY seq) AS fixed_dts FROM n)
  SELECT stream_id, seq, greatest(pts_ms - 3600000, fixed_dts) AS fixed_pts FROM f""")
def mux_pts_ge_dts(spark, d):
    return R.fix_timestamps(V.reordered(spark, d).withColumn("pts_ms", F.col("pts_ms") - 3_600_000)).select("stream_id", "seq", "fixed_pts")


_LATE = "dts_ms - CASE WHEN seq % 1000 > 500 THEN 900000000 ELSE 0 END"
_SET = lambda name, value: f"list_transform(range(5), lambda i: CASE WHEN i = idx THEN {value} ELSE {name}[i + 1] END)"


@query(f"""WITH RECURSIVE {REORDERED}, o AS (SELECT user_id, stream_id, seq, {_LATE} AS ts, pts_ms, list_position(['click', 'error', 'purchase', 'signup', 'view'], stream_id) - 1 AS idx,
    row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM re),
  k AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, ''::VARCHAR AS stream_id, 0::BIGINT AS seq, [NULL, NULL, NULL, NULL, NULL]::BIGINT[] AS last, [0, 0, 0, 0, 0]::BIGINT[] AS moves, [0, 0, 0, 0, 0]::BIGINT[] AS runs,
      0::BIGINT AS shift, 0::BIGINT AS fixed_dts, 0::BIGINT AS fixed_pts FROM o
    UNION ALL SELECT user_id, rn, stream_id, seq, {_SET("last", "fixed_dts")}, CASE WHEN over THEN [0, 0, 0, 0, 0]::BIGINT[] ELSE moves END, CASE WHEN over THEN [0, 0, 0, 0, 0]::BIGINT[] ELSE runs END,
      CASE WHEN over THEN shift + list_max(moves) ELSE shift END, fixed_dts, greatest(pts, fixed_dts)
    FROM (SELECT *, runs[idx + 1] > 2 AS over FROM (SELECT user_id, rn, stream_id, seq, last, shift, idx, pts, CASE WHEN moved THEN l + 1 ELSE moved_ts END AS fixed_dts,
        {_SET("moves", "CASE WHEN moved THEN l + 1 - moved_ts ELSE 0 END")} AS moves, {_SET("runs", "CASE WHEN moved THEN runs[idx + 1] + 1 ELSE 0 END")} AS runs
      FROM (SELECT *, coalesce(moved_ts <= l, false) AS moved FROM (SELECT o.user_id, o.rn, o.stream_id, o.seq, o.idx, k.last, k.moves, k.runs, k.shift, k.last[o.idx + 1] AS l,
          o.ts + CASE WHEN k.last[o.idx + 1] IS NULL THEN 0 ELSE k.shift END AS moved_ts, o.pts_ms + CASE WHEN k.last[o.idx + 1] IS NULL THEN 0 ELSE k.shift END AS pts
        FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1)))))
  SELECT user_id, stream_id, seq, fixed_dts, shift, fixed_pts FROM k WHERE rn > 0""")
def mux_global_shift(spark, d):
    late = V.reordered(spark, d).withColumn("late", F.col("dts_ms") - F.when(F.col("seq") % 1000 > 500, 900_000_000).otherwise(0))
    got = S.replay(late, lambda: S.GlobalShift(2), ts="late", arrival="pts_ms", key="user_id", member="stream_id")
    return got.select("user_id", F.col("stream").alias("stream_id"), "seq", "fixed_dts", "shift", "fixed_pts")


@query(f"""WITH {REORDERED}, m AS (SELECT *, max(dts_ms) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM re)
  SELECT stream_id, seq, dts_ms FROM m WHERE latest IS NULL OR dts_ms >= latest""")
def encoder_monotone_guard(spark, d):
    return R.monotone_guard(V.reordered(spark, d), "dts_ms").select("stream_id", "seq", "dts_ms")


@query(f"""WITH {PKT}, f AS (SELECT stream_id, seq, size % 3 = 0 AS failed FROM pkt),
  i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY seq) AS island FROM f)
  SELECT stream_id, min(seq) AS first_seq, count(*) AS n FROM i WHERE failed GROUP BY stream_id, island""")
def decoder_error_runs(spark, d):
    return R.runs(V.packets(spark, d), F.col("size") % 3 == 0)


@query(f"WITH {PKT} SELECT stream_id, seq, CASE stream_id WHEN 'view' THEN 'h264' WHEN 'error' THEN 'aac' ELSE 'copy' END AS decoder FROM pkt")
def codec_map(spark, d):
    return R.choose_codec(V.packets(spark, d), F.col("stream_id"), {"view": "h264", "error": "aac"}, "copy").select("stream_id", "seq", "decoder")


@query(f"""WITH {PKT}, b AS (SELECT *, pts_us // {HOUR} AS bucket FROM pkt WHERE media = 'V')
  SELECT stream_id, seq, bucket IS DISTINCT FROM lag(bucket) OVER (PARTITION BY stream_id ORDER BY seq) AS forced,
  CASE WHEN bucket IS DISTINCT FROM lag(bucket) OVER (PARTITION BY stream_id ORDER BY seq) THEN 'I' ELSE 'NONE' END AS picture_type FROM b""")
def force_keyframe(spark, d):
    return FR.force_keyframe(V.video(spark, d), HOUR).select("stream_id", "seq", "forced", "picture_type")


@query(f"WITH {SES} SELECT stream_id, seq, session::BIGINT AS session FROM ses")
def discontinuity_sessions(spark, d):
    return R.sessions(V.packets(spark, d), "dts_us", HOUR).select("stream_id", "seq", "session")


@query(f"""WITH {PKT} SELECT seq, cast((pts_us::HUGEINT * 180000 + 1000000) // 2000000 AS BIGINT) AS mpeg,
  cast(sign(size - 50) * (((abs(size - 50) * 7 * 30000) * 2 + 1001) // 2002) AS BIGINT) AS ntsc FROM pkt""")
def ts_rescale(spark, d):
    p = V.packets(spark, d)
    return p.select("seq", T.rescale(F.col("pts_us"), "1/1000000", "1/90000").alias("mpeg"), T.rescale((F.col("size") - 50) * 7, "1", "1001/30000").alias("ntsc"))


@query(f"""WITH {PKT}, e AS (SELECT *, pts_us - 5000000 AS inp FROM pkt)
  SELECT stream_id, seq, pts_us + first_value(inp) OVER w - first_value(pts_us) OVER w AS equal_pts_us FROM e WINDOW w AS (PARTITION BY stream_id ORDER BY seq)""")
def ts_equalizer(spark, d):
    return R.equalize(V.packets(spark, d), F.col("pts_us") - 5_000_000).select("stream_id", "seq", "equal_pts_us")



def _packed():
    """A 12M word from the time of day, two decimal digits a field."""
    fields = [F.expr("pts_us div 1000000 div 3600 % 24"), F.expr("pts_us div 1000000 div 60 % 60"), F.expr("pts_us div 1000000 % 60"), F.expr("seq % 25")]
    word = F.lit(0).cast("long")
    for k, f in enumerate(fields):
        word = word.bitwiseOR(F.shiftleft(F.expr("0L") + F.floor(f / 10) * 16 + f % 10, 8 * k))
    return word


@query(f"WITH {PKT} SELECT seq, (pts_us // 1000000 % 86400) * 25 + seq % 25 AS ticks FROM pkt")
def timecode_pack_unpack(spark, d):
    return V.packets(spark, d).select("seq", T.smpte_ticks(_packed(), Fraction(25)).cast("long").alias("ticks"))


@query(f"""WITH {PKT}, g AS (SELECT seq, pts_us // 1000000 AS s FROM pkt)
  SELECT seq, ((s // 3600 % 24) * 3600 + (s // 60 % 60) * 60 + s % 60) * 30000 // 1001 + seq % 30 AS ticks FROM g""")
def timecode_gop(spark, d):
    word = F.expr("shiftleft(pts_us div 1000000 div 3600 % 24, 19) | shiftleft(pts_us div 1000000 div 60 % 60, 13) | shiftleft(pts_us div 1000000 % 60, 6) | (seq % 30)")
    return V.packets(spark, d).select("seq", T.gop_ticks(word, Fraction(30000, 1001)).cast("long").alias("ticks"))


@query(f"""WITH {PKT}, t AS (SELECT user_id, seq, pts_us, CASE WHEN seq % 11 = 3 THEN pts_us + seq * 1000 END AS tc FROM pkt),
  s AS (SELECT *, last_value(tc - pts_us IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS shift FROM t)
  SELECT user_id, seq, pts_us + shift AS shifted_pts_us FROM s WHERE shift IS NOT NULL""")
def timecode_team_shift(spark, d):
    tc = F.when(F.col("seq") % 11 == 3, F.col("pts_us") + F.col("seq") * 1000)
    return FR.team_shift(V.packets(spark, d), tc, team="user_id").select("user_id", "seq", "shifted_pts_us")


@query(f"""WITH RECURSIVE {PKT}, o AS (SELECT user_id, seq, pts_us, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM pkt),
  k AS (SELECT user_id, rn, seq, pts_us, pts_us AS last, true AS kept FROM o WHERE rn = 1
    UNION ALL SELECT o.user_id, o.rn, o.seq, o.pts_us, CASE WHEN o.pts_us < k.last OR o.pts_us - k.last >= {10 * HOUR} THEN o.pts_us ELSE k.last END,
      o.pts_us < k.last OR o.pts_us - k.last >= {10 * HOUR} FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1)
  SELECT user_id, seq, pts_us FROM k WHERE kept""")
def limit_fps(spark, d):
    return S.replay(V.packets(spark, d), lambda: S.LimitFps(10 * HOUR), key="user_id")


@query(f"""WITH {PKT}, v AS (SELECT *, first_value(pts_us) OVER (PARTITION BY user_id ORDER BY seq) AS t0, lead(pts_us) OVER (PARTITION BY user_id ORDER BY seq) AS nx FROM pkt),
  r AS (SELECT user_id, seq, t0, (pts_us - t0 + {6 * HOUR - 1}) // {6 * HOUR} AS lo, CASE WHEN nx IS NULL THEN (pts_us - t0 + {6 * HOUR - 1}) // {6 * HOUR} ELSE (nx - t0 + {6 * HOUR - 1}) // {6 * HOUR} - 1 END AS hi FROM v),
  x AS (SELECT user_id, seq, t0, unnest(range(lo, hi + 1)) AS tick FROM r)
  SELECT user_id::VARCHAR AS stream_id, tick, t0 + tick * {6 * HOUR} AS tick_us, seq FROM x""")
def force_fps_grid(spark, d):
    return FR.fps_grid(V.packets(spark, d).withColumn("stream_id", F.col("user_id").cast("string")), 6 * HOUR)


@query(f"""WITH RECURSIVE {PKT}, o AS (SELECT user_id, seq, pts_us, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM pkt),
  k AS (SELECT user_id, rn, seq, pts_us, pts_us AS last, pts_us + {HOUR} AS next, seq AS held, seq AS filler, 0::BIGINT AS fills, pts_us + {HOUR} AS from_us, true AS taken FROM o WHERE rn = 1
    UNION ALL SELECT user_id, rn, seq, pts_us, CASE WHEN taken THEN pts_us ELSE last END, CASE WHEN taken THEN pts_us + {HOUR} ELSE next + fills * {HOUR} END, seq, held, fills, next, taken
    FROM (SELECT *, NOT inside OR pts_us >= next + fills * {HOUR} AS taken FROM (SELECT *, CASE WHEN inside THEN greatest(0, (pts_us - next + {HOUR - 1}) // {HOUR}) ELSE 0 END AS fills
      FROM (SELECT o.user_id, o.rn, o.seq, o.pts_us, k.last, k.next, k.held, o.pts_us - k.last <> {HOUR} AND o.pts_us - k.last BETWEEN 0 AND {20 * HOUR} AS inside
        FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1))))
  SELECT user_id, filler AS seq, from_us + unnest(range(fills)) * {HOUR} AS pts_us, true AS duplicated FROM k UNION ALL SELECT user_id, seq, pts_us, false FROM k WHERE taken""")
def force_fps_exact(spark, d):
    return S.replay(V.packets(spark, d), lambda: S.ForceFps(HOUR, 20 * HOUR), key="user_id")


def _sentinel_sql(fill: str) -> str:
    filled = "ahead" if fill == "all" else "ahead AND k % 2 = 1"
    most = 1 << 40 if fill == "all" else 5
    return f"""WITH {REORDERED}, a AS (SELECT stream_id, seq, dts_ms * 1000 AS p FROM re),
      b AS (SELECT *, p - lag(p) OVER (PARTITION BY stream_id ORDER BY seq) AS dd FROM a),
      c AS (SELECT *, coalesce(abs(dd - {HOUR}) >= {HOUR}, false) AS jump, coalesce(abs(dd - {HOUR}) >= {HOUR} AND dd > {HOUR}, false) AS ahead FROM b),
      e AS (SELECT *, sum(CASE WHEN ahead THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) AS k FROM c),
      f AS (SELECT *, CASE WHEN {filled} THEN least({most}, -((-(dd - {HOUR})) // {HOUR} - CASE WHEN (dd - {HOUR}) % {HOUR} <> 0 THEN 1 ELSE 0 END)) ELSE 0 END AS fills FROM e)
      SELECT stream_id, seq, fills::BIGINT AS fills, sum(CASE WHEN dd IS NULL THEN 10000000 WHEN jump THEN (1 + fills) * {HOUR} ELSE dd END) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS out_us FROM f"""


@query(_sentinel_sql("exact"))
def sentinel_single(spark, d):
    return FR.sentinel(V.reordered(spark, d).withColumn("pts_us", F.col("dts_ms") * 1000), HOUR, HOUR).select("stream_id", "seq", "fills", "out_us")


@query(_sentinel_sql("all"))
def sentinel_fill_all(spark, d):
    return FR.sentinel(V.reordered(spark, d).withColumn("pts_us", F.col("dts_ms") * 1000), HOUR, HOUR, fill="all").select("stream_id", "seq", "fills", "out_us")


def _guarded(spark, d):
    """Runs of frames of a user's streams under one sentinel whose second is an hour."""
    model = lambda: S.SentinelRuns(HOUR, 10 * HOUR, timeout_us=4 * HOUR, freeze_us=6 * HOUR, wake_us=HOUR // 10, idle_us=8 * HOUR, recent_us=8 * HOUR)
    return S.replay(V.packets(spark, d), model, key="user_id", member="stream_id")


@query()
def sentinel_group(spark, d):
    return _guarded(spark, d).where("card = 'live'").select("user_id", F.col("stream").alias("stream_id"), "seq", "out_us", "shift_us")


@query()
def sentinel_stall(spark, d):
    return S.frames_of(_guarded(spark, d).where("card <> 'live'"), HOUR).select("user_id", F.col("stream").alias("stream_id"), "seq", "out_us", "card")


_JITTER = "({a} % 100 + CASE WHEN {b} % 8 = 0 THEN {c} % 600 ELSE 0 END) * 1000".format(**{x: f"('0x' || substr(md5(seq || '{x}'), 1, 6))::BIGINT" for x in "abc"})


@query(f"""WITH RECURSIVE {PKT}, o AS (SELECT user_id, seq, pts_us, arrival_us + {_JITTER} AS arr, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM pkt),
  k AS (SELECT user_id, rn, seq, 'resync' AS action, pts_us - arr AS offset_us FROM o WHERE rn = 1
    UNION ALL SELECT user_id, rn, seq, CASE WHEN ahead < -150000 THEN 'resync' WHEN ahead >= 400000 THEN 'discontinuity' WHEN ahead > 0 THEN 'wait' ELSE 'emit' END,
      CASE WHEN ahead < -150000 OR ahead >= 400000 THEN pts_us - arr ELSE offset_us END
    FROM (SELECT o.*, k.offset_us, o.pts_us - k.offset_us - o.arr AS ahead FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1))
  SELECT user_id, seq, action, offset_us FROM k""")
def realtime_classify(spark, d):
    got = S.replay(R.jittered(V.packets(spark, d)), lambda: S.Realtime(tolerance_us=150_000, discontinuity_us=400_000), key="user_id")
    return got.select("user_id", "seq", "action", "offset_us")


@query()
def sync_buffer_classify(spark, d):
    got = S.replay(V.packets(spark, d), lambda: S.SyncBuffer(2 * HOUR, HOUR, 10 * HOUR), key="user_id", member="stream_id")
    return got.select("user_id", F.col("stream").alias("stream_id"), "seq", "action", "out_us")


@query(f"""WITH {PKT}, n AS (SELECT stream_id, seq, media, pts_us, 48000 * 600 AS n_samples, 48000 AS sample_rate FROM pkt),
  b AS (SELECT max(t) AS least FROM (SELECT min_by(pts_us, seq) AS t FROM n WHERE media = 'A' GROUP BY stream_id)),
  s AS (SELECT min_by(pts_us, seq) AS start_us FROM n, b WHERE media = 'V' AND pts_us >= least),
  k AS (SELECT *, CASE WHEN media = 'A' THEN greatest(0, (start_us - pts_us) * sample_rate // 1000000) ELSE 0 END AS skip FROM n, s)
  SELECT stream_id, seq, skip FROM k WHERE media = 'V' AND pts_us >= start_us OR media = 'A' AND skip < n_samples""")
def raw_output_align(spark, d):
    items = V.packets(spark, d).withColumn("n_samples", F.lit(48000 * 600)).withColumn("sample_rate", F.lit(48000))
    return FR.raw_output_align(items).select("stream_id", "seq", F.col("skip").cast("long").alias("skip"))


@query(f"WITH {PKT} SELECT stream_id, min(seq) AS seq, min_by(pts_us, seq) AS pts_us FROM pkt WHERE media = 'V' GROUP BY stream_id")
def picture_buffer_once(spark, d):
    return FR.picture_buffer(V.video(spark, d)).select("stream_id", "seq", "pts_us")


@query(f"WITH {PKT}, e AS (SELECT stream_id, seq, pts_us, unnest(range(size % 3)) AS entry FROM pkt) SELECT stream_id, seq, pts_us, pts_us AS dts_us, entry, seq || '-' || entry AS payload FROM e")
def cc_explode(spark, d):
    data = F.expr("transform(slice(array(0, 1), 1, cast(size % 3 as int)), i -> struct('A53_CC' as type, concat(seq, '-', i) as data))")
    return FR.side_packets(V.packets(spark, d).withColumn("side_data", data), "A53_CC").withColumn("entry", F.col("entry").cast("long"))


@query(f"""WITH {AUD}, p AS (SELECT *, (row_number() OVER (PARTITION BY stream_id, channel ORDER BY seq) - 1) * 64 AS at0 FROM aud),
  s AS (SELECT stream_id, channel, at0 + unnest(range(64)) AS place, unnest(samples) AS x FROM p)
  SELECT stream_id, channel, place // 100 AS frame, count(*)::INT AS n_samples, round(sum(x), 6) AS total, round(min_by(x, place), 6) AS first FROM s GROUP BY ALL""")
def reframe_audio(spark, d):
    r = FR.reframe(V.audio(spark, d), 100)
    return r.select("stream_id", "channel", "frame", "n_samples", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("samples", 1), 6).alias("first"))


@query("SELECT vec_id AS seq, unnest([0, 1, 2]) AS channel, round(unnest([list_sum(embedding[1:32]::DOUBLE[]), list_sum(embedding[33:64]::DOUBLE[]), 0.0]), 5) AS total FROM embeddings")
def channel_pad(spark, d):
    two = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.expr("array(transform(slice(embedding, 1, 32), x -> cast(x as double)), transform(slice(embedding, 33, 32), x -> cast(x as double)))").alias("channels"))
    padded = FR.pad_channels(two, 3).select("seq", F.posexplode("channels").alias("channel", "s"))
    return padded.select("seq", "channel", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query()
def resample_drift(spark, d):
    """Frames of 1,024 samples at 48 kHz whose clock is a thousandth slow, then fast."""
    pts = F.expr("rank * 1024 * 1000000 div 48000 + abs(rank % 800 - 400) * 21")
    frames = V.packets(spark, d).where("media = 'A'").withColumn("rank", F.row_number().over(T.by_stream()).cast("long")).select("stream_id", "seq", pts.alias("pts_us"), F.lit(1024).alias("n_samples"))
    return S.replay(frames, lambda: S.AudioDrift(48000), arrival="n_samples")


@query(f"""WITH {AUD}, k AS (SELECT *, sum(n_samples) OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM aud),
  m AS (SELECT *, sum(n_samples) OVER (PARTITION BY stream_id ORDER BY seq) AS m FROM k WHERE n > 128),
  r AS (SELECT stream_id, round((sum(n_samples) - max_by(n_samples, seq)) * 1e6 / (max(pts_us) - min(pts_us)))::BIGINT AS raw FROM m WHERE m <= 1280 GROUP BY stream_id)
  SELECT stream_id, CASE WHEN raw > 47760 THEN 48000 ELSE raw END AS rate FROM r""")
def sample_rate_estimate(spark, d):
    return FR.estimate_rate(V.audio(spark, d), 128, 1280)


@query(f"WITH {PKT} SELECT stream_id, arrival_us // {HOUR} AS tick, min(seq) AS seq, min_by(pts_us, seq) AS pts_us, count(*) AS n_buffered FROM pkt WHERE media = 'V' GROUP BY ALL")
def tick_latest_frame(spark, d):
    return FR.first_of_tick(V.video(spark, d), HOUR)


_HIST = f"WINDOW w AS (PARTITION BY stream_id, session ORDER BY dts_us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)"


def _history(spark, d):
    return ST.history(V.packets(spark, d), 6 * HOUR, HOUR)


@query(f"WITH {SES}, h AS (SELECT stream_id, seq, sum(size) OVER w - min_by(size, seq) OVER w AS b, dts_us - min(dts_us) OVER w AS us FROM ses {_HIST}) SELECT stream_id, seq, CASE WHEN us > 0 THEN round(b * 8e6 / (us * 1024.0), 9) END AS kbitrate FROM h")
def stats_bitrate(spark, d):
    return _history(spark, d).select("stream_id", "seq", F.round("kbitrate", 9).alias("kbitrate"))


@query(f"WITH {SES}, h AS (SELECT stream_id, seq, count(*) OVER w AS n, dts_us - min(dts_us) OVER w AS us, count(*) OVER (PARTITION BY stream_id ORDER BY seq) AS frame_num FROM ses {_HIST}) SELECT stream_id, seq, frame_num, CASE WHEN us > 0 THEN round((n - 1) * 1e6 / us, 9) ELSE 0.0 END AS fps FROM h")
def stats_fps(spark, d):
    return _history(spark, d).select("stream_id", "seq", "frame_num", F.round("fps", 9).alias("fps"))


@query(f"WITH {SES}, h AS (SELECT stream_id, seq, dts_us - min(dts_us) OVER w AS us FROM ses {_HIST}) SELECT stream_id, seq, us AS duration_us FROM h")
def stats_duration(spark, d):
    return _history(spark, d).select("stream_id", "seq", "duration_us")


@query(f"""WITH {SES}, j AS (SELECT *, arrival_us + {_JITTER} AS arr FROM ses),
  h AS (SELECT stream_id, seq, max_by(dts_us, arr * 1000000 + seq) OVER w - min_by(dts_us, arr * 1000000 + seq) OVER w AS us, arr - min(arr) OVER w AS wall FROM (SELECT * REPLACE (arr::HUGEINT AS arr) FROM j)
    WINDOW w AS (PARTITION BY stream_id, session ORDER BY arr RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW))
  SELECT stream_id, seq, CASE WHEN wall <> 0 THEN round(us::DOUBLE / wall, 6) END AS speed FROM h""")
def stats_speed(spark, d):
    return ST.speed(R.jittered(V.packets(spark, d)), 6 * HOUR, HOUR).select("stream_id", "seq", F.round("speed", 6).alias("speed"))


@query(f"""WITH {SES}, g AS (SELECT stream_id, arrival_us // {24 * HOUR} AS report, session::BIGINT AS session, count(*) AS n, sum(size) - min_by(size, seq) AS b, max(dts_us) - min(dts_us) AS us FROM ses GROUP BY ALL)
  SELECT stream_id, report, session, us AS duration_us, CASE WHEN us > 0 THEN round(b * 8e6 / (us * 1024.0), 9) END AS kbitrate, CASE WHEN us > 0 THEN round((n - 1) * 1e6 / us, 9) ELSE 0.0 END AS fps FROM g""")
def stats_since_report(spark, d):
    got = ST.since_report(V.packets(spark, d), 24 * HOUR, HOUR)
    return got.select("stream_id", "report", "session", "duration_us", F.round("kbitrate", 9).alias("kbitrate"), F.round("fps", 9).alias("fps"))


_DESCRIPTORS = [("view", 0, "h264", "V", "progressive", 30000, 1001), ("click", 1, "hevc", "V", None, 25, 1), ("error", 2, "aac", "A", None, None, None), ("signup", 3, "klv", "D", None, None, 0), ("none", 4, "opus", "A", None, None, None)]


@query(f"""WITH {PKT}, f AS (SELECT stream_id, seq, CASE WHEN media = 'V' THEN 1280 + seq % 3 * 320 END AS width, CASE WHEN media = 'V' THEN 720 + seq % 3 * 180 END AS height, CASE WHEN media = 'V' THEN 'yuv420p' END AS pix_fmt,
    CASE WHEN media = 'A' THEN 44100 + seq % 2 * 3900 END AS samplerate_md, CASE WHEN media = 'A' THEN 'stereo' END AS channel_layout FROM pkt),
  l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) = 1),
  s(stream_id, index, codec, type, field_order, fps_md) AS (VALUES ('view', 0, 'h264', 'V', 'progressive', 30000 / 1001.0), ('click', 1, 'hevc', 'V', 'unknown', 25.0), ('error', 2, 'aac', 'A', NULL, NULL), ('signup', 3, 'klv', '?', NULL, NULL), ('none', 4, 'opus', 'A', NULL, NULL))
  SELECT stream_id, index, codec, type, field_order, round(fps_md::DOUBLE, 6) AS fps_md, width, height, pix_fmt, samplerate_md, channel_layout FROM s LEFT JOIN l USING (stream_id)""")
def stats_stream_info(spark, d):
    streams = spark.createDataFrame(_DESCRIPTORS, "stream_id string, index int, codec string, media string, field_order string, fps_num int, fps_den int")
    on = lambda m, e: F.when(F.col("media") == m, F.expr(e))
    frames = V.packets(spark, d).select("stream_id", "seq", on("V", "1280 + seq % 3 * 320").alias("width"), on("V", "720 + seq % 3 * 180").alias("height"), on("V", "'yuv420p'").alias("pix_fmt"), on("A", "44100 + seq % 2 * 3900").alias("sample_rate"), on("A", "'stereo'").alias("channel_layout"))
    return ST.stream_info(frames, streams).withColumn("fps_md", F.round("fps_md", 6))


@query(f"""WITH {PKT}, a AS (SELECT stream_id, seq, size * 1000 AS duration_us, sum(size * 1000) OVER (PARTITION BY stream_id ORDER BY seq) AS e FROM pkt WHERE media = 'A'),
  p AS (SELECT stream_id, seq, e, e - duration_us AS b FROM a)
  SELECT x.stream_id, x.seq, (x.e - min(CASE WHEN y.b >= x.e - 600000 THEN y.b ELSE x.e END))::BIGINT AS sound_us FROM p x JOIN p y ON x.stream_id = y.stream_id AND y.e <= x.e AND y.e >= x.e - 700000 GROUP BY x.stream_id, x.seq, x.e""")
def stats_sound_duration(spark, d):
    return ST.sound_duration(V.packets(spark, d).where("media = 'A'").withColumn("duration_us", F.col("size") * 1000), 600_000)


@query(f"""WITH {PKT}, f AS (SELECT stream_id, seq, 10000000 + seq * 40000 AS out_us, size % 3 = 0 AS on_card FROM pkt WHERE media = 'V'),
  c AS (SELECT *, coalesce(lag(on_card) OVER (PARTITION BY stream_id ORDER BY out_us), false) AS before FROM f)
  SELECT stream_id, max_by(on_card, out_us) AS card, coalesce(max(CASE WHEN on_card <> before THEN (out_us - 10000000) // 1000 END), 0) AS last_card_switch_ms FROM c GROUP BY stream_id""")
def stats_card(spark, d):
    frames = V.packets(spark, d).where("media = 'V'").select("stream_id", "seq", (F.col("seq") * 40_000 + 10_000_000).alias("out_us"), F.when(F.col("size") % 3 == 0, "freeze").otherwise("live").alias("card"))
    return ST.card_status(frames)


@query(f"WITH {PKT}, g AS (SELECT stream_id, (pts_us - lag(pts_us) OVER (PARTITION BY stream_id ORDER BY seq)) / {HOUR}.0 AS gap FROM pkt WHERE media = 'V') SELECT stream_id, coalesce(sum(CASE WHEN gap > 1.001 THEN floor(gap - 1) END), 0)::BIGINT AS dropped_frames FROM g GROUP BY stream_id")
def stats_dropped(spark, d):
    return ST.dropped_frames(V.video(spark, d), HOUR)


@query(f"WITH {AUD} SELECT stream_id, channel, CASE WHEN max(pts_us) > min(pts_us) THEN round((sum(n_samples) - min_by(n_samples, seq)) * 1e6 / (max(pts_us) - min(pts_us)), 3) END AS samplerate FROM aud GROUP BY ALL")
def stats_samplerate(spark, d):
    return ST.sample_rates(V.audio(spark, d))


_LEVELS = "count(*) AS n_samples, round(20 * log10(sqrt(sum(x * x) / count(*))), 6) AS rms_db, round(20 * log10(max(abs(x))), 6) AS peak_db"


@query(f"WITH {SMP} SELECT stream_id, {_LEVELS} FROM smp GROUP BY stream_id")
def stats_sound(spark, d):
    return ST.sound(V.audio(spark, d), ["stream_id"])


@query(f"WITH {SMP} SELECT stream_id, {BIN} AS bin, count(*) AS n FROM smp GROUP BY ALL")
def stats_histogram(spark, d):
    return ST.histogram(V.audio(spark, d), ["stream_id"])


@query(f"""WITH {SMP}, h AS (SELECT stream_id, {BIN} AS bin, count(*) AS n FROM smp GROUP BY ALL),
  m AS (SELECT stream_id, arg_max(bin, n * 100 - bin) AS modal_bin, sum(CASE WHEN bin = 16 THEN n ELSE 0 END)::BIGINT AS clipped_samples FROM h GROUP BY stream_id),
  t AS (SELECT stream_id, 20 * log10(sqrt(avg(x * x))) AS total FROM smp GROUP BY stream_id),
  c AS (SELECT stream_id, channel, 20 * log10(sqrt(avg(x * x))) AS own FROM smp GROUP BY ALL),
  a AS (SELECT stream_id, max(abs(own - total)) AS apart FROM c JOIN t USING (stream_id) GROUP BY stream_id)
  SELECT stream_id, modal_bin, clipped_samples, concat_ws(',', CASE WHEN clipped_samples > 0 THEN 'CLIPPED' END, CASE WHEN modal_bin >= 15 THEN 'SEVERELY_CLIPPED' END,
    CASE WHEN modal_bin = 0 THEN 'QUIET' END, CASE WHEN apart > 3 THEN 'IMBALANCE' END) AS problems FROM m JOIN a USING (stream_id)""")
def stats_problems(spark, d):
    return ST.problems(V.audio(spark, d))


@query(f"WITH {SMP} SELECT stream_id, channel, pts_us // 10000 AS report, {_LEVELS} FROM smp GROUP BY ALL")
def stats_channels_rt(spark, d):
    return ST.reports(V.audio(spark, d), 10_000)


_KEYS = [k.replace(".", "_") for k in ST.LOUDNESS]


@query(f"WITH {PKT}, l AS (SELECT stream_id, max_by(value, seq) AS v, max(seq) AS s FROM pkt GROUP BY stream_id) SELECT stream_id, {', '.join(f'CASE WHEN s % 2 = 0 THEN round(v * {i + 1}, 6) END AS {k}' for i, k in enumerate(_KEYS))} FROM l")
def stats_r128(spark, d):
    entry = lambda i, k: (F.lit(f"lavfi.r128.{k}"), (F.col("value") * (i + 1)).cast("string"))
    whole = F.create_map(*[x for i, k in enumerate(ST.LOUDNESS) for x in entry(i, k)])
    part = F.create_map(*[x for i, k in enumerate(ST.LOUDNESS[:-1]) for x in entry(i, k)])
    got = ST.loudness(V.packets(spark, d).withColumn("metadata", F.when(F.col("seq") % 2 == 0, whole).otherwise(part)))
    return got.select("stream_id", *[F.round(k, 6).alias(k) for k in _KEYS])


@query(f"""WITH {PKT}, p AS (SELECT stream_id, pts_us // {24 * HOUR} AS report, unnest([0, 1]) AS channel, unnest([size / 101.0, CASE WHEN seq % 3 = 0 THEN size / 202.0 END]) AS peak FROM pkt WHERE media = 'A')
  SELECT stream_id, report, channel, round(20 * log10(max(peak)), 6) AS true_peak_db FROM p GROUP BY stream_id, report, channel HAVING max(peak) IS NOT NULL""")
def stats_true_peaks(spark, d):
    key = lambda n: F.lit(f"lavfi.r128.true_peaks_ch{n}")
    one, two = (F.col("size") / 101).cast("string"), (F.col("size") / 202).cast("string")
    meta = F.when(F.col("seq") % 3 == 0, F.create_map(key(0), one, key(1), two, key(40), two)).otherwise(F.create_map(key(0), one))
    got = ST.true_peaks(V.packets(spark, d).where("media = 'A'").withColumn("metadata", meta), 24 * HOUR)
    return got.withColumn("true_peak_db", F.round("true_peak_db", 6))


@query(f"WITH {PKT} SELECT (SELECT max_by(dts_us, seq) FROM pkt WHERE stream_id = 'error') - (SELECT max_by(dts_us, seq) FROM pkt WHERE stream_id = 'click') AS av_diff_us")
def stats_av_diff(spark, d):
    return ST.av_diff(V.packets(spark, d), "error", "click")


@query(f"WITH {PKT} SELECT stream_id, arrival_us // {HOUR} AS report, count(*) AS packets, sum(size)::BIGINT AS bytes, (arrival_us // {HOUR} + 1) * {HOUR} - max(arrival_us) AS stalled_us FROM pkt GROUP BY stream_id, arrival_us // {HOUR}")
def stats_report(spark, d):
    return ST.report(V.packets(spark, d), HOUR)


@query(f"WITH {PKT} SELECT stream_id, count(*) AS n_items, 63 AS capacity, max_by(pts_us, seq) AS last_pts_us FROM pkt GROUP BY stream_id")
def queue_stats(spark, d):
    return R.queue_stats(V.packets(spark, d))


@query(f"""WITH RECURSIVE {PKT}, o AS (SELECT user_id, seq, pts_us, stream_id = 'click' AS video, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM pkt WHERE stream_id IN ('click', 'error')),
  k AS (SELECT user_id, rn, CASE WHEN video THEN seq END AS v, CASE WHEN NOT video THEN seq END AS a, CASE WHEN video THEN pts_us END AS vt, CASE WHEN NOT video THEN pts_us END AS au,
      NULL::BIGINT AS video_seq, NULL::BIGINT AS audio_seq, NULL::BIGINT AS offset_us FROM o WHERE rn = 1
    UNION ALL SELECT user_id, rn, CASE WHEN NOT near THEN v END, CASE WHEN NOT near THEN a END, CASE WHEN NOT near THEN vt END, CASE WHEN NOT near THEN au END, CASE WHEN near THEN v END, CASE WHEN near THEN a END, CASE WHEN near THEN au - vt END
    FROM (SELECT *, coalesce(abs(au - vt) <= {24 * HOUR}, false) AS near FROM (SELECT o.user_id, o.rn, CASE WHEN video THEN o.seq ELSE k.v END AS v, CASE WHEN video THEN k.a ELSE o.seq END AS a,
        CASE WHEN video THEN o.pts_us ELSE k.vt END AS vt, CASE WHEN video THEN k.au ELSE o.pts_us END AS au FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1)))
  SELECT user_id, video_seq, audio_seq, offset_us FROM k WHERE offset_us IS NOT NULL""")
def syncmeter(spark, d):
    triggers = V.packets(spark, d).where("stream_id in ('click', 'error')")
    return S.replay(triggers, lambda: S.SyncPairs("click", 24 * HOUR), key="user_id", member="stream_id")


@query(f"WITH {PKT} SELECT stream_id, seq, arrival_us + 250000 AS arrival_us FROM pkt")
def delaygen(spark, d):
    return R.delayed(V.packets(spark, d), 250_000).select("stream_id", "seq", "arrival_us")


_H = "('0x' || substr(md5(seq || '{}'), 1, 6))::BIGINT"


@query(f"WITH {PKT} SELECT stream_id, seq, arrival_us + ({_H.format('a')} % 100 + CASE WHEN {_H.format('b')} % 8 = 0 THEN {_H.format('c')} % 600 ELSE 0 END) * 1000 AS arrival_us FROM pkt")
def jittergen(spark, d):
    return R.jittered(V.packets(spark, d)).select("stream_id", "seq", "arrival_us")


REMUX = """
# a source, its streams, repaired times and one output
node.add {"name": "in", "type": "input", "url": "events", "dst": "all"}
node.add {"name": "dx", "type": "demux", "src": "all", "routing": {"v:0": "video", "a:0": "audio"}}
node.add {"name": "rv", "type": "packet_relay", "src": "video", "dst": "video2"}
node.add {"name": "mx", "type": "mux", "src": ["video2", "audio"], "dst": "muxed", "fix_timestamps": true}
node.add {"name": "written", "type": "output", "src": "muxed"}
stats.subscribe {"name": "rates", "max_age": 21600, "streams": {"video": [{"q_pre_dec": "video"}], "audio": [{"q_pre_dec": "audio"}]}}
group.start default
"""


@query(f"""WITH {SES}, h AS (SELECT stream_id, seq, size, dts_us, session FROM ses WHERE stream_id IN ('click', 'error')),
  k AS (SELECT stream_id, seq, sum(size) OVER w - min_by(size, seq) OVER w AS b, dts_us - min(dts_us) OVER w AS us, count(*) OVER (PARTITION BY stream_id ORDER BY seq) AS frame_num FROM h {_HIST})
  SELECT stream_id, seq, frame_num, CASE WHEN us > 0 THEN round(b * 8e6 / (us * 1024.0), 9) END AS kbitrate FROM k""")
def remux_with_statistics(spark, d):
    # statistics are subscribed before the mux, so they follow the times that packets came with and not the repaired ones
    edges = script(REMUX).bind({"events": V.packets(spark, d).withColumn("came_us", F.col("dts_us"))})
    return ST.history(edges["written"], 6 * HOUR, HOUR, "came_us").select("stream_id", "seq", "frame_num", F.round("kbitrate", 9).alias("kbitrate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
