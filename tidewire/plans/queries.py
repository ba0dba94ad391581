"""The registered queries of the signal operators over the driver's tables, and their SQL twins.

``events`` is a signal: ``event_id`` the sample index, ``event_type`` the channel, ``value`` the sample, a calendar day a
file. ``lineitem.l_orderkey`` are timestamps with duplicates and gaps, ``embeddings`` are waveforms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import design, formatting
from ..operators import alignment, catalog, channels, decimate, filtering, interpolate, segments, spikes, timestamps
from ..operators.ordered import with_index
from .filter_sql import aligned_sql, filtered_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Units of a bucket for orders that no key cuts; a production table has millions of rows in each.
WIDTH = 1 << 16


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("channel"), "value", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("user_id % 4 <> 0").withColumnRenamed("idx", "ts")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ts"), (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("packet"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.build(_events(spark, sf_dir), "day", "idx")


_E = "SELECT event_id AS idx, event_type AS channel, value, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events"
_G = f"SELECT idx AS ts, channel, value FROM ({_E}) WHERE user_id % 4 <> 0"
_F = f"SELECT day AS file_id, min(idx) AS start_ts, max(idx) AS stop_ts FROM ({_E}) GROUP BY day"
_K = "SELECT l_orderkey AS ts, l_linenumber * CAST(1000000000000 AS BIGINT) + l_partkey * 1000000 + l_suppkey AS packet FROM lineitem"


def _pretty_sql(source: str, key: str) -> str:
    """(key, text) of a source (key, x) in seconds."""
    return f"""
        WITH d AS (SELECT {key}, x < 0 AS neg, CAST(round_even(abs(x) * 10000, 0) AS BIGINT) AS t FROM ({source})),
        p AS (SELECT {key}, neg, t // 10000 // 86400 AS d, t // 10000 % 86400 // 3600 AS h, t // 10000 % 3600 // 60 AS m, t // 10000 % 60 AS s, t % 10000 AS f FROM d),
        q AS (SELECT *, CASE WHEN f = 0 THEN '' WHEN m = 0 THEN rtrim('.' || lpad(CAST(f AS VARCHAR), 4, '0'), '0') ELSE ':' || lpad(CAST(f // 10 AS VARCHAR), 3, '0') END AS r FROM p)
        SELECT {key}, CASE WHEN neg THEN '-' ELSE '' END || CASE WHEN d > 0 THEN d || ' days ' ELSE '' END ||
          CASE WHEN h > 0 THEN h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ':' || lpad(CAST(s AS VARCHAR), 2, '0') || r || ' hours'
               WHEN m > 0 THEN m || ':' || lpad(CAST(s AS VARCHAR), 2, '0') || r || ' minutes' WHEN s > 0 THEN s || r || ' seconds'
               ELSE printf('%.1f milliseconds', f / 10.0) END AS text FROM q
    """


# ---- catalogue

@query(f"SELECT file_id, start_ts, stop_ts FROM ({_F})")
def o19_catalogue(spark, sf_dir):
    return _files(spark, sf_dir)


@query(f"SELECT file_id, start_ts, stop_ts FROM ({_F}) WHERE file_id < '2024-01-11' UNION ALL SELECT file_id, start_ts, stop_ts FROM ({_F}) WHERE file_id >= '2024-01-11'")
def o19_add_files(spark, sf_dir):
    f = _files(spark, sf_dir)
    return catalog.add_files(f.where("file_id < '2024-01-11'"), f.where("file_id >= '2024-01-11'"))


@query(f"SELECT file_id, start_ts, stop_ts, row_number() OVER (ORDER BY start_ts, file_id) - 1 AS position FROM ({_F})")
def o20_sort_files(spark, sf_dir):
    return catalog.in_order(_files(spark, sf_dir))


@query(f"SELECT file_id, start_ts, stop_ts, start_ts / 30000.0 AS start_s, stop_ts / 30000.0 AS stop_s FROM ({_F})")
def o21_bounds(spark, sf_dir):
    return catalog.bounds(_files(spark, sf_dir))


@query(f"SELECT CAST(min(start_ts) AS DOUBLE) AS start, CAST(arg_max(stop_ts, start_ts) AS DOUBLE) AS stop, min(start_ts) / 30000.0 AS start_time, arg_max(stop_ts, start_ts) / 30000.0 AS stop_time FROM ({_F})")
def o22_extents(spark, sf_dir):
    return catalog.extents(_files(spark, sf_dir))


@query(f"SELECT file_id, (stop_ts - start_ts) / 30000.0 AS duration FROM ({_F})")
def o23_durations(spark, sf_dir):
    return catalog.durations(_files(spark, sf_dir))


@query(f"""
    WITH g AS (SELECT *, lead(start_ts) OVER (ORDER BY start_ts) - stop_ts AS gap FROM ({_F}))
    SELECT count(*) AS n_files, count(*) = 0 AS is_empty, round((arg_max(stop_ts, start_ts) - min(start_ts)) / 30000.0, 9) AS duration_w_gaps,
           round(sum(stop_ts - start_ts) / 30000.0, 9) AS duration_wo_gaps, round(sum(gap) / 30000.0, 9) AS inter_gap,
           '<file map: ' || count(*) || ' files> ' || (SELECT text FROM ({_pretty_sql(f"SELECT 1 AS one, sum(stop_ts - start_ts) / 30000.0 AS x FROM ({_F})", "one")})) AS repr FROM g
""")
def o24_summary(spark, sf_dir):
    s = catalog.summary(_files(spark, sf_dir))
    return s.select("n_files", "is_empty", *(F.round(c, 9).alias(c) for c in ("duration_w_gaps", "duration_wo_gaps", "inter_gap")), "repr")


@query(f"SELECT event_id AS idx, event_type AS channel, value FROM events WHERE event_id BETWEEN 100 AND 400")
def o29_request(spark, sf_dir):
    return catalog.request(_events(spark, sf_dir), 100, 400, "idx").select("idx", "channel", "value")


# ---- packets and channels

@query(f"SELECT idx AS packet_no, e.day AS file_id, f.start_ts, row_number() OVER (ORDER BY f.start_ts, idx) - 1 AS position FROM ({_E}) e JOIN ({_F}) f ON f.file_id = e.day")
def o07_stitch(spark, sf_dir):
    packets = _events(spark, sf_dir).select(F.col("idx").alias("packet_no"), F.col("day").alias("file_id"))
    return with_index(channels.stitch(packets, _files(spark, sf_dir)), "position", ["start_ts", "packet_no"], width=WIDTH)


_PACKETS = f"SELECT idx AS ts, idx AS packet_no, [CAST(trunc(value * 10) AS SMALLINT), CAST(user_id AS SMALLINT), CAST(trunc(-value) AS SMALLINT)] AS data FROM ({_E}) WHERE idx % 7 <> 0"


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("idx % 7 <> 0")
    short = lambda c: interpolate.to_int16(c.cast("double"))
    return e.select(F.col("idx").alias("ts"), F.col("idx").alias("packet_no"), F.array(short(F.col("value") * 10), short(F.col("user_id")), short(-F.col("value"))).alias("data"))


@query(f"""
    WITH p AS ({_PACKETS}), l AS (SELECT ts, 2 AS channel, data[3] AS value FROM p UNION ALL SELECT ts, 0, data[1] FROM p),
    n AS (SELECT *, lead(ts) OVER w AS t, lead(value) OVER w AS v FROM l WINDOW w AS (PARTITION BY channel ORDER BY ts)),
    g AS (SELECT *, unnest(range(ts + 1, CASE WHEN t - ts - 1 BETWEEN 1 AND 2 THEN t ELSE ts + 1 END)) AS x FROM n)
    SELECT channel, ts, value FROM l UNION ALL
    SELECT channel, x, CAST(trunc(value + CAST(v - value AS DOUBLE) * (x - ts) / (t - ts)) AS SMALLINT) FROM g
""")
def o13_extract_channels(spark, sf_dir):
    return channels.extract_channels(_packets(spark, sf_dir), channels=[2, 0], max_gap_size=2)


@query("SELECT user_id, 'p-ch.' || lpad(CAST(user_id % 32 AS VARCHAR), 2, '0') || '.raw' AS name FROM (SELECT DISTINCT user_id FROM events)")
def o14_channel_file_name(spark, sf_dir):
    users = _events(spark, sf_dir).select("user_id").distinct()
    return users.select("user_id", channels.channel_file_name(F.col("user_id") % 32, 32, "p-").alias("name"))


@query("SELECT vec_id, embedding[10] AS a, embedding[4] AS b, embedding[1] AS c FROM embeddings")
def o28_pick_channels(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", channels.pick_channels(F.col("embedding"), [9, 3, 0]).alias("x"))
    return e.select("vec_id", *(F.col("x")[i].alias(c) for i, c in enumerate("abc")))


@query("SELECT vec_id, CAST(i - 1 AS INT) AS channel, embedding[i] AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
def o28_to_long(spark, sf_dir):
    return channels.to_long(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")


# ---- timestamps

@query(f"SELECT ts, min(packet) AS packet FROM ({_K}) GROUP BY ts")
def o30_sanitise(spark, sf_dir):
    return timestamps.sanitise(_keys(spark, sf_dir), "ts", "packet")


@query(f"""
    WITH n AS (SELECT channel, value, value - lag(value) OVER (PARTITION BY channel ORDER BY idx) AS d FROM ({_E}))
    SELECT channel, bool_and(coalesce(d >= 0, true)) AS is_sorted, count(*) FILTER (d = 0) AS n_duplicates, count(*) FILTER (value <> floor(value)) AS n_not_integral,
           bool_and(coalesce(d >= 0, true)) AND count(*) FILTER (d = 0) = 0 AND count(*) FILTER (value <> floor(value)) = 0 AS ok FROM n GROUP BY channel
""")
def o32_check(spark, sf_dir):
    return timestamps.check(_events(spark, sf_dir), "value", ["idx"], ["channel"], width=WIDTH)


@query("SELECT l_returnflag, bool_and(l_quantity = floor(l_quantity)) AS all_integral FROM lineitem GROUP BY l_returnflag")
def o32a_integral(spark, sf_dir):
    return timestamps.all_integral(_table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@query(f"SELECT channel, bool_and(coalesce(value >= p, true)) AS is_sorted FROM (SELECT channel, value, lag(value) OVER (PARTITION BY channel ORDER BY idx) AS p FROM ({_E})) GROUP BY channel")
def o34_is_sorted(spark, sf_dir):
    return timestamps.is_sorted(_events(spark, sf_dir), "value", ["idx"], ["channel"], width=WIDTH)


@query("SELECT bool_and(coalesce(event_id >= p, true)) AS is_sorted FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS p FROM events)")
def o34_is_sorted_chunked(spark, sf_dir):
    return timestamps.is_sorted(_events(spark, sf_dir), "idx", ["idx"], width=WIDTH)


@query(f"SELECT channel, a, b FROM (SELECT channel, idx AS a, lead(idx) OVER (PARTITION BY channel ORDER BY idx) AS b FROM ({_E})) WHERE b IS NOT NULL")
def o35_pairwise(spark, sf_dir):
    return timestamps.pairwise(_events(spark, sf_dir), "idx", ["idx"], ["channel"], width=WIDTH)


@query("SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rank, c_custkey AS idx FROM customer")
def o36_argsort(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("value"), F.col("c_custkey").alias("idx"))
    return timestamps.argsort(c, "value", "idx", width=1000)


@query("SELECT count(*) > count(DISTINCT l_orderkey) AS has_duplicates FROM lineitem")
def o37_has_duplicates(spark, sf_dir):
    return timestamps.has_duplicates(_keys(spark, sf_dir), "ts")


@query(f"SELECT dup_index FROM (SELECT ts, row_number() OVER (ORDER BY ts, packet) - 1 AS dup_index, lag(ts) OVER (ORDER BY ts, packet) AS p FROM ({_K})) WHERE ts - p < 1")
def o38_duplicate_indices(spark, sf_dir):
    return timestamps.duplicate_indices(_keys(spark, sf_dir), "ts", ["ts", "packet"], width=WIDTH)


@query(f"SELECT DISTINCT ts - p AS diff FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS p FROM ({_K})) WHERE p IS NOT NULL")
def o44_distinct_differences(spark, sf_dir):
    return timestamps.distinct_differences(_keys(spark, sf_dir), "ts", ["ts"], width=WIDTH)


# ---- segments

def _segments_sql(source: str, keys: str, brk: str, step: int) -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    sel = f"{keys}, " if keys else ""
    grp = f"{keys}, g" if keys else "g"
    return f"""
        WITH n AS (SELECT {sel}ts, row_number() OVER ({by}ORDER BY ts) - 1 AS i, ts - lag(ts) OVER ({by}ORDER BY ts) AS d FROM ({source})),
        s AS (SELECT *, sum(CASE WHEN {brk} THEN 1 ELSE 0 END) OVER ({by}ORDER BY i) AS g FROM n)
        SELECT {sel}min(ts) AS start_ts, max(ts) + {step} AS stop_ts, min(i) AS start_idx, max(i) + 1 AS stop_idx FROM s GROUP BY {grp}
    """


_SEG = _segments_sql(_K, "", "d >= 2", 1)
_SEG_CH = _segments_sql(_G, "channel", "d >= 2", 1)


@query(_SEG)
def o39_segments(spark, sf_dir):
    return segments.segments(_keys(spark, sf_dir), "ts", width=WIDTH)


@query(_segments_sql(_G, "channel", "d >= 20", 10))
def o39_segments_step(spark, sf_dir):
    return segments.segments(_gappy(spark, sf_dir), "ts", 10, ["channel"], width=WIDTH)


@query(f"""
    WITH n AS (SELECT channel, ts, row_number() OVER w - 1 AS i, ts - lag(ts) OVER w AS d FROM ({_G}) WINDOW w AS (PARTITION BY channel ORDER BY ts)),
    m AS (SELECT channel, median(d) AS step FROM n GROUP BY channel),
    s AS (SELECT n.*, step, sum(CASE WHEN d >= 2 * step THEN 1 ELSE 0 END) OVER (PARTITION BY n.channel ORDER BY i) AS g FROM n JOIN m ON m.channel = n.channel)
    SELECT channel, min(ts) AS start_ts, CAST(trunc(max(ts) + any_value(step)) AS BIGINT) AS stop_ts, min(i) AS start_idx, max(i) + 1 AS stop_idx FROM s GROUP BY channel, g
""")
def o39_segments_median_step(spark, sf_dir):
    return segments.segments(_gappy(spark, sf_dir), "ts", None, ["channel"], width=WIDTH)


@query(_segments_sql(f"SELECT DISTINCT ts FROM ({_K})", "", "d <> 1", 1))
def o40_segments_strict(spark, sf_dir):
    return segments.segments(_keys(spark, sf_dir).select("ts").distinct(), "ts", width=WIDTH, strict=True)


@query(_SEG_CH)
def o41_segments_by_channel(spark, sf_dir):
    return segments.segments(_gappy(spark, sf_dir), "ts", 1, ["channel"], width=WIDTH)


@query(f"SELECT start_ts, start_idx, stop_ts, stop_idx - 1 AS stop_idx FROM ({_SEG})")
def o39_segments_inclusive(spark, sf_dir):
    return segments.inclusive_indices(segments.segments(_keys(spark, sf_dir), "ts", width=WIDTH))


@query(f"SELECT start_ts, gap FROM (SELECT start_ts, lead(start_ts) OVER (ORDER BY start_ts) - stop_ts AS gap FROM ({_SEG})) WHERE gap IS NOT NULL")
def o42_gap_lengths(spark, sf_dir):
    return segments.gap_lengths(segments.segments(_keys(spark, sf_dir), "ts", width=WIDTH))


@query(f"""
    SELECT channel, start_ts, CAST(stop - (stop_ts - start_ts) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
    FROM (SELECT *, sum(stop_ts - start_ts) OVER (PARTITION BY channel ORDER BY start_ts) AS stop FROM ({_SEG_CH}))
""")
def o43_index_epochs(spark, sf_dir):
    return segments.index_epochs(segments.segments(_gappy(spark, sf_dir), "ts", 1, ["channel"], width=WIDTH), ["channel"])


@query(f"SELECT start_ts, count(*) AS n FROM ({_K}) k JOIN ({_SEG}) s ON k.ts >= s.start_ts AND k.ts < s.stop_ts GROUP BY start_ts")
def o43_in_segment(spark, sf_dir):
    found = segments.segments(_keys(spark, sf_dir), "ts", width=WIDTH)
    return segments.in_segment(_keys(spark, sf_dir), found, "ts").groupBy("start_ts").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, round(i * 1.0 / 3, 9) AS x FROM region, (SELECT unnest(range(0, 3)) AS i)")
def o45_frange(spark, sf_dir):
    return _table(spark, sf_dir, "region").select("r_regionkey", F.explode(formatting.frange(0, 1, 0.3)).alias("x")).withColumn("x", F.round("x", 9))


# ---- interpolation

def _fill_sql(number: str, plain: str) -> str:
    return f"""
        WITH n AS (SELECT ts, value, lead(ts) OVER (ORDER BY ts) AS t, lead(value) OVER (ORDER BY ts) AS v FROM ({_G})),
        g AS (SELECT *, unnest(range(ts + 1, CASE WHEN t - ts - 1 BETWEEN 1 AND 2 THEN t ELSE ts + 1 END)) AS x FROM n)
        SELECT ts, {plain} AS value FROM n UNION ALL SELECT x, {number} FROM g
    """


_LINE = "value + (v - value) * (x - ts) / (t - ts)"


@query(_fill_sql(f"round({_LINE}, 6)", "round(value, 6)"))
def o33_fill_gaps(spark, sf_dir):
    filled = interpolate.fill_gaps(_gappy(spark, sf_dir), max_gap_size=2, width=WIDTH, as_int16=False)
    return filled.select("ts", F.round("value", 6).alias("value"))


@query(_fill_sql(f"CAST(trunc({_LINE}) AS SMALLINT)", "CAST(trunc(value) AS SMALLINT)"))
def o33_fill_gaps_int16(spark, sf_dir):
    return interpolate.fill_gaps(_gappy(spark, sf_dir), max_gap_size=2, width=WIDTH)


# ---- filters

def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("idx").alias("ts"), "value")


def _rounded(filtered: DataFrame) -> DataFrame:
    return filtered.select("ts", F.round("value", 6).alias("value"))


_V = "SELECT event_id AS ts, value FROM events"
_BAND = design.design(*design.edges(30000.0, 600.0, 6000.0))
_EPOCHS = [(0, 100), (150, 900)]


@query(filtered_sql(_V, design.design(*design.edges(1000.0, None, 40.0)), 4096, as_int16=False))
def o48_low_pass(spark, sf_dir):
    return _rounded(filtering.band_filter(_signal(spark, sf_dir), fs=1000.0, fh=40.0, width=WIDTH, as_int16=False, buffer_len=4096))


@query(filtered_sql(_V, design.design(*design.edges(1000.0, 40.0, None)), 4096, as_int16=False))
def o48_high_pass(spark, sf_dir):
    return _rounded(filtering.band_filter(_signal(spark, sf_dir), fs=1000.0, fl=40.0, width=WIDTH, as_int16=False, buffer_len=4096))


@query(filtered_sql(_V, _BAND, 8192))
def o49_band_pass(spark, sf_dir):
    return filtering.band_filter(_signal(spark, sf_dir), fs=30000.0, fl=600.0, fh=6000.0, width=WIDTH, buffer_len=8192)


@query(filtered_sql(_V, _BAND, epochs=_EPOCHS))
def o49_within_epochs(spark, sf_dir):
    found = spark.createDataFrame(_EPOCHS, "start_ts long, stop_ts long")
    return filtering.filter_segments(_signal(spark, sf_dir), _BAND, epochs=found, short="pass")


@query(filtered_sql(_V, _BAND, design.SPIKE.buffer_len, design.SPIKE.overlap_len))
def o50_spike_preset(spark, sf_dir):
    return filtering.preset_filter(_signal(spark, sf_dir), design.SPIKE, width=WIDTH)


@query(filtered_sql(_V, design.design(*design.edges(30000.0, None, 300.0)), design.LFP.buffer_len, design.LFP.overlap_len))
def o50_lfp_preset(spark, sf_dir):
    return filtering.preset_filter(_signal(spark, sf_dir), replace(design.LFP, fh=300.0), width=WIDTH)


@query(filtered_sql(_V, design.butter_band(300.0, 6000.0, 30000.0), 8192, as_int16=False))
def o51_butterworth(spark, sf_dir):
    return _rounded(filtering.butterworth(_signal(spark, sf_dir), width=WIDTH, buffer_len=8192))


@query(filtered_sql(f"SELECT row_number() OVER (ORDER BY ts) - 1 AS ts, value FROM ({_G})", design.design(*design.edges(1000.0, 5.0, 100.0), 1.0, kind="butter"), as_int16=False))
def o52_long_filter(spark, sf_dir):
    samples = with_index(_gappy(spark, sf_dir).select("ts", "value"), "n", ["ts"], width=WIDTH).select(F.col("n").alias("ts"), "value")
    return _rounded(filtering.band_filter(samples, fs=1000.0, fl=5.0, fh=100.0, gpass=1.0, kind="butter", width=WIDTH, as_int16=False))


def _response_sql() -> str:
    terms = []
    for s in _BAND:
        for b, sign in ((s[:3], "+"), (s[3:], "-")):
            c = [f"CAST({float(x)!r} AS DOUBLE)" for x in b]
            re, im = f"({c[0]} + {c[1]} * cos(w) + {c[2]} * cos(2 * w))", f"({c[1]} * sin(w) + {c[2]} * sin(2 * w))"
            terms.append(f"{sign} 10 * log10({re} * {re} + {im} * {im})")
    return f"SELECT k * 15000.0 / 64 AS frequency, round(0.0 {' '.join(terms)}, 4) AS magnitude_db FROM (SELECT k, k * pi() / 64 AS w FROM (SELECT unnest(range(1, 64)) AS k))"


@query(_response_sql())
def o53_frequency_response(spark, sf_dir):
    r = filtering.frequency_response(spark, _BAND, points=64).where("frequency > 0")
    return r.select("frequency", F.round("magnitude_db", 4).alias("magnitude_db"))


_PLACED = f"""
    WITH n AS (SELECT channel, ts, value, ts - lag(ts) OVER w AS d, lead(ts) OVER w - ts AS e FROM ({_G}) WINDOW w AS (PARTITION BY channel ORDER BY ts)),
    s AS (SELECT *, coalesce(d >= 2, true) AS first, coalesce(e >= 2, true) AS last FROM n),
    p AS (SELECT *, max(CASE WHEN first THEN ts END) OVER (PARTITION BY channel ORDER BY ts) AS a FROM s)
    SELECT channel, ts, value FROM p WHERE
"""


@query(f"{_PLACED} (ts - a) % 3 = 0")
def o54_decimate(spark, sf_dir):
    return decimate.decimate(_gappy(spark, sf_dir).select("channel", "ts", "value"), q=3, prefilter=False, keys=["channel"], width=WIDTH)


@query(f"SELECT ts, value FROM ({filtered_sql(_V, design.design(*design.edges(1000.0, None, 0.5 * 1000 / 10 / 1.4)), as_int16=False)}) WHERE ts % 10 = 0")
def o54_decimate_filtered(spark, sf_dir):
    return _rounded(decimate.decimate(_signal(spark, sf_dir), fs_in=1000.0, fs_out=100.0, width=WIDTH))


@query(f"{_PLACED} (ts - a) % 10 = 0 OR first OR last")
def o55_every_tenth(spark, sf_dir):
    return decimate.every_nth(_gappy(spark, sf_dir).select("channel", "ts", "value"), 10, keys=["channel"], width=WIDTH)


# ---- spikes

@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 0.125, 9) AS value FROM embeddings")
def o09_scale(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("raw"))
    return spikes.scale_raw(e).select("vec_id", F.round("value", 9).alias("value"))


@query(f"SELECT channel, round(4 * median(abs(value) / 0.6745), 6) AS threshold FROM ({_E}) GROUP BY channel")
def o56_threshold(spark, sf_dir):
    return spikes.threshold(_events(spark, sf_dir), keys=["channel"]).select("channel", F.round("threshold", 6).alias("threshold"))


def _cross_sql(test: str) -> str:
    return f"SELECT idx, x FROM (SELECT idx, x, lead(x) OVER (ORDER BY idx) AS y, lead(idx) OVER (ORDER BY idx) AS j FROM (SELECT idx, value - 60 AS x FROM ({_E}))) WHERE j = idx + 1 AND ({test})"


def _crossed(spark: SparkSession, sf_dir: str, polarity: str, t: float) -> DataFrame:
    s = _events(spark, sf_dir).select("idx", (F.col("value") - 60).alias("x"))
    return spikes.crossings(s, F.lit(t), polarity, "idx", "x", width=WIDTH)


@query(_cross_sql("x > 40 AND y > 40"))
def o57_crossings_pos(spark, sf_dir):
    return _crossed(spark, sf_dir, "pos", 40.0)


@query(_cross_sql("x < -40 AND y < -40"))
def o57_crossings_neg(spark, sf_dir):
    return _crossed(spark, sf_dir, "neg", 40.0)


@query(_cross_sql("(x < -40 AND y < -40) OR (x > 40 AND y > 40)"))
def o57_crossings_both(spark, sf_dir):
    return _crossed(spark, sf_dir, "both", 40.0)


_CENSOR = """
    WITH RECURSIVE e AS ({events}), k(t) AS (SELECT min(t) FROM e UNION ALL SELECT (SELECT min(e.t) FROM e WHERE e.t > k.t + {width}) FROM k WHERE k.t IS NOT NULL)
    SELECT t FROM k WHERE t IS NOT NULL
"""


@query(_CENSOR.format(events=f"SELECT idx AS t FROM ({_cross_sql('x > 0 AND y > 0')})", width=30))
def o58_censor(spark, sf_dir):
    return spikes.censor(_crossed(spark, sf_dir, "pos", 0.0).withColumnRenamed("idx", "t"), "t", 30, span=WIDTH)


def _patch_sql(peaks: str, half: int, size: int, order: str, out: str) -> str:
    """Rows (peak, peak_idx, s, v) of patches, their missing end as zeros."""
    return f"""
        p AS ({peaks}), v AS (SELECT idx AS i, CAST(value AS DOUBLE) AS v FROM ({_E})),
        c AS (SELECT peak, arg_min(i, ({order} v, i)) AS peak_idx FROM p JOIN v ON i >= greatest(peak - {half}, 0) AND i < peak + {half} GROUP BY peak),
        r AS (SELECT peak, peak_idx, list(v ORDER BY i) AS w FROM c JOIN v ON i >= greatest(peak_idx - {half}, 0) AND i < peak_idx + {half} GROUP BY peak, peak_idx),
        f AS (SELECT peak, peak_idx, s, coalesce(w[s + 1], 0.0) AS v FROM r, (SELECT unnest(range(0, {size})) AS s)) {out}
    """


@query("WITH " + _patch_sql("SELECT event_id AS peak FROM events", 5, 10, "", "SELECT peak, peak_idx, CAST(s AS INT) AS s, v FROM f"))
def o59_extract(spark, sf_dir):
    peaks = _events(spark, sf_dir).select(F.col("idx").alias("peak"))
    found = spikes.extract(_events(spark, sf_dir), peaks, 10)
    return found.select("peak", "peak_idx", F.posexplode("waveform").alias("s", "v"))


@query(
    "WITH RECURSIVE t AS (SELECT 1 * median(abs(value) / 0.6745) AS thr FROM events), "
    f"x AS (SELECT idx AS t FROM (SELECT idx, value, lead(value) OVER (ORDER BY idx) AS y FROM ({_E})), t WHERE value > thr AND y > thr), "
    "k(t) AS (SELECT min(t) FROM x UNION ALL SELECT (SELECT min(x.t) FROM x WHERE x.t > k.t + 30) FROM k WHERE k.t IS NOT NULL), "
    + _patch_sql("SELECT t AS peak FROM k WHERE t IS NOT NULL", 15, 30, "-", "SELECT CAST(peak_idx AS DOUBLE) AS times, CAST(s AS INT) AS s, v FROM f")
)
def o60_detect_spikes(spark, sf_dir):
    """The flagship: threshold, crossings, refractory period and patches of all events as one channel (positive here, as values are)."""
    found = spikes.detect_spikes(_events(spark, sf_dir).select("idx", "value"), 1, width=WIDTH, polarity="pos")
    return found.select("times", F.posexplode("spikes").alias("s", "v"))


_BY_CHANNEL = f"""
    WITH RECURSIVE v AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY idx) - 1 AS i, -value AS v FROM ({_E})),
    t AS (SELECT channel, 1.5 * median(abs(v) / 0.6745) AS thr FROM v GROUP BY channel),
    x AS (SELECT n.channel, i AS t FROM (SELECT channel, i, v, lead(v) OVER (PARTITION BY channel ORDER BY i) AS y FROM v) n JOIN t ON t.channel = n.channel WHERE v < -thr AND y < -thr),
    after AS (SELECT a.channel, a.t, min(b.t) AS next FROM x a JOIN x b ON b.channel = a.channel AND b.t > a.t + 30 GROUP BY ALL),
    k(channel, t) AS (SELECT channel, min(t) FROM x GROUP BY channel UNION ALL SELECT k.channel, after.next FROM k JOIN after ON after.channel = k.channel AND after.t = k.t),
    c AS (SELECT k.channel, k.t, arg_min(i, (v, i)) AS m FROM k JOIN v ON v.channel = k.channel AND i >= greatest(k.t - 15, 0) AND i < k.t + 15 GROUP BY ALL),
    r AS (SELECT c.channel, c.t, m, list(v ORDER BY i) AS w FROM c JOIN v ON v.channel = c.channel AND i >= greatest(m - 15, 0) AND i < m + 15 GROUP BY ALL)
    SELECT channel, CAST(m AS DOUBLE) AS times, CAST(s AS INT) AS s, coalesce(w[s + 1], 0.0) AS v FROM r, (SELECT unnest(range(0, 30)) AS s)
"""


@query(_BY_CHANNEL)
def o60_detect_by_channel(spark, sf_dir):
    samples = with_index(_events(spark, sf_dir), "n", ["idx"], ["channel"], width=WIDTH).select("channel", F.col("n").alias("idx"), (-F.col("value")).alias("value"))
    found = spikes.detect_spikes(samples, 1.5, keys=["channel"], width=WIDTH)
    return found.select("channel", "times", F.posexplode("spikes").alias("s", "v"))


_TETRODE = f"""
    WITH q AS (SELECT CAST(user_id % 4 AS INT) AS channel, row_number() OVER (PARTITION BY user_id % 4 ORDER BY idx) - 1 AS i, value AS v FROM ({_E})),
    p AS (SELECT i AS peak, c AS channel FROM (SELECT DISTINCT i FROM q), (SELECT unnest([0, 1, 2, 3]) AS c)),
    c AS (SELECT peak, p.channel, arg_min(i, (v, i)) AS m FROM p JOIN q ON q.channel = p.channel AND i >= greatest(peak - 4, 0) AND i < peak + 4 GROUP BY ALL),
    r AS (SELECT peak, c.channel, list(v ORDER BY i) AS w FROM c JOIN q ON q.channel = c.channel AND i >= greatest(m - 4, 0) AND i < m + 4 GROUP BY ALL),
    f AS (SELECT peak, channel, s, coalesce(w[s + 1], 0.0) AS v FROM r, (SELECT unnest(range(0, 8)) AS s)),
    g AS (SELECT peak FROM f GROUP BY peak HAVING max(v) < 300 AND min(v) > -300 AND count(DISTINCT channel) = 4)
    SELECT round(peak / 30000.0, 9) AS times, CAST(channel * 8 + s AS INT) AS s, v FROM f JOIN g USING (peak)
"""


@query(_TETRODE)
def o61_form_tetrode(spark, sf_dir):
    e = _events(spark, sf_dir).select((F.col("user_id") % 4).cast("int").alias("channel"), "idx", "value")
    samples = with_index(e, "n", ["idx"], ["channel"], width=WIDTH).select("channel", F.col("n").alias("idx"), "value")
    times = samples.select(F.col("idx").alias("time")).distinct()
    found = spikes.form_tetrode(samples, times, [0, 1, 2, 3], patch_size=8)
    return found.select(F.round("times", 9).alias("times"), F.posexplode("spikes").alias("s", "v"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 19 WHEN 2 THEN 23 ELSE 27 END AS first, CASE n_nationkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 24 WHEN 2 THEN 28 ELSE 32 END AS last FROM nation")
def o61a_tetrode_channels(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 4 + 1).alias("tetrode"))
    return spikes.tetrode_channels(n, "tetrode").select("n_nationkey", F.col("channels")[0].alias("first"), F.col("channels")[3].alias("last"))


@query(f"SELECT idx, round(avg(value) OVER (PARTITION BY day), 6) AS reference, round(value - avg(value) OVER (PARTITION BY day), 6) AS rereferenced FROM ({_E})")
def o61b_common_reference(spark, sf_dir):
    r = spikes.common_reference(_events(spark, sf_dir), by=["day"])
    return r.select("idx", F.round("reference", 6).alias("reference"), F.round("rereferenced", 6).alias("rereferenced"))


@query(f"SELECT channel, count(*) AS n, max(idx) AS last FROM ({_E}) GROUP BY channel")
def o61c_map_groups(spark, sf_dir):
    def summed(pdf):
        return pdf.groupby("channel", as_index=False).agg(n=("idx", "count"), last=("idx", "max"))

    return spikes.map_groups(_events(spark, sf_dir).select("channel", "idx"), ["channel"], summed, "channel string, n long, last long")


# ---- formatting and alignment

@query(_pretty_sql("SELECT o_orderkey, (o_totalprice - 100000) * 7 / 8 AS x FROM orders", "o_orderkey"))
def o62_pretty_duration(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", formatting.pretty_duration((F.col("o_totalprice") - 100000) * 7 / 8).alias("text"))


@query("SELECT o_orderkey, format('{:,}', CAST(o_custkey * 98765 AS BIGINT)) AS text FROM orders")
def o62a_pretty_int(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", formatting.pretty_int(F.col("o_custkey") * 98765).alias("text"))


@query("""
    SELECT o_orderkey, CASE WHEN x < 1024 THEN x || ' bytes' WHEN x < 1048576 THEN printf('%.3f kilobytes', x / 1024.0) WHEN x < 1073741824 THEN printf('%.3f megabytes', x / 1048576.0)
      WHEN x < 1099511627776 THEN printf('%.3f gigabytes', x / 1073741824.0) ELSE printf('%.3f terabytes', x / 1099511627776.0) END AS text
    FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * o_custkey AS x FROM orders)
""")
def o62b_pretty_bytes(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumn("x", F.col("o_orderkey").cast("decimal(38,0)") * F.col("o_orderkey") * F.col("o_custkey"))
    return o.select("o_orderkey", formatting.pretty_bytes(F.col("x")).alias("text"))


_MAXIMA = "SELECT idx, l, m, r FROM (SELECT event_id AS idx, lag(value) OVER w AS l, value AS m, lead(value) OVER w AS r FROM events WINDOW w AS (ORDER BY event_id)) WHERE m > l AND m > r"


def _maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import with_neighbour

    s = _events(spark, sf_dir).select("idx", F.col("value").alias("m"))
    s = with_neighbour(with_neighbour(s, {"l": "m"}, ["idx"], width=WIDTH), {"r": "m"}, ["idx"], width=WIDTH, back=False)
    return s.where("m > l and m > r")


@query(f"SELECT idx, round((l + r - 2 * m) / 2, 6) AS a, round((r - l) / 2, 6) AS b, round(m, 6) AS c FROM ({_MAXIMA})")
def o63_parabola(spark, sf_dir):
    a, b, c = alignment.parabola([F.lit(-1.0), F.lit(0.0), F.lit(1.0)], [F.col("l"), F.col("m"), F.col("r")])
    return _maxima(spark, sf_dir).select("idx", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(c, 6).alias("c"))


@query(f"SELECT idx, round(idx - 0.5 * (r - l) / (r - 2 * m + l), 6) AS peak FROM ({_MAXIMA})")
def o64_vertex(spark, sf_dir):
    return _maxima(spark, sf_dir).select("idx", F.round(alignment.peak_vertex(F.col("idx"), F.col("l"), F.col("m"), F.col("r")), 6).alias("peak"))


@query("""
    SELECT vec_id, CAST(k + 3 AS INT) AS s, round(CAST(embedding[20 + k + 1] AS DOUBLE) + (CAST(embedding[20 + k + 2] AS DOUBLE) - embedding[20 + k + 1]) * 0.25, 6) AS v
    FROM embeddings, (SELECT unnest(range(-3, 5)) AS k)
""")
def o65_resample_linear(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    return e.select("vec_id", F.posexplode(alignment.resample_linear(F.col("w"), F.lit(20.25), 3, 5)).alias("s", "v")).withColumn("v", F.round("v", 6))


@query(aligned_sql(16, 4, 5, 9))
def o66_align(spark, sf_dir):
    """Embeddings as 16 samples of four channels, aligned by cubic splines."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    aligned = alignment.align_waveforms(e, "embedding", "aligned", channels=4, before=5, after=9).select("vec_id", F.posexplode("aligned").alias("s", "row"))
    return aligned.select("vec_id", "s", F.posexplode("row").alias("ch", "v")).withColumn("v", F.round(F.col("v").cast("double"), 4) + 0.0)
