"""Examples and properties of the signal operators."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import design, formatting
from tidewire.functions.zero_phase import forward, pad_length, zero_phase
from tidewire.operators import alignment, catalog, decimate, filtering, interpolate, segments, spikes, timestamps
from tidewire.operators.ordered import with_index, with_latest, with_neighbour


def frame(spark, ts, **more):
    return spark.createDataFrame(pd.DataFrame({"ts": np.array(ts, np.int64), **more}), ", ".join(["ts long", *(f"{k} {'long' if np.asarray(v).dtype.kind == 'i' else 'double'}" for k, v in more.items())]))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_segments_examples(spark):
    found = segments.segments(frame(spark, [1, 2, 3, 4, 10, 11, 12]), "ts")
    assert rows(found, "start_ts", "stop_ts", "start_idx", "stop_idx") == [(1, 5, 0, 4), (10, 13, 4, 7)]
    assert rows(segments.gap_lengths(found), "gap") == [(5,)]
    assert segments.segments(frame(spark, []), "ts").count() == 0
    assert rows(segments.segments(frame(spark, [7]), "ts"), "start_ts", "stop_ts") == [(7, 8)]
    assert rows(segments.segments(frame(spark, [1, 2, 2, 3]), "ts", strict=True), "start_ts", "stop_ts", "start_idx") == [(1, 3, 0), (2, 4, 2)]


def test_duplicates_and_pairs_examples(spark):
    assert rows(timestamps.duplicate_indices(frame(spark, [0, 1, 2, 10, 11, 11, 11, 12]), "ts", ["ts"]), "dup_index") == [(5,), (6,)]
    values = frame(spark, [0, 1, 2, 3, 4], v=[2, 3, 6, 8, 7])
    assert rows(timestamps.pairwise(values, "v", ["ts"], width=2), "a", "b") == [(2, 3), (3, 6), (6, 8), (8, 7)]
    assert not timestamps.is_sorted(values, "v", ["ts"]).first()[0]
    assert timestamps.is_sorted(frame(spark, []), "ts", ["ts"]).first()[0]
    assert not timestamps.has_duplicates(frame(spark, [1, 2]), "ts").first()[0]


@pytest.mark.parametrize(("values", "ok"), [(["1", "2", "9.0", "65"], True), (["1", "a"], False), (["1.5"], False), ([None], False)])
def test_integral(spark, values, ok):
    assert timestamps.all_integral(spark.createDataFrame([(v,) for v in values], "x string"), "x").first()[0] is ok


def test_sanitise_keeps_first_packet(spark):
    df = spark.createDataFrame([(5, 2, "b"), (5, 1, "a"), (6, 3, "c"), (None, 4, "d")], "ts long, packet long, v string")
    assert rows(timestamps.sanitise(df, "ts", "packet"), "ts", "packet", "v") == [(5, 1, "a"), (6, 3, "c")]


def test_censor_example(spark):
    df = frame(spark, [110, 111, 112, 120, 270, 271, 280])
    assert rows(spikes.censor(df, "ts"), "ts") == [(110,), (270,)]
    assert spikes.censor(frame(spark, []), "ts").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.sets(st.integers(-200, 1500), max_size=120), st.integers(0, 60), st.integers(1, 400))
def test_censor_is_the_greedy_fold(spark, times, width, span):
    kept = []
    for t in sorted(times):
        if not kept or t > kept[-1] + width:
            kept.append(t)
    assert [r[0] for r in rows(spikes.censor(frame(spark, sorted(times)), "ts", width, span=span), "ts")] == kept


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 500), max_size=60), st.integers(1, 90))
def test_buckets_change_nothing(spark, ts, width):
    df = frame(spark, ts, n=np.arange(len(ts)))
    order = ["ts", "n"]
    for make in (
        lambda w: with_neighbour(df, {"p": "n"}, order, width=w),
        lambda w: with_neighbour(df, {"p": "n"}, order, width=w, back=False),
        lambda w: with_latest(df, "p", F.when(F.col("n") % 3 == 0, F.col("n")), order, width=w),
        lambda w: with_index(df, "p", order, width=w),
    ):
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, make(None).select("ts", "n", "p").collect()), key=key) == sorted(map(tuple, make(width).select("ts", "n", "p").collect()), key=key)


def test_fill_gaps(spark):
    ts = [0, 1, 3, 6, 207, 409]
    df = frame(spark, ts, value=np.array([0.0, -10.0, -15.0, 0.0, 201.0, -5.0]))
    filled = dict(rows(interpolate.fill_gaps(df, max_gap_size=200, width=64), "ts", "value"))
    assert sorted(filled) == [*range(0, 208), 409]
    assert filled[2] == -12 and filled[4] == -10 and filled[106] == 100
    assert rows(interpolate.fill_gaps(interpolate.fill_gaps(df, max_gap_size=200), max_gap_size=200), "ts", "value") == sorted(filled.items())
    assert len(rows(interpolate.fill_gaps(df, max_gap_size=0), "ts")) == 6
    assert rows(interpolate.fill_gaps(frame(spark, [0], value=np.array([1e6]))), "value") == [(32767,)]


def test_crossings_drop_lone_samples_and_gaps(spark):
    df = frame(spark, [0, 1, 2, 3, 4, 6, 7], value=np.array([0.0, 9, 0, 9, 9, 9, 0])).withColumnRenamed("ts", "idx")
    assert rows(spikes.crossings(df, F.lit(5.0)), "idx") == [(3,)]
    assert rows(spikes.crossings(df, F.lit(5.0), adjacent=False), "idx") == [(3,), (4,)]
    with pytest.raises(ValueError):
        spikes.crossings(df, F.lit(5.0), "up")


def _extract(x, peak, size, offset):
    half = size // 2
    start = max(peak - half, 0)
    at = start + int(np.argmin(x[start : peak + half]))
    patch = x[max(at + offset - half, 0) : at + offset + half]
    return at, np.pad(patch, (0, size - len(patch)))


@pytest.mark.parametrize(("size", "offset"), [(10, 0), (7, 2)])
def test_extract(spark, size, offset):
    x = np.random.default_rng(3).normal(size=200)
    peaks = [0, 3, 50, 51, 120, 198, 199]
    df = frame(spark, range(200), value=x).withColumnRenamed("ts", "idx")
    got = {r["peak"]: r for r in spikes.extract(df, frame(spark, peaks).withColumnRenamed("ts", "peak"), size, offset, bucket=16).collect()}
    for p in peaks:
        at, patch = _extract(x, p, size, offset)
        assert got[p]["peak_idx"] == at
        np.testing.assert_allclose(got[p]["waveform"], patch)


def test_detect_finds_planted_spikes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    for p in (300, 310, 1000, 1040, 2000):
        x[p : p + 3] -= [20, 30, 15]
    x[3000] = -40  # alone: not reported
    df = frame(spark, range(4000), value=x).withColumnRenamed("ts", "idx")
    found = sorted(r["times"] for r in spikes.detect_spikes(df, 6, width=500).collect())
    assert found == [301, 1001, 1041, 2001]


def test_unknown_tetrode_raises(spark):
    with pytest.raises(Exception, match="no tetrode"):
        spikes.tetrode_channels(frame(spark, [9]), "ts").collect()


@pytest.mark.parametrize(("fl", "fh"), [(600, 6000), (7, 9), (None, 500), (600, None)])
@pytest.mark.parametrize("kind", design.KINDS)
def test_design_meets_its_losses(fl, fh, kind):
    wp, ws, band = design.edges(30000, fl, fh)
    sos = design.design(wp, ws, band, kind=kind)
    loss = lambda w: 20 * np.log10(np.abs(design.response(sos, np.pi * np.array(w))))
    assert np.all(loss(wp) > -0.1001) and np.all(loss(ws) < -29.999)


def test_design_errors():
    for fl, fh in ((None, None), (None, 12000), (0, float("inf"))):
        with pytest.raises(ValueError):
            design.edges(30000, fl, fh)
    with pytest.raises(ValueError):
        design.design([0.1], [0.2], "low", kind="bessel")


def test_forward_equals_scalar_recursion():
    sos = design.design(*design.edges(30000, 600, 6000))
    x = np.random.default_rng(0).normal(size=500)
    y = x
    for s in sos:
        out, s1, s2 = [], 0.0, 0.0
        for v in y:
            u = s[0] * v + s1
            s1, s2 = s[1] * v - s[4] * u + s2, s[2] * v - s[5] * u
            out.append(u)
        y = np.array(out)
    np.testing.assert_allclose(forward(sos, x), y, atol=1e-10)


def test_zero_phase_keeps_the_band_in_place():
    t = np.arange(30000) / 30000
    wave = np.sin(2 * np.pi * 2000 * t)
    y = zero_phase(design.design(*design.edges(30000, 600, 6000)), wave + np.sin(2 * np.pi * 100 * t))
    assert np.abs(y - wave)[2000:-2000].max() < 0.02


def test_chunks_equal_the_whole_and_epochs_are_apart(spark):
    sos = design.design(*design.edges(1000, None, 100))
    rng = np.random.default_rng(2)
    ts = np.concatenate([np.arange(0, 3000), np.arange(3500, 5000)])
    x = rng.normal(size=len(ts)) * 100
    run = lambda v, b: dict(rows(filtering.filter_segments(frame(spark, ts, value=v), sos, buffer_len=b, width=1000, as_int16=False), "ts", "value"))
    got = run(x, 400)
    want = np.concatenate([zero_phase(sos, x[:3000]), zero_phase(sos, x[3000:])])
    np.testing.assert_allclose([got[t] for t in ts], want, atol=1e-3)
    other = x.copy()
    other[3000:] += 50
    again = run(other, 400)
    assert all(again[t] == got[t] for t in range(3000))
    with pytest.raises(Exception, match="padding"):
        filtering.filter_segments(frame(spark, range(5), value=x[:5]), sos).collect()
    assert filtering.filter_segments(frame(spark, range(5), value=x[:5]), sos, short="pass").count() == 5
    assert pad_length(sos) > 5


def test_decimate(spark):
    assert decimate.factor(1000, 100) == 10 and decimate.factor(q=3) == 3 and decimate.factor(1000, q=4) == 4
    for bad in ({}, {"fs_in": 10.0}, {"fs_in": 10.0, "fs_out": 3.0}, {"fs_out": 3.0, "q": 2}, {"q": 0}):
        with pytest.raises(ValueError):
            decimate.factor(**bad)
    df = frame(spark, [*range(0, 25), *range(40, 45)])
    assert [r[0] for r in rows(decimate.every_nth(df, 10), "ts")] == [0, 10, 20, 24, 40, 44]
    assert [r[0] for r in rows(decimate.every_nth(df, 10, ends=False, width=7), "ts")] == [0, 10, 20, 40]


def test_parabola_example(spark):
    x, y = [F.lit(float(v)) for v in (17, 18, 19)], [F.lit(float(v)) for v in (62, 65, 64)]
    a, b, c = alignment.parabola(x, y)
    got = spark.range(1).select(a, b, c, alignment.vertex(a, b)).first()
    np.testing.assert_allclose(got, [-2, 73, -601, 18.25])


def test_spline_and_align(spark):
    w = np.random.default_rng(5).normal(size=(40, 4))
    c = alignment.spline_coefficients(w)
    np.testing.assert_allclose(alignment.spline_values(c, np.arange(40.0)), w, atol=1e-9)
    t = np.arange(40)[:, None]
    bump = np.exp(-((t - 17.3) ** 2) / 18) * np.array([1, 5, 2, 0.5])
    out = alignment.align(bump)
    assert out.shape == (40, 4) and out.dtype == np.float32
    assert abs(np.exp(0) * 5 - out[17, 1]) < 0.01
    assert alignment.align(bump, pad=True, kind="linear", before=10, after=10).shape == (20, 4)
    with pytest.raises(ValueError):
        alignment.align(bump, kind="linear")
    with pytest.raises(ValueError):
        alignment.align(bump, place=3)
    df = spark.createDataFrame([(bump.tolist(),), (None,)], "waveform array<array<double>>")
    got = [r["aligned"] for r in alignment.align_waveforms(df).collect()]
    np.testing.assert_allclose(got[0], out, atol=1e-6)
    assert got[1] is None


@pytest.mark.parametrize(
    ("seconds", "text"),
    [
        (0.0, "0.0 milliseconds"), (0.0123, "12.3 milliseconds"), (5.5, "5.5 seconds"), (65.25, "1:05:250 minutes"), (3600.5, "1:00:00.5 hours"),
        (3661.5, "1:01:01:500 hours"), (90000.0, "1 days 1:00:00 hours"), (-5.0, "-5 seconds"), (float("inf"), "inf"), (5.99999, "6 seconds"),
    ],
)
def test_pretty_duration(spark, seconds, text):
    assert spark.createDataFrame([(seconds,)], "x double").select(formatting.pretty_duration(F.col("x"))).first()[0] == text


def _plain_bytes(x):
    for power, name in ((4, "terabytes"), (3, "gigabytes"), (2, "megabytes"), (1, "kilobytes")):
        if x >= 1024**power:
            return f"{x / 1024**power:.3f} {name}"
    return f"{x} bytes"


def test_pretty_bytes(spark):
    around = [1024**p + d for p in (1, 2, 3, 4) for d in (-1, 0, 1, 64 * 1024 ** (p - 1), 192 * 1024 ** (p - 1))]  # 1.0625 and 1.1875 are ties
    long = [0, 1, -5, 2**53 + 1, 2**63 - 1, *around]
    rng = np.random.default_rng(3)
    long += [int(v) for v in rng.integers(0, 2**62, 300) >> rng.integers(0, 60, 300)]
    wide = [2**63, 16074268601017109200, 19357788257787573334, 41688560875164175170, 2**92 + 2**39, 2**104 + 2**60, 123456789 * 10**29, 10**38 - 1, -(10**30), *long]
    for kind, values in (("long", long), ("decimal(38,0)", wide)):
        df = spark.createDataFrame([(str(x),) for x in values], "x string").select("x", formatting.pretty_bytes(F.col("x").cast(kind)).alias("text"))
        assert {int(r["x"]): r["text"] for r in df.collect()} == {x: _plain_bytes(x) for x in values}
    odd = spark.createDataFrame([(None,), (1536.5,), (float("inf"),), (2.0**1000,)], "x double").select(formatting.pretty_bytes(F.col("x"))).collect()
    assert [r[0] for r in odd[:3]] == [None, "1.500 kilobytes", "Infinity terabytes"] and odd[3][0].endswith(" terabytes")


def test_pretty_bytes_of_large_orders(spark, tmp_path):
    from tidewire.plans.queries import QUERIES

    keys = [(0, 5), (3, 100), (149_999, 14_999), (5_443_780, 542_437), (8_999_999, 899_999), (10**12, 10**11), (None, 7), (7, None)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["o_orderkey"], r["text"]) for r in QUERIES["o62b_pretty_bytes"](spark, str(tmp_path)).collect()}  # the product of 8,999,999 and 899,999 is beyond a long
    assert got == {(k, None if k is None or c is None else _plain_bytes(k * k * c)) for k, c in keys}


def test_frange(spark):
    np.testing.assert_allclose(spark.range(1).select(formatting.frange(0, 1, 0.3)).first()[0], [0, 1 / 3, 2 / 3])
    assert spark.range(1).select(formatting.frange(0, 0, 1)).first()[0] == []


def test_catalogue(spark):
    empty = spark.createDataFrame([], "file_id int, start_ts long, stop_ts long")
    assert catalog.extents(empty).first()["start"] == float("inf") and catalog.summary(empty).first()["is_empty"]
    files = spark.createDataFrame([(1, 100, 200), (0, 0, 90), (2, 250, 300)], "file_id int, start_ts long, stop_ts long")
    s = catalog.summary(files, 10).first()
    assert (s["n_files"], s["duration_w_gaps"], s["duration_wo_gaps"], s["inter_gap"]) == (3, 30.0, 24.0, 6.0)
    assert [r["file_id"] for r in catalog.in_order(files).collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="stops before"):
        catalog.add_files(empty, spark.createDataFrame([(1, 5, 2)], "file_id int, start_ts long, stop_ts long")).collect()
    df = frame(spark, range(10))
    assert catalog.request(df, 2, 4).count() == 3
    for a, b in ((4, 2), (-1, 3), (5, 99)):
        with pytest.raises(ValueError):
            catalog.request(df, a, b)


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_exact_median(spark, most):
    import numpy as np

    from tidewire.operators.medians import exact_median

    rng = np.random.default_rng(5)
    values = {"one": [3.5], "two": [1.0, 4.0], "same": [2.0] * 99, "ties": [1.0] * 50 + [2.0] * 50, "big": rng.normal(size=5001).tolist(), "even": (rng.normal(size=4000) * 1e-3).tolist(), "wide": (10.0 ** rng.uniform(-9, 9, 3001)).tolist(), "near": [1 + i * 2.0**-52 for i in range(200)]}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x] + [("one", None), ("none", None), ("two", float("nan"))], "k string, v double")
    assert {r["k"]: r["median"] for r in exact_median(df, "v", ["k"], most=most).collect()} == {k: float(np.median(x)) for k, x in values.items()}
    everything = sum(values.values(), [])
    assert exact_median(df, "v", most=most).collect()[0]["median"] == float(np.median(everything))
    assert [r["median"] for r in exact_median(df.where("false"), "v").collect()] == [None]


def test_width_is_chosen(spark, monkeypatch):
    """Without a width, orders of many rows are cut into buckets, and results are those of plain windows."""
    from tidewire.operators import ordered

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(c), int(t)) for c in range(3) for t in rng.choice(5000, 400, replace=False)], "c int, t long")
    want = [f(df).orderBy("c", "t").collect() for f in (lambda x: with_neighbour(x, {"p": "t"}, ["t"], ["c"]), lambda x: with_index(x, "n", ["t"], ["c"]), lambda x: with_latest(x, "l", F.when(F.col("t") % 7 == 0, F.col("t")), ["t"], ["c"]))]
    assert ordered.width_for(df, "t", None, ["c"]) is None
    monkeypatch.setattr(ordered, "ROWS", 50)
    assert 400 <= ordered.width_for(df, "t", None, ["c"]) <= 700
    got = [f(df).orderBy("c", "t").collect() for f in (lambda x: with_neighbour(x, {"p": "t"}, ["t"], ["c"]), lambda x: with_index(x, "n", ["t"], ["c"]), lambda x: with_latest(x, "l", F.when(F.col("t") % 7 == 0, F.col("t")), ["t"], ["c"]))]
    assert got == want


@pytest.mark.parametrize("span", [None, 1, 40, 1000])
def test_censor_across_buckets(spark, span):
    """Dense and sparse events, whole and fractional times: the greedy rule, however the order is cut."""
    rng = np.random.default_rng(7)
    events = {0: np.arange(0, 900), 1: rng.choice(100_000, 300, replace=False), 2: np.sort(rng.choice(3000, 1500, replace=False)), 3: np.array([5]), 4: np.concatenate([np.arange(0, 50, 31), np.arange(1000, 1100)])}
    want = set()
    for c, x in events.items():
        last = None
        for t in sorted(x.tolist()):
            if last is None or t > last + 30:
                want.add((c, t))
                last = t
    rows = [(c, int(t)) for c, x in events.items() for t in x] + [(0, 7), (1, None)]
    df = spark.createDataFrame(rows, "c int, t long")
    assert {tuple(r) for r in spikes.censor(df, "t", 30, ["c"], span).collect()} == want
    half = df.select("c", (F.col("t") / 2).alias("t"))
    assert {(r["c"], int(r["t"] * 2)) for r in spikes.censor(half, "t", 15, ["c"], span).collect()} == want
    assert {r["t"] for r in spikes.censor(df.where("c = 2"), "t", 30, None, span).collect()} == {t for c, t in want if c == 2}
    assert spikes.censor(df.where("false"), "t", 30, ["c"], span).count() == 0
