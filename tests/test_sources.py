"""Recordings and raw files, written by the tests and read back; streams over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import catalog, channels
from tidewire.sources.raw import read_raw, read_spike_matrix, read_spikes, write_raw, write_spikes
from tidewire.sources.rec import RecFormat, catalogue_of, read_rec
from tidewire.streaming.recordings import censor_stream, fill_stream


def write_rec(path, ts, data, order, tail=b"", hardware=True, end=True):
    n = data.shape[1]
    spikes = "".join(f'<SpikeChannel hwChan="{c}"/>\n' for c in order)
    text = f'<?xml version="1.0"?>\n<Configuration>\n' + (f'<HardwareConfiguration numChannels="{n}">\n<Device numBytes="4"/>\n</HardwareConfiguration>\n' if hardware else "") + spikes + ("</Configuration>\n" if end else "")
    rows = np.zeros(len(ts), np.dtype([("h", "u1", 5), ("t", "<u4"), ("d", "<i2", n)]))
    rows["t"], rows["d"] = ts, data
    path.write_bytes(text.encode() + rows.tobytes() + tail)


@pytest.mark.parametrize("n", [32, 64])
@pytest.mark.parametrize("per", [7, 1000])
def test_rec(spark, tmp_path, n, per):
    rng = np.random.default_rng(n)
    ts = np.arange(2**32 - 100, 2**32 - 50, dtype=np.uint32)
    data = rng.integers(-3000, 3000, (50, n)).astype(np.int16)
    order = [3, 0, n - 1]
    write_rec(tmp_path / "a.rec", ts, data, order, tail=b"xyz")
    want = data[:, [h % 32 * (n // 32) + h // 32 for h in order]]
    got = read_rec(spark, str(tmp_path / "a.rec"), packets_per_partition=per, block_size=3).orderBy("packet_no").collect()
    assert [r["ts"] for r in got] == ts.tolist()
    np.testing.assert_array_equal([r["data"] for r in got], want)
    some = read_rec(spark, str(tmp_path / "a.rec"), packets_per_partition=per, channels="2,0").where(F.col("ts") >= int(ts[40])).orderBy("ts").collect()
    np.testing.assert_array_equal([r["data"] for r in some], want[40:][:, [2, 0]])
    assert RecFormat().bounds(str(tmp_path / "a.rec")) == (int(ts[0]), int(ts[-1]))


def test_rec_errors_and_empty(spark, tmp_path):
    none = np.zeros((0, 32), np.int16)
    write_rec(tmp_path / "none.rec", [], none, [0])
    assert read_rec(spark, str(tmp_path / "none.rec")).count() == 0
    assert catalogue_of(spark, str(tmp_path / "none.rec")).count() == 0
    for name, options in (("end", {"end": False}), ("hw", {"hardware": False})):
        write_rec(tmp_path / f"{name}.rec", [], none, [0], **options)
        with pytest.raises(ValueError):
            RecFormat().layout(str(tmp_path / f"{name}.rec"))
    write_rec(tmp_path / "odd.rec", [], np.zeros((0, 33), np.int16), [0])
    with pytest.raises(ValueError, match="multiple"):
        RecFormat().layout(str(tmp_path / "odd.rec"))


@pytest.mark.parametrize("per", [3, 50])
def test_session(spark, tmp_path, per):
    """Files added out of order, with gaps between them, a duplicate and a missing sample."""
    starts, rng = [0, 100, 200, 300, 400], np.random.default_rng(0)
    for k in (0, 2, 3, 4, 1):
        ts = np.arange(starts[k], starts[k] + 10 + k)
        if k == 2:
            ts = np.delete(np.append(ts, ts[5]), 3)
            ts.sort()
        write_rec(tmp_path / f"f{4 - k}.rec", ts, rng.integers(-99, 99, (len(ts), 32)), [0, 1, 2])
    files = catalogue_of(spark, str(tmp_path))
    assert [r["start_ts"] for r in catalog.in_order(files).collect()] == starts
    packets = read_rec(spark, str(tmp_path), packets_per_partition=per)
    stitched = channels.stitch(packets.drop("path"), files).orderBy("start_ts", "packet_no")
    assert [r["ts"] for r in stitched.collect()] == sorted(r["ts"] for r in packets.collect())
    long = channels.extract_channels(packets.withColumn("packet_no", F.struct("file_id", "packet_no")), channels=[2, 0], max_gap_size=5, width=64)
    assert long.where("channel = 0").count() == sum(10 + k for k in range(5)) and long.select("channel").distinct().count() == 2
    channels.write_channels(long, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("channel = 2").count() == long.where("channel = 2").count()
    with pytest.raises(ValueError, match="channel"):
        channels.write_channels(long.union(long), str(tmp_path / "twice"))


def test_raw(spark, tmp_path):
    rows = [(c, t, (t * 7 + c) % 900 - 400) for c in (0, 10) for t in range(100, 160)]
    df = spark.createDataFrame(rows, "channel int, ts long, value int")
    write_raw(df, str(tmp_path / "raw"), channels=11, prefix="s1-", partitions=3)
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == ["s1-ch.00.raw", "s1-ch.10.raw", "s1-timestamps.raw"]
    np.testing.assert_array_equal(np.fromfile(tmp_path / "raw/s1-ch.10.raw", "<i2"), [v for c, _, v in rows if c == 10])
    back = read_raw(spark, str(tmp_path / "raw/s1-ch.10.raw"), str(tmp_path / "raw/s1-timestamps.raw"), elements_per_partition=7).orderBy("idx").collect()
    assert [(r["ts"], r["value"]) for r in back] == [(t, v) for c, t, v in rows if c == 10]
    assert [r["ts"] for r in read_raw(spark, str(tmp_path / "raw/s1-ch.10.raw")).orderBy("idx").collect()] == list(range(60))


def test_raw_is_checked_before_files_appear(spark, tmp_path):
    schema = "channel int, ts long, value int"
    for k, rows in enumerate(([(0, 5, 1), (0, 5, 2), (0, 6, 3)], [(c, t, 0) for c in (0, 1) for t in [*range(50), 20]])):
        with pytest.raises(Exception, match="strictly grow"):
            write_raw(spark.createDataFrame(rows, schema), str(tmp_path / f"bad{k}"), channels=2, partitions=4)
        assert not [p for p in (tmp_path / f"bad{k}").glob("*") if not p.name.startswith(".")]
    spark.createDataFrame([(3, t, t) for t in range(9)], schema).coalesce(1).selectExpr("channel", "ts", "cast(value as short) value").write.format("tidewire_raw").mode("append").options(channels="4").save(str(tmp_path / "direct"))
    np.testing.assert_array_equal(np.fromfile(tmp_path / "direct/ch.3.raw", "<i2"), range(9))
    write_raw(spark.createDataFrame([], schema), str(tmp_path / "none"), channels=2)


def test_spike_files(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(5, 13))
    (tmp_path / "spikes.bin").write_bytes(m.tobytes())
    got = read_spike_matrix(spark, str(tmp_path / "spikes.bin"), 12).orderBy("times").collect()
    want = m[np.argsort(m[:, -1])]
    np.testing.assert_allclose([r["spikes"] for r in got], want[:, :-1])
    df = spark.createDataFrame([(r["times"], r["spikes"]) for r in got], "times double, spikes array<double>")
    write_spikes(df, str(tmp_path / "spikes"))
    assert read_spikes(spark, str(tmp_path / "spikes")).count() == 5


def _run(query_of, tmp_path, name):
    q = query_of.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    schema, out = "channel int, idx long, value int", tmp_path / "in"
    for k, part in enumerate(([(0, 110, 1), (0, 111, 3)], [(0, 112, 5), (0, 150, 9), (1, 5, 0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(out))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(out))
    _run(censor_stream(stream, "idx", "channel", 30), tmp_path, "kept")
    assert sorted(map(tuple, spark.table("kept").collect())) == [(0, 110), (0, 150), (1, 5)]
    _run(fill_stream(stream, 50, "idx", "value", "channel"), tmp_path, "filled")
    got = sorted(map(tuple, spark.table("filled").where("channel = 0").collect()))
    assert [g[1] for g in got] == list(range(110, 151))


def test_rec_stream(spark, tmp_path):
    data = np.random.default_rng(0).integers(-9, 9, (30, 32))
    write_rec(tmp_path / "a.rec", np.arange(30), data, [1, 0])
    read_rec(spark, str(tmp_path / "a.rec"))
    stream = spark.readStream.format("tidewire_rec").option("packets_per_trigger", "8").load(str(tmp_path / "a.rec"))
    _run(stream, tmp_path, "packets")
    assert [r["ts"] for r in spark.table("packets").orderBy("ts").collect()] == list(range(30))


def test_rec_stream_restarts(spark, tmp_path):
    """After restarts, with the same file and a grown one, every packet has come once."""
    data = np.random.default_rng(0).integers(-9, 9, (45, 32))
    path, out = tmp_path / "a.rec", str(tmp_path / "out")
    read_rec(spark, str(path.parent))
    for n in (30, 30, 45, 45):
        write_rec(path, np.arange(n), data[:n], [1, 0])
        for _ in range(2):
            stream = spark.readStream.format("tidewire_rec").option("packets_per_trigger", "8").option("packets_per_partition", "5").load(str(path))
            q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(out)
            q.processAllAvailable()
            q.stop()
            assert sorted(r["ts"] for r in spark.read.parquet(out).collect()) == list(range(n))


def test_rec_bounds_of_unordered_timestamps(spark, tmp_path):
    """Timestamps that wrap and lie out of order: no packet inside the bounds is left out."""
    ts = np.concatenate([np.arange(2**32 - 20, 2**32), np.arange(30), [500, 3, 7]]).astype(np.uint32)
    write_rec(tmp_path / "a.rec", ts, np.zeros((len(ts), 32)), [0])
    for low, high in ((0, 40), (5, 8), (2**32 - 3, 2**32), (400, 600), (1000, 2000)):
        got = read_rec(spark, str(tmp_path / "a.rec"), packets_per_partition=11, block_size=4).where(f"ts >= {low} and ts <= {high}")
        assert sorted(r["ts"] for r in got.collect()) == sorted(int(t) for t in ts if low <= t <= high)


def test_rec_options(spark, tmp_path):
    rows = np.zeros(5, np.dtype([("h", "u1", 7), ("t", "<u8"), ("d", "i1", 64)]))
    rows["t"], rows["d"] = np.arange(2**33, 2**33 + 5), np.arange(320).reshape(5, 64) % 100 - 50
    text = '<?xml version="1.0"?>\n<Configuration>\n<HardwareConfiguration numChannels="32">\n<Device numBytes="4"/>\n</HardwareConfiguration>\n<SpikeChannel hwChan="33"/>\n</Configuration>\n'
    (tmp_path / "a.rec").write_bytes(text.encode() + rows.tobytes())
    got = read_rec(spark, str(tmp_path / "a.rec"), start_byte_size=3, timestamp_size=8, n_channels=64, bytes_per_neural_channel=1).orderBy("packet_no").collect()
    assert [r["ts"] for r in got] == rows["t"].tolist() and [r["data"] for r in got] == [[int(x[33 % 32 * 2 + 1])] for x in rows["d"]]
    with pytest.raises(ValueError):
        RecFormat(timestamp_size=3)
